"""Embedding near-duplicates by a pivot-permutation index.

Pivots are taken from a bounded sample of vectors (at most ``PIVOTS``, in order of a hash of the vector; the bound is a parameter); a sampled
vector within cosine ``APART`` of a pivot already taken is none, but marks that pivot as dense.

A vector within ``APART`` of a dense pivot is covered, and owned by the nearest of them.  It is compared with every vector that can be a
link of it by the triangle inequality of angles, block by block, so links with a covered end are complete however large the dense region is; a pair of
two owners is compared in the list of the lower pivot only.

Every other vector is described by its ``nearest`` most similar pivots in order.  Two vectors are candidates if they share two or more of these pivots; a candidate
is verified by its cosine in double precision.  A vector stands in the inverted list of each of its pivots, and the number of pivots grows with the table so that lists keep
about ``LIST`` vectors.  Where that takes more pivots than the bound, lists are kept for pairs of pivots instead: the candidates are the same, as to share two
pivots is to share a pair, and the lists are far shorter.  A longer list is dealt into blocks, and each pair of blocks
is a task of its own, so no list meets in one task.  A pair is counted in the first list it shares only.

Equal vectors collapse first; they count as links of each other and are not expanded.  A block yields one row a vector (its links and the vector of the smallest
number it is joined to there), never pairs.

Vectors that are null or empty, or hold null or non-finite components, or have length zero, link with nothing and are their own
component.  Vectors of different dimension do not link.  Every row is returned, repeated rows included: rows of equal id, and rows with a null id, are vectors of their own.  A component
is named by its smallest id that is not null; one of rows without ids only has no name, and all of its rows are kept.  Other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, small_batches
from .components import components

COSINE, PIVOTS, NEAREST, SHARED, LIST, BLOCK, APART = 0.9, 4096, 8, 2, 1500, 1024, 0.8
PAIR, COVER = 12, 1 << 24  # the list of pivots a < b has the number (a << PAIR) + b; numbers of the dense pivots' own lists begin at COVER
ALL = -1  # the list of a dimension with too few pivots to tell vectors apart


def unit(rows: list[bytes], dtype=np.float64) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _encoded(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, type]:
    """(id, vector as bytes, or null where it links with nothing), and the type of the numbers in it.

    Single precision stays as it is; other numbers become doubles, scaled by a power of two so that squares neither over- nor underflow.
    """
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    kind = np.float32 if single else np.float64
    small_batches(vectors.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in own], dtype=np.float64) if own else np.zeros(0)
                most = np.abs(x).max(initial=0.0)
                if most > 0 and np.isfinite(x).all():
                    x = x if single else np.ldexp(x, -math.frexp(most)[1])
                    out.append((x + 0.0).astype(kind).tobytes())  # -0.0 is 0.0
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vector"])

    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, vector binary"), kind


def described(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the most similar pivots of each row of ``x``, most similar first, ties by number."""
    like = -np.round(x @ pivots.T, 12)
    if like.shape[1] > 4 * nearest:  # all that can be among the nearest, ties included
        bound = np.partition(like, nearest - 1, axis=1)[:, nearest - 1]
        out = np.empty((len(x), nearest), dtype=np.int32)
        for i, row in enumerate(like):
            some = np.flatnonzero(row <= bound[i])
            out[i] = some[np.argsort(row[some], kind="stable")[:nearest]]
        return out
    return np.argsort(like, axis=1, kind="stable")[:, :nearest].astype(np.int32)


def spread(x: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of ``x`` that are pivots, and which of these are dense."""
    taken, dense, pivots = [], [], np.empty_like(x)
    for i, own in enumerate(x):
        like = pivots[: len(taken)] @ own
        if len(like) and like.max() >= apart:
            dense[int(like.argmax())] = True
        else:
            pivots[len(taken)] = own
            taken.append(i)
            dense.append(False)
    return np.array(taken, dtype=np.int64), np.array(dense, dtype=bool)


def covered(x: np.ndarray, pivots: np.ndarray, dense: np.ndarray, cosine: float, apart: float) -> list[tuple[int, list[int]]]:
    """For each row of ``x``: its owner (or -1), and the dense pivots in whose lists it is a guest."""
    numbers = np.flatnonzero(dense)
    if not len(numbers):
        return [(-1, [])] * len(x)
    like = np.round(x @ pivots[numbers].T, 12)
    best = like.argmax(axis=1)
    owner = np.where(like[np.arange(len(x)), best] >= apart, numbers[best], -1)
    reach = math.cos(min(math.pi, math.acos(max(-1.0, min(1.0, apart))) + math.acos(max(-1.0, min(1.0, cosine))))) - 1e-9
    guest = (like >= reach) & ((owner[:, None] < 0) | (numbers[None, :] < owner[:, None]))
    return [(int(own), numbers[g].tolist()) for own, g in zip(owner, guest, strict=True)]


def joined(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id reachable over ``linked`` (symmetric, boolean), for each row."""
    labels = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = labels
    while True:
        low = np.minimum(rank, np.where(linked, rank[None, :], len(ids)).min(axis=1, initial=len(ids)))
        low = np.minimum(low, low[order[low]])
        if (low == rank).all():
            return ids[order[rank]]
        rank = low


def first_shared(a: np.ndarray, b: np.ndarray, number: int, shared: int, pairs: bool) -> np.ndarray:
    """Which rows of the sorted lists ``a`` and ``b`` share ``shared`` pivots and meet in list ``number`` first."""
    same = (a[:, :, None] == b[:, None, :]).any(axis=2)
    first = same.argmax(axis=1)
    rows = np.arange(len(a))
    out = (same.sum(axis=1) >= shared) & (a[rows, first] == (number >> PAIR if pairs else number))
    if pairs:
        same[rows, first] = False
        out &= a[rows, same.argmax(axis=1)] == number & ((1 << PAIR) - 1)
    return out


def compare(pdf: pd.DataFrame, number: int, same: bool, cosine: float, shared: int, pairs: bool, kind: type = np.float64) -> pd.DataFrame:
    """Links among the rows of one pair of blocks of list ``number``: (rep, links, low).  ``same``: the two blocks are one; ``pairs``: lists are of pairs of pivots."""
    parts = []
    for size in sorted(pdf["vector"].str.len().unique()):
        own = pdf[pdf["vector"].str.len() == size].sort_values(["part", "rep"])
        x, reps, many = unit(own["vector"].tolist(), kind), own["rep"].to_numpy(), own["many"].to_numpy(dtype=np.int64)
        linked = x @ x.T >= cosine
        if not same:
            part = own["part"].to_numpy()
            linked &= part[:, None] != part[None, :]
        np.fill_diagonal(linked, False)
        if 0 <= number < COVER and linked.any():
            lists = np.sort(np.vstack(own["pivots"].tolist()), axis=1)
            i, j = np.nonzero(np.triu(linked))
            for begin in range(0, len(i), 100_000):
                at, to = i[begin : begin + 100_000], j[begin : begin + 100_000]
                linked[at, to] = linked[to, at] = first_shared(lists[at], lists[to], number, shared, pairs)
        if linked.any():
            links = linked @ many
            some = links > 0
            parts.append(pd.DataFrame({"rep": reps[some], "links": links[some], "low": joined(linked, reps)[some]}))
    return pd.concat(parts) if parts else pd.DataFrame({"rep": [], "links": [], "low": []}).astype("int64")


def links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, nearest: int = NEAREST,
    shared: int = SHARED, most_pivots: int = PIVOTS, list_size: int = LIST, block: int = BLOCK, apart: float = APART,
) -> DataFrame:
    """``(id, n_links, component_id)`` for every row."""
    spark = vectors.sparkSession
    encoded, kind = _encoded(vectors, id_col, vector_col)
    rows = cut(encoded, "vectors")
    distinct = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("low"), F.count("*").alias("many")).withColumn("rep", F.monotonically_increasing_id())
    distinct = cut(distinct, "vectors-distinct")  # written once, so the numbers stay
    n = distinct.count()
    needed = max(32, math.ceil(nearest * n / list_size))
    wanted, pairs = min(most_pivots, needed), needed > most_pivots
    assert shared == 2 or not pairs, "lists of pairs tell who shares two pivots"
    sample = [bytes(r["vector"]) for r in distinct.orderBy(F.xxhash64("vector"), "vector").select("vector").limit(wanted).collect()]
    by_size = {}
    for size in {len(v) for v in sample}:
        x = unit([v for v in sample if len(v) == size], kind)
        taken, dense = spread(x, apart)
        by_size[size] = x[taken], dense
    sent = spark.sparkContext.broadcast(by_size)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            out: list = [[ALL]] * len(raw)  # a dimension with too few pivots: all share one list
            own: list = [(-1, [])] * len(raw)
            lists: list = [[ALL]] * len(raw)
            for size in {len(v) for v in raw} & sent.value.keys():
                pivots, dense = sent.value[size]
                where = [i for i, v in enumerate(raw) if len(v) == size]
                x = unit([raw[i] for i in where], kind)
                found = described(x, pivots, nearest)
                few = found.shape[1] < max(shared, min(nearest, 2))
                for i, near, cover in zip(where, found.tolist(), covered(x, pivots, dense, cosine, apart), strict=True):
                    own[i] = cover
                    if not few:
                        out[i] = near
                        low = sorted(near)
                        lists[i] = [(a << PAIR) + b for k, a in enumerate(low) for b in low[k + 1 :]] if pairs else near
            owned = [near if owner < 0 else [COVER + owner] for near, (owner, _) in zip(lists, own, strict=True)]
            guests = [[COVER + g for g in guest] for _, guest in own]
            several = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array(out, several), pa.array(owned, several), pa.array(guests, several)], names=["rep", "vector", "many", "pivots", "owned", "guests"])

    index = cut(distinct.select("vector", "rep", "many").mapInArrow(describe, "rep long, vector binary, many long, pivots array<int>, owned array<int>, guests array<int>"), "pivots")
    owned = F.transform("owned", lambda p: F.struct(p.alias("pivot"), F.lit(True).alias("own")))
    guests = F.transform("guests", lambda p: F.struct(p.alias("pivot"), F.lit(False).alias("own")))
    every = F.explode(F.concat(owned, guests)).alias("l")
    listed = index.select("rep", "vector", "many", "pivots", every).select("rep", "vector", "many", "pivots", "l.pivot", "l.own")
    sizes = index.select(every).groupBy("l.pivot").agg(F.count("*").alias("n"), F.count_if("l.own").alias("own")).where("n > 1 and own > 0")
    blocks = lambda n: F.ceil(n / block).cast("int")
    longer = sizes.select("pivot", blocks(F.col("own")).alias("parts"), blocks(F.col("n") - F.col("own")).alias("more"))
    if not pairs:
        longer = F.broadcast(longer)  # a row a pivot: bounded
    # The owned blocks of a list come first, then those of guests; guests meet owned blocks only.
    hashed = F.xxhash64("rep")
    dealt = listed.join(longer, "pivot").withColumn("part", F.when(F.col("own"), F.pmod(hashed, F.col("parts"))).otherwise(F.col("parts") + F.pmod(hashed, F.col("more"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("parts") + F.col("more")).otherwise(F.col("parts")) - 1)).alias("other")
    dealt = dealt.select("*", other).withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")})
    task = F.concat_ws(":", "pivot", "a", "b").alias("task")  # one key, so that the blocks of a list are dealt to many tasks

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, a, b = map(int, key[0].split(":"))
        return compare(pdf, pivot, a == b, cosine, shared, pairs, kind)

    found = cut(dealt.select(task, "part", "rep", "vector", "many", "pivots").groupBy("task").applyInPandas(run, "rep long, links long, low long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("low").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("v", "rep")
    grouped = cut(distinct.select("rep", "low").join(groups, "rep"), "vector-groups")
    names = grouped.groupBy("component").agg(F.min("low").alias("name"))
    named = grouped.join(names, "component").select("rep", "name")
    per = distinct.join(counts, "rep", "left").join(named.withColumn("linked", F.lit(True)), "rep", "left")
    per = per.select(F.col("vector").alias("copy"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.when(F.col("linked"), F.col("name")).otherwise(F.col("low")).alias("component_id"))
    alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = rows.where("vector is not null").join(per, F.col("vector") == F.col("copy")).select("id", F.col("n_links").cast("long"), "component_id")
    out = cut(linked.unionByName(alone), "vector-classes")
    for old in (rows, distinct, index, found, groups, grouped):
        discard(old)
    return out


def digest(found: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
