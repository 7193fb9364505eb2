"""Near-duplicate groups by Order MinHash with banded alignment.

A text is the sequence of its overlapping five-word shingles (a text of fewer words is one shingle).  A shingle that
repeats is labelled with its occurrence number.  For each of ``bands * tables`` orders the two smallest labelled shingles are
sampled and kept in the order in which they stand in the text; a band hashes the samples of ``tables`` orders.  Texts
that agree in a band are candidates.  A candidate is a link if the edit distance of the two shingle sequences is at most
(1 - ``similarity``) times the longer length, found by an alignment that is computed in that band around the diagonal only.

Copies (the same words) collapse to one representative before anything else.  Of each bucket every member is first
compared with the bucket's smallest member, which is linear however large the bucket is; after the links found so are
joined to groups, the members of a bucket that are still in different groups are all compared, block by block, so that no
link between candidates is lost to the star: the members of a large group are dealt into blocks that meet the other groups' blocks, but never each
other, and each pair of blocks of a bucket is a task of its own.  Buckets of the same members are compared once, and two documents only in the
first bucket they share.  The result has one row per input row: id, the group's smallest id, and whether the row
is that one.

Words: A-Z lower-cased, runs of a-z, 0-9 and non-ASCII characters.  Null and empty texts (and texts without words) are
copies of each other.  Repeated rows are copies.  Other columns, whatever their names, are not carried.  Every row counts, whatever its id: texts are told apart by their words, so rows with a null id are compared and returned,
and different texts under one id are documents of their own.  The smallest id of a group is null only if all its ids are.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, texts, unused
from .components import components
from .decontam import words_of

SHINGLE, SIMILARITY, BANDS, TABLES = 5, 0.8, 60, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """32-bit hashes of words, kept for the short ones."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh32_intdigest(word)
        if len(word) < 64:
            self[word] = got
        return got


_CACHE = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """32-bit hashes; equal words have equal hashes in every process."""
    if len(_CACHE) > 60_000:
        _CACHE.clear()
    return np.fromiter(map(_CACHE.__getitem__, words), dtype=np.uint32, count=len(words))


def scrambled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the overlapping shingles, in text order."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    size = min(size, len(hashes))
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
        for k in range(size):
            out = out * _MIX + hashes[k : len(hashes) - size + 1 + k]
    return scrambled(out)


def labelled(x: np.ndarray) -> np.ndarray:
    """Each shingle with its occurrence number mixed in; a first occurrence is the shingle itself, whatever else the text repeats."""
    order = np.argsort(x, kind="stable")
    new = np.empty(len(x), dtype=bool)
    new[0], new[1:] = True, x[order][1:] != x[order][:-1]
    if new.all():
        return x
    at = np.arange(len(x))
    count = np.empty(len(x), dtype=np.uint64)
    count[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.where(count == 0, x, scrambled(x + count * _MIX))


def multipliers(n: int) -> np.ndarray:
    return scrambled(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def sketch(hashes: np.ndarray, bands: int = BANDS, tables: int = TABLES) -> np.ndarray:
    """One key a band (none for a text without words)."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    x = labelled(shingles(hashes))
    keys, pairs = np.zeros(bands, dtype=np.uint64), np.empty(bands * tables, dtype=np.uint64)
    odd = multipliers(bands * tables).astype(np.uint32)
    short = (x >> np.uint64(32)).astype(np.uint32)
    at_once = max(1, 60_000 // len(x))  # a block of ranks stays in the processor's cache
    with np.errstate(over="ignore"):
        for begin in range(0, len(odd), at_once):
            own = odd[begin : begin + at_once]
            ranks = short[None, :] * own[:, None]
            rows = np.arange(len(own))
            first = ranks.argmin(axis=1)
            ranks[rows, first] = 0xFFFFFFFF
            second = ranks.argmin(axis=1) if len(x) > 1 else first
            low, high = x[np.minimum(first, second)], x[np.maximum(first, second)]
            pairs[begin : begin + len(own)] = low * _MIX + high
        for k in range(tables):
            keys = keys * _MIX + scrambled(pairs[k::tables])
        keys = scrambled(keys + np.arange(1, bands + 1, dtype=np.uint64) * _MIX)
    return keys.view(np.int64)


def banded(a: list, b: list, most: int) -> int:
    """Edit distance of ``a`` and ``b`` if it is ``most`` or less, else ``most + 1``.

    The rows of the band around the diagonal are the bits of one integer a column; a column costs a few operations on integers of 2 * most + 2 bits.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if n <= most:
        most_in = n
    else:
        most_in = most
    width = 2 * most_in + 2
    full = (1 << width) - 1
    top = 1 << (width - 1)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    vp, vn, distance = (full << (width - most_in - 1)) & full, 0, most_in
    at, horizontal = most_in + 1 - width, top >> 1
    for j in range(m):
        own = where.get(b[j], 0)
        x = (own << -at if at < 0 else own >> at) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j < n - most_in:
            distance += not d0 & top
        else:
            distance += bool(hp & horizontal) - bool(hn & horizontal)
            horizontal >>= 1
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
        at += 1
    return min(distance, most + 1)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sequences of shingles are as alike as asked."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) <= most:
        return True
    a, b = a.tolist(), b.tolist()
    shared = sum((Counter(a) & Counter(b)).values())  # what is not shared has to be edited
    return max(len(a), len(b)) - shared <= most and banded(a, b, most) <= most


def copy_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _sketches(rows: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                digests.append(copy_of(words))
                sizes.append(len(words))
                keys.append(sketch(word_hashes(words)))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
            offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.array(sizes, pa.int64())], names=["id", "copy", "keys", "n"])

    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, copy binary, keys array<long>, n long")


def _hashed(rows: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, out = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                digests.append(copy_of(words))
                out.append(word_hashes(words).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(out, pa.binary())], names=["copy", "words"])

    return rows.mapInArrow(scan, "copy binary, words binary")


def _linked(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are links."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, last, own = [], None, None
            for wa, wb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wa != last:
                    last, own = wa, shingles(np.frombuffer(wa, np.uint32))
                kept.append(similar(own, shingles(np.frombuffer(wb, np.uint32)), similarity))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    a, b = (words.select(F.col("id").alias(k), F.col("words").alias("w" + k)) for k in "ab")
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "wa", "wb")  # last the centres, of which one may have many pairs
    return joined.mapInArrow(verify, pairs.select("a", "b").schema)


BLOCK, BLOCK_WORDS = 512, 1_000_000


def across(key: int, sides: list, reps: list, groups: list, keys: list, words: list, similarity: float = SIMILARITY) -> list[tuple]:
    """Links between different groups among the documents of one task of bucket ``key``.

    ``sides``: the block of each document; if there are two, only documents of different blocks are compared.  What documents share is counted
    over an inverted list of their shingles; a pair that shares enough is aligned, unless links found here already join its groups.
    """
    n = len(reps)
    x = [shingles(np.frombuffer(w, np.uint32)) for w in words]
    bags = [labelled(y) if len(y) else y for y in x]
    sizes = np.array([len(y) for y in x], dtype=np.int64)
    order = np.argsort(np.concatenate(bags), kind="stable")
    kinds, at = np.unique(np.concatenate(bags), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    postings, begins = owner[order], np.searchsorted(at[order], np.arange(len(kinds) + 1))
    ends = np.cumsum(sizes)
    group, side = np.unique(np.array(groups), return_inverse=True)[1], np.unique(np.array(sides), return_inverse=True)[1]
    two = side.max(initial=0) > 0
    root = list(range(int(group.max(initial=0)) + 1))

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    out = []
    for i in range(n):
        own = at[ends[i] - sizes[i] : ends[i]]
        counts = begins[own + 1] - begins[own]
        offsets = np.repeat(begins[own] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(int(counts.sum()))
        shared = np.bincount(postings[offsets], minlength=n)
        longer = np.maximum(sizes, sizes[i])
        wanted = (longer - shared <= ((1 - similarity) * longer + 1e-9).astype(np.int64)) & (group != group[i])
        wanted[: i + 1] = False
        if two:
            wanted &= side != side[i]
        for j in np.flatnonzero(wanted):
            a, b = find(int(group[i])), find(int(group[j]))
            if a != b and min(set(keys[i]) & set(keys[j])) == key and similar(x[i], x[j], similarity):
                root[b] = a
                out.append((reps[i], reps[j]))
    return out


def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Runs :func:`across` on each task of rows that arrive sorted by task."""
    task, rows = None, []
    names, kind = ["a", "b"], None

    def done() -> pa.RecordBatch:
        links = across(rows[0][1], *(list(c) for c in list(zip(*rows, strict=True))[2:]), similarity=similarity)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], kind) for k in (0, 1)], names=names)

    for batch in batches:
        kind = batch.schema.field("rep").type
        for row in zip(*(batch.column(k).to_pylist() for k in ("task", "key", "side", "rep", "c", "keys", "words")), strict=True):
            if row[0] != task:
                if rows:
                    yield done()
                task, rows = row[0], []
            rows.append(row)
    if rows:
        yield done()


def _across(member: DataFrame, found: DataFrame, words: DataFrame, similarity: float, cuts: list[DataFrame]) -> DataFrame:
    """Links (a, b) between documents that share a bucket (key, rep, n words) but are not yet in one group.

    ``cuts`` takes what to discard afterwards.  Rows grow with the blocks of a bucket, not with its pairs.
    """
    own = cut(member.join(found.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c")), "omh-own")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"mark{k}") for k in (0, 1)]
    mixed = own.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("m"), *marks).where("x <> y")
    kept = mixed.groupBy("m", "mark0", "mark1").agg(F.min("key").alias("key")).select("key")  # of buckets with the same members one
    crossing = cut(own.join(kept, "key"), "omh-mixed")
    cuts += [own, crossing]
    blocks = lambda m, w: F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(w / BLOCK_WORDS)).cast("long")
    per = crossing.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("w")).withColumn("parts", blocks(F.col("m"), F.col("w")))
    large, small = F.col("parts") > 1, F.col("parts") == 1
    label = lambda c, k: F.concat_ws(".", c.cast("string"), k.cast("string"))
    count_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    each = per.groupBy("key").agg(
        F.collect_list(F.when(large, F.struct("c", "parts"))).alias("large"),
        F.coalesce(F.sum(F.when(small, F.col("m"))), F.lit(0)).alias("m"),
        F.coalesce(F.sum(F.when(small, F.col("w"))), F.lit(0)).alias("w"),
    )
    labels = F.flatten(F.transform("large", lambda g: F.transform(count_to(g["parts"]), lambda k: F.struct(g["c"].alias("c"), label(g["c"], k).alias("label")))))
    rest = F.transform(count_to(F.col("rest")), lambda k: F.struct(F.lit(None).cast(per.schema["c"].dataType).alias("c"), label(F.lit("rest"), k).alias("label")))
    each = each.withColumn("rest", blocks(F.col("m"), F.col("w"))).select("key", "rest", F.concat(labels, F.when(F.col("m") > 0, rest).otherwise(F.slice(rest, 1, 0))).alias("labels"))
    dealt = crossing.join(per.select("key", "c", "parts"), ["key", "c"]).join(each, "key")
    side = F.when(large, label(F.col("c"), F.pmod(F.xxhash64("rep"), "parts"))).otherwise(label(F.lit("rest"), F.pmod(F.xxhash64("c"), "rest")))
    others = F.filter("labels", lambda x: small | x["c"].isNull() | (x["c"] != F.col("c")))
    dealt = dealt.withColumn("side", side).select("key", "rep", "c", "side", F.explode(others).alias("other"))
    task = F.concat_ws(":", F.col("key").cast("string"), F.least("side", "other.label"), F.greatest("side", "other.label"))
    docs = crossing.groupBy("rep").agg(F.collect_list("key").alias("keys")).join(words.withColumnRenamed("id", "rep"), "rep")
    rows = dealt.select(task.alias("task"), "key", "side", "rep", "c").join(docs, "rep").select("task", "key", "side", "rep", "c", "keys", "words")
    kind = member.schema["rep"].dataType.simpleString()
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(lambda batches: _compared(batches, similarity), f"a {kind}, b {kind}").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(id, class_id, kept)`` for every row of ``docs``."""
    rows = texts(docs, id_col, text_col)
    sketched = cut(_sketches(rows), "omh")
    reps = sketched.groupBy("copy").agg(F.min("id").alias("low"), F.first("keys").alias("keys"), F.first("n").alias("n")).withColumn("rep", F.monotonically_increasing_id())
    reps = cut(reps, "omh-reps")  # written once, so the numbers stay
    members = reps.select("rep", "n", F.explode("keys").alias("key"))
    centres = members.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).where("members > 1").select("key", "centre")
    member = cut(members.join(centres, "key"), "omh-buckets")
    star = cut(member.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "omh-star")
    wanted = star.select(F.col("a").alias("rep")).unionByName(star.select(F.col("b").alias("rep"))).distinct()
    wanted = cut(reps.join(wanted, "rep").select("copy", "rep", "low"), "omh-wanted")
    # A row of each wanted copy: rows whose id is a smallest one (or null) are hashed, and told apart by their words.
    some = rows.where("id is not null").join(wanted.select(F.col("low").alias("id")).where("id is not null").distinct().hint("merge"), "id", "left_semi")
    hashed = _hashed(some.unionByName(rows.where("id is null")))
    words = cut(hashed.join(wanted.select("copy", "rep"), "copy").select(F.col("rep").alias("id"), "words").dropDuplicates(["id"]), "omh-words")
    links = cut(_linked(star, words, similarity), "omh-links")
    found = components(links)

    cuts: list[DataFrame] = [wanted]
    more = cut(_across(member.select("key", "rep", "n"), found, words, similarity, cuts), "omh-more")
    if not more.isEmpty():
        discard(found)
        found = components(links.unionByName(more))
    named = reps.select("copy", "rep", F.struct(F.col("low").isNull().alias("none"), F.col("low").alias("id"), "copy").alias("own"))
    linked = cut(found.withColumnRenamed("v", "rep").join(named, "rep"), "omh-named")
    cuts.append(linked)
    best = linked.join(linked.groupBy("component").agg(F.min("own").alias("best")), "component").select("rep", "best")
    classes = named.join(best, "rep", "left").select("copy", F.coalesce("best", "own").alias("best")).select("copy", F.col("best.id").alias("class_id"), F.col("best.copy").alias("one"))
    kept = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("copy") == F.col("one"))
    out = cut(sketched.select("id", "copy").join(classes, "copy").select("id", "class_id", kept.alias("kept")), "omh-classes")
    for old in (sketched, reps, member, star, words, links, more, found, *cuts):
        discard(old)
    return out


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one document of each group; a repeated row (same id, same text) counts as a copy.  All columns are returned."""
    text, key = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), unused(docs, "_key")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text.alias("text")))
    found = groups(keyed, key, text_col)
    dropped = found.groupBy("id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("id").alias(key))
    out = keyed.join(dropped, key, "left_anti")
    unique = found.groupBy("id").count().where("count > 1").isEmpty()
    return (out if unique else out.dropDuplicates([key])).select(*docs.columns)
