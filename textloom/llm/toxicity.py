"""Toxicity classifier with counterfactual regularisation, fitted in numpy.

Features are the distinct words of a text, the 4- and 5-grams of characters of each word (with its borders marked) and
the first three letters; those that separate the labels best are kept.  A logistic model is fitted on them; for every labelled
sentence that names a group, and for a list of neutral sentences about groups, the group term is swapped for others and
the squared change of the score is part of the loss, so that naming a group does not move the score.

Fitting takes at most ``SAMPLE`` labelled documents a class and ``SAMPLE_CHARS`` characters of distinct words (both are
parameters), in order of a hash of the id; scoring covers every document and its whole text.  Only texts and labels
are read: never id, language or source.  Null and empty texts score as a text without words.  With labels of one
class only (or none), every score is the share of label 1 in the sample (0 without labels).  Repeated labels of a
document count as toxic if any is.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, fold, small_batches

SAMPLE = (1500, 3000)  # labelled documents of class 1 and 0 that a fit reads at most
SAMPLE_CHARS = 24_000_000
FEATURES = 1500
#: Terms that name groups of people, by kind; terms of a kind are swapped for each other.
IDENTITIES = (
    "muslim christian jewish hindu buddhist atheist catholic sikh".split(),
    "black white asian african latino european arab indigenous".split(),
    "women men female male woman man girl boy".split(),
    "gay lesbian straight bisexual transgender queer".split(),
    "old young disabled blind deaf immigrant refugee foreign".split(),
)
NEUTRAL = "i am a {} person;my neighbours are {};the {} community met today;she is a {} teacher;many {} people live here".split(";")
_WORD = re.compile(r"\w+")


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def grams(word: str) -> Iterator[str]:
    edged = f"<{word}>"
    yield word + "="
    yield edged[:4] + "-"
    for n in (4, 5):
        for i in range(len(edged) - n + 1):
            yield edged[i : i + n]


class Model:
    """Weights of the kept features; scores texts with a bounded cache of words."""

    CACHE = 40_000

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.index = {x: i for i, x in enumerate(names)}
        self.weights, self.bias = weights, bias
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def features(self, words: set[str]) -> set[int]:
        cache, index, out = self.cache, self.index, set()
        for word in words:
            own = cache.get(word)
            if own is None:
                own = tuple({index[x] for x in grams(word) if x in index})
                if len(cache) >= self.CACHE:
                    cache.clear()
                if len(word) < 64:
                    cache[word] = own
            if own:
                out.update(own)
        return out

    def logit(self, words: set[str]) -> float:
        return float(self.bias + sum(self.weights[i] for i in sorted(self.features(words))))

    def score(self, text: str | None) -> float:
        return 1 / (1 + np.exp(-np.clip(self.logit(word_set(text)), -30, 30)))


def swaps(words: set[str], times: np.ndarray, own: dict[str, set[int]]) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Features that go and that come if a group term of ``words`` is swapped for each other term of its kind.

    ``times``: the number of words of the text that have each feature; ``own``: the features of each group term.
    """
    for kind in IDENTITIES:
        for term in kind:
            if term in words:
                once = {k for k in own[term] if times[k] == 1}
                for other in kind:
                    if other != term:
                        yield tuple(sorted(once - own[other])), tuple(sorted(k for k in own[other] if times[k] == 0))


def fit_model(rows: Iterable[tuple[set[str], int]], features: int = FEATURES, strength: float = 1.0, steps: int = 250) -> Model:
    """``strength`` weighs the counterfactual term.

    The rows are read once; of their words only numbers and distinct texts are held, as all of this runs in the driver.
    """
    index: dict[str, int] = {}
    terms = {t for kind in IDENTITIES for t in kind}
    docs, y, named = [], [], {}
    for n, (words, label) in enumerate(rows):
        docs.append(np.fromiter((index.setdefault(w, len(index)) for w in sorted(words)), dtype=np.int32, count=len(words)))
        y.append(float(label))
        if not terms.isdisjoint(words):
            named[n] = terms & words
    y = np.array(y)
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0, 1e-6, 1 - 1e-6))
        return Model([], np.zeros(0), float(np.log(share / (1 - share))))
    # grams by their hashes, which take far less of the driver's memory than texts
    hashed = lambda w: {xxhash.xxh64_intdigest(x) for x in grams(w)}
    flat, begins = array("Q"), np.zeros(len(index) + 1, dtype=np.int64)
    for n, w in enumerate(index, 1):
        flat.extend(hashed(w))
        begins[n] = len(flat)
    flat = np.asarray(flat, dtype=np.uint64)
    kinds, ids = np.sort(flat), np.empty(len(flat), dtype=np.int32)
    kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])[: len(kinds)]]  # np.unique takes more memory
    for n in range(0, len(flat), 1 << 16):
        ids[n : n + (1 << 16)] = np.searchsorted(kinds, flat[n : n + (1 << 16)])
    del flat

    def grams_of(own: np.ndarray) -> np.ndarray:
        counts = begins[own + 1] - begins[own]
        return ids[np.repeat(begins[own] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))]

    counts = np.zeros((2, len(kinds)), dtype=np.int32)
    for own, label in zip(docs, y, strict=True):
        if len(own):
            counts[int(label), np.unique(grams_of(own))] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    wanted = np.flatnonzero((counts[1] > 0) | (counts[0] >= 0.02 * n0))
    counts = counts[:, wanted]
    p, q, both = counts[1] / n1, counts[0] / n0, (counts.sum(axis=0) + 1) / (n0 + n1 + 2)
    value = (p - q) ** 2 / (both * (1 - both) * (1 / n1 + 1 / n0))
    chosen = wanted[np.lexsort((kinds[wanted], -value))[:features]]
    del wanted, counts, p, q, both, value
    hashes = set(kinds[chosen].tolist())
    found = {x for w in index for x in grams(w) if xxhash.xxh64_intdigest(x) in hashes}
    names = sorted(found | {t + "=" for t in terms})
    blank = Model(names, np.zeros(len(names)), 0.0)
    column = np.full(len(kinds) + 1, -1)
    for name, k in blank.index.items():
        at = int(np.searchsorted(kinds, np.uint64(xxhash.xxh64_intdigest(name))))
        column[at if at < len(kinds) and int(kinds[at]) == xxhash.xxh64_intdigest(name) else len(kinds)] = k

    neutral = [set(s.format(kind[0]).split()) for kind in IDENTITIES for s in NEUTRAL]
    own_of = {t: blank.features({t}) for t in terms}
    x = np.zeros((len(docs) + len(neutral), len(names)), dtype=np.float32)
    moves = set()
    for i, own in enumerate(docs):
        if len(own):
            at = column[grams_of(own)]
            at = at[at >= 0]
            x[i, at] = 1
            if i in named:
                moves.update(swaps(named[i], np.bincount(at, minlength=len(names)), own_of))
    for i, words in enumerate(neutral, len(docs)):
        at = np.array([k for w in words for k in blank.features({w})], dtype=np.int64)
        x[i, at] = 1
        moves.update(swaps(words, np.bincount(at, minlength=len(names)), own_of))
    del docs, index, named, kinds, ids, begins, column
    y = np.concatenate([y, np.zeros(len(neutral))])
    change = np.zeros((len(moves), len(names)), dtype=np.float32)
    for i, (gone, come) in enumerate(moves):
        change[i, gone], change[i, come] = 1, -1
    change = np.unique(change, axis=0)
    w, b = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / (y == 0).sum())
    for step in range(1, steps + 1):
        w32 = w.astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(x @ w32 + b, -30, 30)))
        g = (p - y) * each
        moved = change @ w32
        grad = np.append(g.astype(np.float32) @ x + 1e-4 * w + strength * 2 * (moved @ change) / max(1, len(change)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        update = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - update[:-1], b - update[-1]
    return Model(names, w, float(b))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, sample: tuple[int, int], chars: int, reduce) -> list[tuple[str, int]]:
    """At most ``sample`` training rows a class and ``chars`` characters as ``(reduce(text), label)``, in hash order of the id."""
    picked = labels.select(F.col(id_col).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    picked = picked.where(fold(F.col("key")) != 0).groupBy("key").agg(F.max("label").alias("label"))
    part = [picked.where(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(sample[1 - k]) for k in (0, 1)]
    own = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")
    small = F.broadcast(part[0].unionByName(part[1]))  # at most sum(sample) rows of two numbers

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [reduce(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(2)], names=batch.schema.names)

    rows = own.join(small, "key").select("key", "text", "label")
    rows = rows.mapInArrow(shrink, rows.schema).withColumn("size", F.length("text").cast("long"))
    rows = cut(rows.groupBy("key", "label").agg(F.min_by("text", F.struct("size", "text")).alias("text"), F.min("size").alias("size")), "labelled")
    by_hash = Window.orderBy(F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.select("key", F.sum("size").over(by_hash).alias("so_far"))  # of at most sum(sample) rows of two numbers
    kept = rows.join(F.broadcast(sizes.where(F.col("so_far") <= chars)), "key").select("so_far", "text", "label").collect()
    discard(rows)
    return [(r["text"], r["label"]) for r in sorted(kept, key=lambda r: r["so_far"])]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: tuple[int, int] = SAMPLE, chars: int = SAMPLE_CHARS, **how) -> Model:
    rows = labelled(docs, labels, label, id_col, text_col, sample, chars, lambda t: " ".join(sorted(word_set(t))))[::-1]
    taken = (rows.pop() for _ in range(len(rows)))  # a text goes when its words are read
    return fit_model(((set(t.split(" ")) - {""}, k) for t, k in taken), **how)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col`` (a column of that name is replaced): the chance of label 1, from the whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        one = sent.value.score
        return pa.array([one(x.as_py()) for x in text], pa.float64())

    return docs.withColumn(out_col, scored(F.col(text_col)))
