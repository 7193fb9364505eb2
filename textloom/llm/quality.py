"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network, calibrated.

Random indexing: each token (a run of word characters or of signs; words in capitals differ from others) owns a sparse random vector of 1 and -1, by rule from its
hash.  The context vector of a word is the sum of the random vectors of its neighbours within ``REACH`` tokens, over all documents.  The sums are
kept as a sketch: a word has ``WAYS`` rows of ``ROWS`` by different hashes, each occurrence counts in all of them, and a word is read
from the one with the least mass, the one least mixed with others.  Every word has a vector so, however large the vocabulary;
how much is mixed in depends on a word's share of all tokens, not on the size of the corpus, and the table can be sent to the executors.  A vector is the
difference of a word's mean context from that of all words, at unit length, and shrinks for rare words.

A document is the mean of its tokens' vectors, the spread around it, and the mean and spread of the steps from each token's vector to the next's, nothing else.  The network has
one hidden layer of ``HIDDEN`` units; it is fitted with numpy on at most ``SAMPLE`` labelled documents a class (fold 1 of the five is kept
from it to fit the temperature, fold 0 is held out altogether).  Texts and labels alone are read: no id, language or source.

Null and empty texts are documents without tokens and get a score as any other.  With labels of one class (or none) the score
is the share of label 1 in the sample (0 without labels).  Of repeated labels of an id the least counts, of documents that share an id one is learnt from (the
sample takes ids in order of their hash, ties by id); repeated rows each get their score, and other columns stay as they are, whatever their names (one
named as the score's is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches
from .near_dedup import scrambled

ROWS, WAYS, DIM, REACH, HIDDEN, SIGNS = 1 << 16, 3, 32, 2, 32, 4
SAMPLE = (3000, 3000)  # labelled documents of class 1 and 0 that a fit reads at most
WIDTH = 4 * DIM
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_KIND = np.array([0 if c <= 32 or c == 127 else 1 if c >= 128 or chr(c).isalnum() or c == 95 else 2 for c in range(256)], dtype=np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint64)
_UPPER = np.array([65 <= c <= 90 for c in range(256)], dtype=np.int64)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, in order, and where each text's begin (one more entry than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    borders = np.cumsum([0] + [len(r) + 1 for r in raw])
    b = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
    kind = _KIND[b]
    starts = np.append(0, np.flatnonzero(kind[1:] != kind[:-1]) + 1)
    ends = np.append(starts[1:], len(b))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(len(b), _P))
        inverse = np.multiply.accumulate(np.full(len(b) + 1, _P_INVERSE))
        sums = np.append(np.uint64(0), np.cumsum(_LOWER[b] * powers))
        hashes = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    capitals = np.append(0, np.cumsum(_UPPER[b]))
    shouted = (capitals[ends] - capitals[starts] == ends - starts) & (ends - starts > 1)
    return scrambled(hashes ^ (shouted * _P)), np.searchsorted(starts, borders)


def random_vector(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, signs), ``SIGNS`` of each for every hash."""
    with np.errstate(over="ignore"):
        x = scrambled(hashes[:, None] + np.arange(1, SIGNS + 1, dtype=np.uint64) * _P)
    return (x % np.uint64(DIM)).astype(np.int64), np.where(x >> np.uint64(63), 1.0, -1.0)


def rows_of(hashes: np.ndarray) -> np.ndarray:
    """The ``WAYS`` rows of each word."""
    return np.stack([(hashes >> np.uint64(20 * k)) % np.uint64(ROWS) for k in range(WAYS)], axis=1).astype(np.int64)


def gathered(texts: list[str | None], total: np.ndarray) -> None:
    """Adds the contexts of all tokens of ``texts`` to ``total`` (ROWS, DIM + 1)."""
    hashes, begins = tokens(texts)
    if not len(hashes):
        return
    kinds, which = np.unique(hashes, return_inverse=True)
    columns, signs = random_vector(kinds)
    doc = np.repeat(np.arange(len(texts)), np.diff(begins))
    sums = np.zeros(len(kinds) * DIM)
    for o in range(1, REACH + 1):
        near = np.flatnonzero(doc[o:] == doc[:-o])
        for one, other in ((near, near + o), (near + o, near)):
            at = which[one][:, None] * DIM + columns[which[other]]
            sums += np.bincount(at.ravel(), weights=signs[which[other]].ravel(), minlength=len(sums))
    own = np.column_stack([sums.reshape(len(kinds), DIM), np.bincount(which)])
    for rows in rows_of(kinds).T:
        order = np.argsort(rows, kind="stable")
        at, first = np.unique(rows[order], return_index=True)
        total[at] += np.add.reduceat(own[order], first, axis=0)


def contexts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(ROWS, DIM + 1): sums of the neighbours' random vectors, and counts, over all documents."""
    small_batches(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, DIM + 1))
        for batch in batches:
            for some in _grouped(batch.column(0).to_pylist()):
                gathered(some, total)
        used = np.flatnonzero(total[:, DIM])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([x.tobytes() for x in total[used].astype(np.int64)], pa.binary())], names=["row", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums the rows that a task has; they are few, as there are at most ``ROWS`` different ones."""
        total = np.zeros((ROWS, DIM + 1), dtype=np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64).reshape(len(batch), -1))
        used = np.flatnonzero(total[:, DIM])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([x.tobytes() for x in total[used]], pa.binary())], names=["row", "sums"])

    schema = "row int, sums binary"
    parts = docs.select(F.col(text_col)).mapInArrow(gather, schema).repartition(16, "row").mapInArrow(add, schema).toArrow()  # ROWS rows
    out = np.zeros((ROWS, DIM + 1))
    if len(parts):
        out[parts["row"].to_numpy()] = np.frombuffer(b"".join(parts["sums"].to_pylist()), dtype=np.int64).reshape(len(parts), -1)
    return out


def _grouped(texts: list[str | None], chars: int = 500_000) -> Iterator[list[str | None]]:
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text or "")
        if size >= chars:
            yield own
            own, size = [], 0
    if own:
        yield own


class Vectors:
    """Word vectors read from the sketch."""

    def __init__(self, sums: np.ndarray):
        counts = sums[:, DIM]
        total = counts.sum()
        mean = sums[:, :DIM].sum(axis=0) / max(total, 1)
        x = sums[:, :DIM] - counts[:, None] * mean
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.table = (x / np.maximum(norm, 1e-9) * (counts / (counts + 5))[:, None]).astype(np.float32)
        self.counts = counts

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        rows = rows_of(hashes)
        return self.table[rows[np.arange(len(rows)), self.counts[rows].argmin(axis=1)]]


def pooled(texts: list[str | None], vectors: Vectors) -> np.ndarray:
    """Mean and spread of the token vectors, and of the steps between neighbours, for each text."""
    hashes, begins = tokens(texts)
    kinds, which = np.unique(hashes, return_inverse=True)
    v = vectors(kinds)[which]
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    sizes = np.diff(begins)
    some = np.flatnonzero(sizes)
    if len(some):
        step = np.abs(np.diff(v, axis=0, append=v[-1:]))
        step[begins[some + 1] - 1] = 0
        for k, x in enumerate((v, step)):
            n = np.maximum(sizes[some] - k, 1)[:, None].astype(np.float32)
            mean = np.add.reduceat(x, begins[some], axis=0, dtype=np.float64) / n
            square = np.add.reduceat(x * x, begins[some], axis=0, dtype=np.float64) / n
            out[some, 2 * k * DIM : (2 * k + 1) * DIM] = mean
            out[some, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


class Model:
    def __init__(self, vectors: Vectors, parts: dict):
        self.vectors, self.parts = vectors, parts

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.parts
        if "constant" in p:
            return np.full(len(x), p["constant"])
        x = (x - p["mean"]) / p["scale"]
        # a sum for each row by itself, as sums in blocks can differ in the last digit with the rows beside them
        return (np.tanh((x[:, :, None] * p["w1"]).sum(axis=1) + p["b1"]) * p["w2"]).sum(axis=1) + p["b2"]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = pooled(texts, self.vectors)
        logits = np.concatenate([self.logits(x[i : i + 256]) for i in range(0, len(x), 256)])
        return 1 / (1 + np.exp(-np.clip(logits / self.parts["temperature"], -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, steps: int = 600, decay: float = 1e-3) -> dict:
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    if len(y) == 0 or y.min() == y.max():
        return {"constant": np.log(share / (1 - share)), "temperature": 1.0}
    rng = np.random.default_rng(0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(())}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        h = np.tanh(x @ p["w1"] + p["b1"])
        e = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - y) / len(y)
        back = np.outer(e, p["w2"]) * (1 - h * h)
        grads = {"w1": x.T @ back + decay * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ e + decay * p["w2"], "b2": e.sum()}
        for k, g in grads.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean, "scale": scale, "temperature": 1.0}


def fit_temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature with the least weighted log loss, on a grid."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [(weight * np.logaddexp(0, np.where(y == 1, -1, 1) * logits / t)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: tuple[int, int] = SAMPLE) -> Model:
    vectors = Vectors(contexts(docs, text_col))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    picked = labels.select(F.col(id_col).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    picked = picked.withColumn("fold", fold(F.col("key")).cast("int")).where("fold <> 0").groupBy("key", "fold").agg(F.min("label").alias("label"))
    part = [picked.where(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(sample[1 - k]) for k in (0, 1)]
    small = F.broadcast(part[0].unionByName(part[1]))  # at most sum(sample) rows of three numbers

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [row.tolist() for some in _grouped(batch.column(1).to_pylist()) for row in pooled(some, sent.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32())), batch.column(2), batch.column(3)], names=["key", "x", "fold", "label"])

    own = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(small, "key").select("key", "text", "fold", "label")
    rows = own.mapInArrow(pool, f"key {own.schema['key'].dataType.simpleString()}, x array<float>, fold int, label int").dropDuplicates(["key"]).orderBy("key").collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), WIDTH)
    y, folds = np.array([r["label"] for r in rows], dtype=np.float64), np.array([r["fold"] for r in rows])
    main = folds != 1 if len(set(y[folds != 1])) == 2 else np.ones(len(y), dtype=bool)
    model = Model(vectors, fit_network(x[main], y[main]))
    rest = ~main if (~main).any() else main
    model.parts["temperature"] = fit_temperature(model.logits(x[rest]), y[rest], np.ones(int(rest.sum())))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col`` (a column of that name is replaced): the calibrated chance of label 1, from the whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        out = [sent.value.scores(some) for some in _grouped(text.to_pylist())]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn(out_col, scored(F.col(text_col)))
