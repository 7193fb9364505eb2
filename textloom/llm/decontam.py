"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are all windows of ``window`` consecutive words of every benchmark item; an item of fewer words is one
pattern.  Patterns of one length share a matcher: a shift table, indexed by a hash of blocks of two words, tells how far the search
may jump without missing an occurrence; a block with shift 0 leads to the chain of patterns that end in a block of that hash, and a
direct comparison of the words confirms.  Documents are read once, in place; there is no shuffle.

The driver builds the tables, flat arrays of about 60 bytes a benchmark word, and broadcasts them in blocks of at most ``block_words`` words, one block
a pass, so what a worker holds has a fixed bound (a longer item is cut into pieces that overlap by a window).

Words: A-Z lower-cased, maximal runs of a-z, 0-9 and non-ASCII characters.  Null or empty texts have no words and are
never contaminated; an empty benchmark contaminates nothing; repeated items and repeated documents each count for
themselves (a repeated item_id counts once).  The windows of an item without an id are searched and hit, but it is not counted or named among the items.
Other columns, whatever their names, are not carried.  Texts are searched whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, texts, unused

WINDOW = 10
BLOCK_WORDS = 1_000_000
_MIX = 0x9E3779B1
_SPACE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPACE).split()


class Matcher:
    """Wu-Manber over patterns that all have ``length`` words, given by the numbers of their words."""

    def __init__(self, patterns: np.ndarray, items: np.ndarray):
        """``patterns``: a row each; ``items``: the number of the item each is from."""
        n, self.length = patterns.shape
        self.block = min(2, self.length)
        self.far = self.length - self.block + 1
        rows = np.ascontiguousarray(patterns, dtype=np.int32)
        kinds, first, which = np.unique(rows.view(np.dtype((np.void, 4 * self.length))).ravel(), return_index=True, return_inverse=True)
        rows = rows[first]
        pairs = np.unique(np.stack([which.astype(np.int64), items.astype(np.int64)], axis=1), axis=0)
        self.words = array("i", rows.tobytes())
        self.owners, self.owned = array("i", pairs[:, 1].astype(np.int32).tobytes()), array("i", np.searchsorted(pairs[:, 0], np.arange(len(kinds) + 1)).astype(np.int32).tobytes())
        self.mask = (1 << max(8, (4 * n).bit_length())) - 1
        shift = np.full(self.mask + 1, min(self.far, 255), dtype=np.uint8)
        rows = rows.astype(np.int64)
        for end in range(self.block, self.length + 1):  # shifts fall, so the least stays
            hashed = self.hashed(rows[:, end - self.block], rows[:, end - 1])
            shift[hashed] = min(self.length - end, 255)
        self.shift = shift.tobytes()
        head, chain = np.full(self.mask + 1, -1, dtype=np.int32), np.empty(len(kinds), dtype=np.int32)
        order = np.argsort(hashed, kind="stable")
        own = hashed[order]
        last = np.append(own[1:] != own[:-1], True)
        chain[order] = np.where(last, -1, np.append(order[1:], -1))
        begins = np.append(True, last[:-1])
        head[own[begins]] = order[begins]
        self.head, self.chain = array("i", head.tobytes()), array("i", chain.tobytes())

    def hashed(self, a, b):
        return (a * _MIX + b) & self.mask

    def search(self, words: list[bytes], number: dict[bytes, int]) -> Iterator[tuple[int, int, array]]:
        """(start, end, items) of every occurrence, by end."""
        shift, head, chain, mask, length, known, n = self.shift, self.head, self.chain, self.mask, self.length, number.get, len(words)
        at = length - 1
        while at < n:
            b = known(words[at])
            if b is None:  # no window holds this word
                at += length
                continue
            if length == 1:
                hashed = self.hashed(b, b)
            else:
                a = known(words[at - 1])
                if a is None:
                    at += length - 1
                    continue
                hashed = (a * _MIX + b) & mask
            jump = shift[hashed]
            if jump:
                at += jump
                continue
            start = at - length + 1
            which = head[hashed]
            if which >= 0:
                found = [known(w, -1) for w in words[start : at + 1]]
                if -1 not in found:
                    found = array("i", found)
                    while which >= 0:
                        if self.words[which * length : (which + 1) * length] == found:
                            yield start, at + 1, self.owners[self.owned[which] : self.owned[which + 1]]
                        which = chain[which]
            at += 1


class Index:
    """The matchers of a block of benchmark items, and the numbers of their words."""

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int):
        number: dict[bytes, int] = {}
        rows: dict[int, tuple[list, list]] = {}
        for item, words in items:
            size = min(window, len(words))
            if size:
                own = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=len(words))
                patterns, owners = rows.setdefault(size, ([], []))
                patterns.append(np.lib.stride_tricks.sliding_window_view(own, size))
                owners.append(np.full(len(words) - size + 1, item, dtype=np.int32))
        self.known = list(number)
        self.matchers = [Matcher(np.concatenate(p), np.concatenate(o)) for _, (p, o) in sorted(rows.items())]
        self._number: dict[bytes, int] | None = None

    @property
    def number(self) -> dict[bytes, int]:
        if self._number is None:  # a worker makes it once for all of its tasks
            self._number = {w: n for n, w in enumerate(self.known)}
        return self._number

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, array]]:
        for matcher in self.matchers:
            yield from matcher.search(words, self.number)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Benchmark items in blocks of about ``block_words`` words; a longer item goes in pieces that overlap by ``window - 1`` words."""
    block, size = [], 0
    step = max(1, block_words)
    for key, text in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator(prefetchPartitions=True):
        words = words_of(text)
        for begin in range(0, max(1, len(words) - window + 1), step):
            piece = words[begin : begin + step + window - 1]
            if block and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            if piece:
                block.append((key, piece))
                size += len(piece)
    if block:
        yield block


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: ``id, text, n_words, spans array<struct<start,end>>, items array<string>`` (both sorted)."""
    spark = docs.sparkSession
    schema = "id {}, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>".format(
        docs.schema[id_col].dataType.simpleString()
    )
    rows = texts(docs, id_col, text_col).selectExpr(
        "id", "text", "0L as n_words", "cast(array() as array<struct<start:bigint,end:bigint>>) as spans", "cast(array() as array<string>) as items"
    )
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_words)
    block, earlier = next(blocks, []), None
    while True:
        sent = spark.sparkContext.broadcast(([key for key, _ in block], Index(((n, words) for n, (_, words) in enumerate(block)), window)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, index = sent.value
            for batch in batches:
                counts, spans, items = [], [], []
                for text, spans_were, items_were in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)), strict=True):
                    words = words_of(text)
                    found = [(x["start"], x["end"]) for x in spans_were]
                    owners: set[int] = set()
                    for start, end, which in index.search(words):
                        found.append((start, end))
                        owners.update(which)
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged(found)] if found else [])
                    items.append(sorted({names[n] for n in owners if names[n] is not None} | set(items_were)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                    names=batch.schema.names,
                )

        rows = rows.mapInArrow(scan, schema)
        block = next(blocks, None)
        if block is None and earlier is None:
            return rows
        rows = cut(rows, "decontam")  # one block's tables in a worker at a time
        discard(earlier)
        earlier = rows
        sent.unpersist()
        if block is None:
            return rows


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns are returned, and no row is moved."""
    others = [c for c in docs.columns if c != text_col]
    null = unused(docs, "_null")
    rows = docs.select(F.struct(*others, F.col(text_col).isNull().alias(null)).alias("row"), text_col)
    found = find(rows, benchmark, "row", text_col, **how).where(F.size("spans") == 0)
    text = F.when(~F.col("id")[null], F.col("text")).alias(text_col)
    return found.select(*(text if c == text_col else F.col("id")[c].alias(c) for c in docs.columns))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of :func:`find`'s rows."""
    return found.select(
        F.col("id").alias(id_col), "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
