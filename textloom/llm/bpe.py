"""Byte-level BPE in DataFrame operations: ranked merges folded over the bytes of distinct words.

The rank map is a literal of the session (SQL variables): the ranks of all pairs of pieces that join to a piece, laid out so that looking
one up costs two array accesses.  A text is split by the tokenizer's pattern.  Words are counted in a sample, the texts whose hash is divisible by ``SAMPLED``; the most
frequent, all those of a count that leaves ``frequent`` at most, are folded once, and their ids become a second bounded literal, a table with two places for each
word; a word that is not there, whether the sample has it or not, is folded where it stands, by the same expression, so the sample decides on time alone: of the
array of a word's bytes the adjacent pieces with the lowest rank are merged, the leftmost first, until no two have a rank.

In the fold a piece is one number: the rank of the piece joined to the next one, the byte at which it begins, and its id, so that the least number is the
leftmost pair of the lowest rank.  In a word of more than ``LONG`` bytes a piece is one character (its id plus ``base``), so that an array of pieces is a string.  Such a
word is first cut where no piece of the vocabulary has the two bytes at the cut, as no merge can reach across; in a part that
is still long, a step merges all occurrences of the lowest pair at once if no pair of a lower rank arises between them (checked), so that runs
such as one letter repeated take few steps.

Decoding concatenates the pieces of the ids.

Null and empty texts have no ids.  Special tokens are ordinary text.  The result keeps one row per input row, repeated rows and null ids included; other
columns, whatever their names, are not carried.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, texts

RANKS = "byte_bpe_50k.tiktoken"
FREQUENT, COUNTS, LONG = 340_000, 4096, 200
#: Words are counted in one of so many texts.
SAMPLED = 4
#: An element of a short word's state: the rank of the piece joined to the next one, the byte at which the piece begins, its id.
ID, START, NO_RANK = (1 << 20) - 1, 0xFF << 20, 1 << 48
#: Letters and numbers of Unicode 16, which the tokenizer's pattern knows, that Unicode 13, which Java's classes know, lacks.
LETTERS = """870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3
A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3
10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389
1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F
13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF-18D08 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132
1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE
1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"""
NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


def java_pattern(pattern: str = public_tokenizers.PATTERN) -> str:
    """The tokenizer's pattern with Java's classes in place of its own."""

    def ranges(text: str) -> str:
        own = "".join("-".join(f"\\x{{{x}}}" for x in part.split("-")) for part in text.split())
        return rf"[\x{{870}}-\x{{3FFFF}}&&[{own}]]"  # one comparison settles the common characters

    own = {r"\p{L}": r"\p{L}" + ranges(LETTERS), r"\p{N}": r"\p{N}" + ranges(NUMBERS), r"\s": r"\p{IsWhite_Space}"}
    other = "".join(own.values())
    endings = pattern.split("| ?", 1)[0]
    if re.fullmatch(r"'\w+(\|'\w+)*", endings):  # branches that begin alike become one, in the same order
        pattern = "'(?:" + endings.replace("'", "") + ")" + pattern[len(endings) :]
    out = pattern.replace(r"[^\s\p{L}\p{N}]", "\0")
    out = out.replace(r"\S", f"[^{own[r'\s']}]")
    for name in own:
        out = out.replace(name, f"[{own[name]}]")
    return out.replace("\0", f"[^{other}]")


def load(path: str) -> dict[bytes, int]:
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: the last step of a fold over nothing, cheaper than a transform of an array made for it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def _variable(spark: SparkSession, name: str, values: pa.Array, kind: str) -> Column:
    """A fixed array as a session variable, which plans hold as a literal; plans made from it stay as they are when it is set anew or dropped."""
    name = f"textloom_{name}"
    spark.createDataFrame(pa.table({"v": pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)})).createOrReplaceTempView(f"{name}_view")
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} array<{kind}>")
    spark.sql(f"SET VAR {name} = (SELECT v FROM {name}_view)")
    spark.catalog.dropTempView(f"{name}_view")
    return F.expr(name)


class Literal:
    """A bounded table of words and their ids as a literal.  A word stands at one of two places that its hash names."""

    def __init__(self, rows: DataFrame, name: str):
        """``rows``: (word, ids, count), each word once."""
        table = rows.select("word", "ids", "count", F.xxhash64("word").alias("hash")).toArrow().sort_by([("count", "descending"), ("word", "ascending")])
        n = len(table)
        self.name, self.mask = name, (1 << max(4, (2 * n).bit_length())) - 1
        hashed = table["hash"].to_numpy().astype(np.int64)
        places = np.full(self.mask + 1, -1, dtype=np.int32)
        left = np.arange(n, dtype=np.int32)
        for spot in (hashed & self.mask, (hashed >> 32) & self.mask):
            free = left[places[spot[left]] < 0]
            _, first = np.unique(spot[free], return_index=True)
            places[spot[free[first]]] = free[first]
            left = np.setdiff1d(left, free[first])  # a word whose places are both taken is folded where it stands
        taken = pa.array(places, mask=places < 0)
        kinds = {"word": pa.string(), "ids": pa.list_(pa.int32())}
        entries = [table[k].cast(kind).combine_chunks().take(taken) for k, kind in kinds.items()]
        del table, hashed, taken
        entries = pa.StructArray.from_arrays(entries, fields=[pa.field(k, kind) for k, kind in kinds.items()], mask=pa.array(places < 0))
        self.table = _variable(rows.sparkSession, name, entries, "struct<word:string,ids:array<int>>")
        del entries
        pa.default_memory_pool().release_unused()

    def __call__(self, word: Column) -> Column:
        """The ids of ``word``, or null."""
        at = lambda h: let(F.get(self.table, h.bitwiseAND(F.lit(self.mask).cast("long")).cast("int")), lambda x: F.when(x["word"] == word, x["ids"]))
        return F.coalesce(at(F.xxhash64(word)), at(F.shiftright(F.xxhash64(word), 32)))

    def drop(self, spark: SparkSession) -> None:
        spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS textloom_{self.name}")


@lru_cache(2)
def rank_table(path: str) -> dict:
    """What the fold needs of a rank file.

    The pieces by id; ``base``, so that ``base + id`` is the character of a piece, and these characters; a modulus at which the CRCs of the single bytes differ, and the bytes by it;
    the characters of the bytes; by two bytes, whether they stand side by side in any piece; elements (see ``ID``) of single bytes; by two bytes, those of the
    first before the second; and the ranks of all pairs of pieces that join to a piece, by row displacement: at ``rows[a] + b`` the element of a before b, its start left out.
    """
    ranks = load(path)
    assert sorted(ranks.values()) == list(range(len(ranks))), "ranks are 0, 1, 2, ..."
    assert len(ranks) < ID, "ids have 20 bits"
    base = 0x801 if 0x801 + len(ranks) < 0xD800 else 0x10001  # the character before is the mark at both ends
    pieces = [b""] * len(ranks)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    crcs = [zlib.crc32(bytes([k])) for k in range(256)]
    modulus = next(m for m in range(256, 100_000) if len({c % m for c in crcs}) == 256)
    numbers = np.zeros(modulus, dtype=np.int32)
    numbers[[c % modulus for c in crcs]] = np.arange(256)
    beside = np.zeros(1 << 16, dtype=np.int32)
    rows: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            beside[piece[i - 1] << 8 | piece[i]] = 1
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = rank
    size = 3 * len(ranks) + 8 * sum(map(len, rows.values()))
    shift = np.zeros(len(ranks) + 1, dtype=np.int32)  # rows without entries, as that of the mark, whose id is the next one: nothing is theirs wherever they stand
    owner, value = np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
    free, hint = owner < 0, {}
    for left, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        rights = np.fromiter(row, dtype=np.int64)
        begin = hint.get(len(row).bit_length(), 0)  # rows of about this size did not fit before
        while True:  # the first place where all of the row's entries are free
            starts = np.arange(begin, begin + 512)
            fits = free[starts[:, None] + rights].all(axis=1)
            if fits.any():
                break
            begin += 512
        at = int(starts[np.argmax(fits)])
        hint[len(row).bit_length()] = max(0, at - 64)
        shift[left] = at
        owner[at + rights], value[at + rights], free[at + rights] = left, np.fromiter(row.values(), dtype=np.int32), False
    last = int(np.flatnonzero(~free).max(initial=0)) + 1
    characters = pa.array([chr(base + r) for r in range(len(ranks))])
    singles = [ranks[bytes([k])] for k in range(256)]
    elements = np.where(owner[:last] < 0, -1, value[:last].astype(np.int64) << 28 | owner[:last])
    single = [NO_RANK | r for r in singles]
    two = [(ranks[bytes([i, j])] << 28 | singles[i]) if bytes([i, j]) in ranks else single[i] for i in range(256) for j in range(256)]
    arrays = {
        "pieces": (pa.array(pieces, pa.binary()), "binary"), "numbers": (pa.array(numbers), "int"), "singles": (pa.array([chr(base + r) for r in singles]), "string"),
        "beside": (pa.array(beside), "int"), "characters": (characters, "string"), "single": (pa.array(single), "bigint"), "two": (pa.array(two), "bigint"),
        "rows": (pa.array(shift), "int"), "elements": (pa.array(elements), "bigint"),
    }
    return {"base": base, "mark": len(ranks), "modulus": modulus, "arrays": arrays}


class Ranks:
    """The rank map of a tokenizer as literals, and the fold over them."""

    NONE = "\U0010ffff"  # the rank of two pieces that do not join

    def __init__(self, spark: SparkSession, path: str):
        t = rank_table(path)
        self.base, self.modulus, self.mark, self.mark_id = t["base"], t["modulus"], F.lit(chr(t["base"] - 1)), t["mark"]
        label = f"{zlib.crc32(path.encode()):08x}"
        for name, (values, kind) in t["arrays"].items():
            setattr(self, name, _variable(spark, f"{name}_{label}", values, kind))
        self.pieces = self.pieces.cast("array<string>")

    def rank(self, a: Column, b: Column) -> Column:
        """The character of two pieces joined, or ``NONE``."""
        left, right = F.ascii(a) - self.base, F.ascii(b) - self.base
        found = let(F.get(self.elements, F.get(self.rows, left) + right), lambda x: F.when(x.bitwiseAND(long(ID)) == left, F.get(self.characters, F.shiftright(x, 28).cast("int"))))
        return F.coalesce(found, F.lit(self.NONE))

    def state(self, ids: Column, ranks: Column) -> Column:
        """``ids`` between two marks, the ranks of its neighbours, and the lowest of them."""
        return let(ranks, lambda r: F.struct(ids.alias("ids"), r.alias("ranks"), F.array_min(F.split(r, "")).alias("low")))

    def begin(self, ids: Column) -> Column:
        """The state of pieces ``ids``, marks included."""

        def all_ranks(c: Column) -> Column:
            return F.array_join(F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x, i: self.rank(x, F.get(c, i + 1))), "")

        return self.state(ids, let(F.split(ids, ""), all_ranks))

    def one(self, s: Column) -> Column:
        """``s`` after the leftmost lowest pair is merged."""
        rest = 1 << 30

        def merged(p: Column) -> Column:
            ids, ranks, new = s["ids"], s["ranks"], s["low"]
            after = F.substring(ids, p + 2, F.lit(rest))
            around = (self.rank(F.substring(ids, p - 1, F.lit(1)), new), self.rank(new, F.substring(after, 1, 1)))
            return self.state(F.concat(F.substring(ids, F.lit(1), p - 1), new, after), F.concat(F.substring(ranks, F.lit(1), p - 2), *around, F.substring(ranks, p + 2, F.lit(rest))))

        return let(F.instr(s["ranks"], s["low"]), merged)

    def all(self, s: Column) -> Column:
        """``s`` after all occurrences of the lowest pair are merged, if that is what merging them one by one gives; else as :meth:`one`."""

        def tried(p: Column) -> Column:
            first = F.substring(s["ids"], p, F.lit(1))
            new = self.begin(F.replace(s["ids"], F.substring(s["ids"], p, F.lit(2)), s["low"]))
            return let(new, lambda t: F.when((t["low"] > s["low"]) & (self.rank(s["low"], first) > s["low"]), t).otherwise(self.one(s)))

        return let(F.instr(s["ranks"], s["low"]), tried)

    def merged(self, begin: Column, size: Column, step) -> Column:
        """The ids after all merges."""
        done = F.aggregate(F.sequence(F.lit(1), size), begin, lambda s, _: F.when(s["low"] == self.NONE, s).otherwise(step(s)))
        return let(done["ids"], lambda x: F.transform(F.split(F.substring(x, F.lit(2), F.length(x) - 2), ""), lambda c: F.ascii(c) - self.base))

    def short_begin(self, numbers: Column) -> Column:
        """The state of a word of ``LONG`` bytes at most: the elements of its bytes between two marks."""
        of = F.transform(numbers, lambda x, i: F.coalesce(F.get(self.two, x * 256 + F.get(numbers, i + 1)), F.get(self.single, x)) + F.shiftleft(i.cast("long"), 20))
        mark = F.array(long(NO_RANK | self.mark_id))
        return F.concat(mark, of, mark)

    def short_one(self, s: Column) -> Column:
        """``s`` after the leftmost lowest pair is merged; the lowest element names it, as starts follow ranks."""
        id_of = lambda x: x.bitwiseAND(long(ID)).cast("int")
        entry = lambda a, b, body: let(F.get(self.elements, F.get(self.rows, a) + b), body)
        same = lambda x, a: x.bitwiseXOR(a).bitwiseAND(long(ID)) == 0

        def merged(low: Column, p: Column) -> Column:  # the pair stands at p - 1 and p, from 0
            new = F.shiftright(low, 28)
            before = lambda a: entry(id_of(a), new.cast("int"), lambda x: F.when(same(x, a), x).otherwise(a.bitwiseAND(long(ID)).bitwiseOR(long(NO_RANK)))).bitwiseOR(a.bitwiseAND(long(START)))
            joined = entry(new.cast("int"), id_of(F.get(s, p + 1)), lambda x: F.when(same(x, new), x).otherwise(new.bitwiseOR(long(NO_RANK)))).bitwiseOR(low.bitwiseAND(long(START)))
            rest = F.filter(s, lambda x, i: i != p)
            return F.transform(rest, lambda x, i: F.when(x == low, joined).when(i == p - 2, before(x)).otherwise(x))

        return let(F.array_min(s), lambda low: F.when(low >= long(NO_RANK), s).otherwise(let(F.array_position(s, low).cast("int"), lambda p: merged(low, p))))

    def short(self, numbers: Column, size: Column) -> Column:
        """The ids of a word of ``LONG`` bytes at most."""
        done = F.aggregate(F.sequence(F.lit(2), size), self.short_begin(numbers), lambda s, _: self.short_one(s))
        return let(done, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(long(ID)).cast("int")))

    def numbers_of(self, word: Column) -> Column:
        """The bytes of a binary as numbers."""
        return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.get(self.numbers, (F.crc32(F.substring(word, i, F.lit(1))) % self.modulus).cast("int")))

    def parts(self, numbers: Column) -> Column:
        """The characters of bytes in parts between which no merge can reach."""
        apart = lambda x, i: F.get(self.beside, x * 256 + F.get(numbers, i + 1)) == 0
        return F.split(F.array_join(F.transform(numbers, lambda x, i: F.when(apart(x, i), F.concat(F.get(self.singles, x), F.lit(" "))).otherwise(F.get(self.singles, x))), ""), " ")

    def fold(self, text: Column) -> Column:
        """The ids of a word (not empty): its bytes, merged by rank, the leftmost of the lowest first."""
        word = text.cast("binary")
        numbers = F.when(F.length(text) == F.length(word), F.transform(F.split(text, ""), F.ascii)).otherwise(self.numbers_of(word))
        begin = lambda x: self.begin(F.concat(self.mark, x, self.mark))
        part = lambda x: F.when(F.length(x) <= LONG, self.merged(begin(x), F.length(x), self.one)).otherwise(self.merged(begin(x), F.length(x), self.all))
        parts = let(numbers, lambda c: F.flatten(F.transform(self.parts(c), part)))
        return F.when(F.length(word) > LONG, parts).otherwise(let(numbers, lambda c: self.short(c, F.size(c))))


class Tokenizer:
    """Encodes and decodes with the ranks of a file that the driver reads."""

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str = public_tokenizers.PATTERN, frequent: int = FREQUENT):
        self.spark, self.frequent, self.pattern = spark, frequent, java_pattern(pattern)
        self.ranks = Ranks(spark, path or public_tokenizers.path(RANKS))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, text, ids)`` for every row."""
        rows = texts(docs, id_col, text_col)
        sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
        counted = cut(sample.select(F.explode(self.words(F.col("text"))).alias("word")).groupBy("word").count(), "bpe-words")
        n = F.when(F.col("count") < COUNTS, F.col("count")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("count"))).cast("long"))
        by_count = counted.groupBy(n.alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()  # COUNTS + 64 rows at most
        least, total = 1 << 62, 0
        for n, words in by_count:
            if total + words > self.frequent:
                break
            least, total = n, total + words
        chosen = counted.where((F.col("count") >= least) & (F.length("word") <= LONG))
        known = Literal(chosen.select("word", self.ranks.fold(F.col("word")).alias("ids"), "count"), f"frequent_{uuid.uuid4().hex[:8]}")
        ids = F.flatten(F.transform(self.words(F.col("text")), lambda w: F.coalesce(known(w), self.ranks.fold(w))))
        out = rows.select("id", "text", ids.alias("ids"))
        known.drop(self.spark)  # the plan has the values
        discard(counted)
        return out

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids."""
        return F.array_join(F.transform(ids, lambda i: F.get(self.ranks.pieces, i)), "").cast("binary")


def digest(encoded: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(tokenizer.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )
