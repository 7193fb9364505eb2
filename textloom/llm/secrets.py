"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame operations only.

Every version of every file is one row (``path``, ``text``); its blob is the SHA-256 of the text.  The ledger (:class:`Ledger`, a Parquet table in a
folder that all machines share) holds for each blob the rule versions already scanned, with the findings.  A run takes the digests of
all rows, looks up which (blob, rule version) pairs the ledger lacks, scans those once each, however many paths have the blob, appends them to the ledger, and
joins the findings of old and new pairs back to all paths.  A rule whose meaning changes has another version, so its pairs are scanned
anew and its old findings no longer count.  A run that fails has appended nothing, one that is repeated scans nothing twice.

Rules are Java regular expressions without matches of no characters; matches of a rule are leftmost and do not overlap, and a match whose
checked group is too short is dropped without another try.  Positions are code points, end exclusive.  They come from
the lengths of the matches and of the pieces between them.  Null texts count as empty; empty tables give empty results; repeated rows
and rows with a null path each get their blob's findings; other columns, whatever their names, are not carried (``redact`` returns them as they are).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, exists, remove, shared_path, texts, unused


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0  # the group whose length is checked
    least: int = 1
    base: bool = True

    @property
    def version(self) -> str:
        """Changes whenever the rule's meaning does, so that changed rules are scanned anew."""
        return f"{self.kind}@{hashlib.sha256(repr((self.regex, self.group, self.least)).encode()).hexdigest()[:12]}"


#: Fixed patterns.  A run of hex digits (and of AKIA...) that is too short fails as a whole, so the least length can stand in the regex.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/= \t\r\n:,\\]*(?:-[A-Za-z0-9+/= \t\r\n:,\\]+){0,8}-----END [A-Z ]{0,40}PRIVATE KEY-----)?", base=False),
)
FINDINGS = "array<struct<start:int,kind:string,end:int>>"
LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,found:struct<start:int,kind:string,end:int>>>"


class Ledger:
    """The pairs of blob and rule version already scanned: a table at ``path``, to which each run appends its own."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        """``path`` must be in a folder that all machines share; without one, the ledger is a new one of the session's shared folder."""
        self.spark, self.path = spark, path or shared_path(spark, "secret-ledger")

    def read(self) -> DataFrame | None:
        """The rows so far; None before the first run."""
        return self.spark.read.schema(LEDGER).parquet(self.path) if exists(self.spark, self.path) else None

    def append(self, fresh: DataFrame) -> None:
        fresh.write.mode("append").parquet(self.path)

    def forget(self) -> None:
        remove(self.spark, self.path)


def matches(text: Column, rule: Rule) -> Column:
    """All accepted matches of ``rule`` in ``text``, by position."""
    regex = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    checked = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.regex, -1)
    parts = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), checked, lambda x, c: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.length(c).alias("checked")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {FINDINGS})").alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        hit = F.array(F.struct(begin.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["checked"] >= rule.least, F.concat(state["found"], hit)).otherwise(state["found"]).alias("found"))

    return F.when(text.rlike(rule.regex), F.aggregate(parts, start, step)["found"]).otherwise(F.expr(f"cast(array() as {FINDINGS})"))


def blobs_of(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, blob, text) of every row."""
    return texts(versions, path_col, text_col).select(F.col("id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("blob"), "text")


def scan(rows: DataFrame, seen: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, digests: DataFrame | None = None) -> DataFrame:
    """New ledger rows for the pairs of blob and rule version of ``rows`` (blob, text) that ``seen`` lacks; ``digests``: the blobs of ``rows``, if they are at hand."""
    every = F.array(*(F.lit(r.version) for r in rules))
    if seen is None:
        todo = rows.select("blob", "text", every.alias("todo"))
    else:  # digests first: texts move only where something is to be scanned
        known = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        lacking = F.array_except(every, F.coalesce("known", F.expr("cast(array() as array<string>)")))
        wanted = (rows if digests is None else digests).select("blob").distinct().join(known, "blob", "left").select("blob", lacking.alias("todo")).where(F.size("todo") > 0)
        todo = rows.select("blob", "text").join(wanted, "blob")
    todo = todo.dropDuplicates(["blob"])
    of = lambda r: F.transform(matches(F.col("text"), r), lambda x: F.struct(F.lit(r.version).alias("rule"), x.alias("found")))
    each = [F.when(F.array_contains("todo", r.version), of(r)) for r in rules]
    return todo.select("blob", F.col("todo").alias("rules"), F.flatten(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("findings"))


def by_blob(known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of ledger rows for the blobs with findings of ``rules``, sorted by start, then by the order of ``rules``."""
    order = F.create_map(*(x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))))
    own = F.transform(F.filter("findings", lambda x: x["rule"].isin([r.version for r in rules])), lambda x: x["found"])
    some = known.select("blob", own.alias("findings")).where(F.size("findings") > 0)
    ranked = F.array_sort(F.flatten(F.collect_list("findings")), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(order[a["kind"]] - order[b["kind"]]))
    return some.groupBy("blob").agg(ranked.alias("findings"))


def update(versions: DataFrame, ledger: Ledger, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, digests: DataFrame | None = None) -> DataFrame:
    """One run: scans what ``ledger`` lacks, appends it there, and returns ``(blob, findings)`` of the blobs with findings, written to the shared folder."""
    ledger.append(scan(blobs_of(versions, path_col, text_col), ledger.read(), rules, digests))
    return cut(by_blob(ledger.read(), rules), "secrets")


def findings(versions: DataFrame, ledger: Ledger, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(path, blob, findings)`` for every row, after a run over ``ledger``.

    The join moves digests, not texts, and stands alone, so that a blob with very many paths can be split among tasks (skew join).
    """
    paths = blobs_of(versions, path_col, text_col).select("path", "blob")
    if ledger.read() is not None:  # the digests are needed twice
        paths = cut(paths, "digests")
        found = update(versions, ledger, path_col, text_col, rules, paths)
    else:
        found = update(versions, ledger, path_col, text_col, rules)
    joined = paths.join(found, "blob", "left")
    return joined.select("path", "blob", F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")).alias("findings"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one); other columns and rows without findings stay as they are.

    Findings come back by blob, so rows with a null or repeated id are redacted too.
    """
    own = ledger or Ledger(docs.sparkSession)
    digest_, blob, spans = (unused(docs, n) for n in ("_own", "_blob", "_found"))
    found = update(docs, own, id_col, text_col, rules).select(F.col("blob").alias(blob), F.col("findings").alias(spans))
    if ledger is None:
        own.forget()
    some = F.coalesce(reduce(Column.__or__, (F.col(text_col).rlike(r.regex) for r in rules)), F.lit(False))  # others have no findings, and need not move
    rows = docs.where(some).withColumn(digest_, F.sha2(F.col(text_col).cast("binary"), 256))
    rows = rows.join(found, F.col(digest_) == F.col(blob), "left")
    text = F.col(text_col)

    def step(state, x):
        gap = F.substring(text, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        new = F.when(x["start"] >= state["at"], F.concat(state["out"], F.array(gap, F.lit(mark)))).otherwise(state["out"])
        return F.struct(F.greatest(x["end"], state["at"]).alias("at"), new.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    clean = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    rows = rows.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(clean)).select(*docs.columns)
    return docs.where(~some).unionByName(rows)


def _of_kinds(kinds: list[str]):
    return lambda x: x["kind"].isin(kinds)


def digest(found: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES, kept: tuple[str, ...] = ()) -> DataFrame:
    def joined(xs: Column) -> Column:
        return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = [r.kind for r in rules if r.base]
    return found.select(
        F.col("path").alias(id_col),
        *(F.size(F.filter("findings", _of_kinds([k]))).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(F.filter("findings", _of_kinds(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        *kept,
    )
