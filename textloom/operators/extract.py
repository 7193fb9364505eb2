"""Queries on DataFrames: typed columns, JSON text or variants, by native expressions where they are proven equal, else by the kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.json_text import to_json
from ..plans import native, shapes
from ..plans import syntax as s
from ..plans.checks import Checker
from ..plans.diagnostics import Problem, QueryError, RunError
from . import kernel
from .grammar import Grammar

ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
AMBIGUITY = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("rule", "chosen_value", "alternative_value", "failure", "advice")] + [T.StructField(n, T.LongType()) for n in ("start", "end", "other_start", "other_end")]))
REPEATED = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

#: Tasks of the kernel for each core; characters of texts whose results a task keeps, for texts that come again.
SPREAD, REMEMBERED = 4, 100_000


def conform(value, shape: shapes.Shape):
    """The value as its Spark type wants it; whole numbers beyond 64 bits are null."""
    if value is None:
        return None
    if shape.kind == "int":
        return value if isinstance(value, int) and -(1 << 63) <= value < 1 << 63 else None
    if shape.kind in ("float", "number"):
        return float(value)
    if shape.kind == "array":
        return [conform(x, shape.item) for x in value]
    if shape.kind == "map":
        return [(k, conform(v, shape.item)) for k, v in value.items()]
    if shape.kind == "object":
        return {n: conform(value.get(n), x) for n, x in shape.fields}
    return value


def remembered(read: Callable[[str], list], most: int = REMEMBERED) -> Callable[[str], list]:
    """``read`` with the results of the last texts kept, of some ``most`` characters in all; long texts are read each time."""
    known, room = {}, most

    def get(text: str) -> list:
        nonlocal room
        row = known.get(text)
        if row is None:
            row = read(text)
            if len(text) <= most // 16:
                room -= len(text) + 16
                if room < 0:
                    known.clear()
                    room = most
                known[text] = row
        return row

    return get


class Query:
    """A compiled query.  Immutable; it can be shared between threads and shipped to executors."""

    def __init__(self, source: str, checked: bool = True):
        self.source, self.checked = source, checked
        with kernel.deep_stack():
            self.tree = s.parse(source)
            checker = Checker(self.tree, source)
            problems = checker.check()
            if checked and any(p.severity == "error" for p in problems):
                raise QueryError(problems)
            self.warnings: list[Problem] = problems
            self.shape = checker.output_shape() if checked else None
        self._checker = checker
        self._grammar: Grammar | None = None

    def __reduce__(self):
        return Query, (self.source, self.checked)

    @property
    def grammar(self) -> Grammar:
        if self._grammar is None:
            with kernel.deep_stack():
                self._grammar = Grammar(self.tree, checker=self._checker if self.checked else None)
        return self._grammar

    @property
    def spark_type(self) -> T.DataType | None:
        """The type of the result, or None if it is given as JSON text only."""
        return shapes.spark_type(self.shape) if self.shape is not None else None

    def run(self, text: str, **options) -> kernel.Output:
        """Run on one text, here; a failed run raises :class:`RunError`."""
        return kernel.run(self.grammar, text, kernel.Options(**options))

    def check(self, sample: str | None = None) -> tuple[list[Problem], kernel.Output | None]:
        """Lints, and what a sample text shows: its output with all ambiguities and repeated keys."""
        if sample is None:
            return self.warnings, None
        return self.warnings, self.run(sample, ambiguity_steps=1 << 62)

    def lowered(self) -> native.Lowered:
        if not self.checked:
            raise native.Cannot("the query is not checked")
        with kernel.deep_stack():
            return native.lower(self._checker)

    def explain(self) -> str:
        """Which engine runs the query, and why."""
        try:
            self.lowered()
        except native.Cannot as why:
            return f"kernel: {why}"
        return "native"

    # ---- documents

    def extract(
        self, df: DataFrame, column: str = "text", output: str = "value", mode: str = "struct", on_error: str = "fail", engine: str = "auto",
        diagnostics: bool = False, **options,
    ) -> DataFrame:
        """``df`` with ``output``: one value for each text, which the query must match as a whole.

        ``mode``: struct (typed; JSON text where there is no one type), json (exact text, key order kept) or variant.
        ``on_error``: fail the job, ``null`` (and a column ``<output>_error``), or ``drop`` the row.  Null texts have null values.
        ``engine``: auto, native or kernel; JSON text and diagnostics come from the kernel.
        ``diagnostics`` adds ``<output>_ambiguities``, ``_repeated_keys``, ``_complete`` and ``_steps``.
        """
        if mode not in ("struct", "json", "variant") or on_error not in ("fail", "null", "drop") or engine not in ("auto", "native", "kernel"):
            raise ValueError("unknown mode, on_error or engine")
        typed = mode == "struct" and self.spark_type is not None
        if engine != "kernel" and typed and not diagnostics:
            try:
                return self._native(df, self.lowered(), F.col(column), output, on_error)
            except native.Cannot:
                if engine == "native":
                    raise
        elif engine == "native":
            raise native.Cannot("JSON text and diagnostics come from the kernel")
        out = self._kernel(df, column, output, typed, on_error, diagnostics, options)
        return out.withColumn(output, F.parse_json(output)) if mode == "variant" else out

    def _native(self, df: DataFrame, low: native.Lowered, text: Column, output: str, on_error: str) -> DataFrame:
        holds = F.coalesce(low.holds(text), F.lit(False))
        value = low.value(text).cast(self.spark_type)
        if on_error == "drop":
            return df.where(low.matches(text)).where(holds).withColumn(output, value)
        message = F.when(~low.matches(text), "the text does not match").otherwise("the text matches the patterns, but no reading satisfies the WHERE conditions")
        if on_error == "fail":
            return df.withColumn(output, F.when(low.matches(text) & holds, value).when(text.isNotNull(), F.raise_error(F.concat(F.lit("loom::input::no_parse: "), message))))
        error = F.struct(F.lit("loom::input::no_parse").alias("code"), message.alias("message"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
        ok = low.matches(text) & holds
        return df.withColumns({output: F.when(ok, value), f"{output}_error": F.when(text.isNotNull() & ~ok, error)})

    def _kernel(self, df: DataFrame, column: str, output: str, typed: bool, on_error: str, diagnostics: bool, options: dict) -> DataFrame:
        added = [T.StructField(output, self.spark_type if typed else T.StringType()), T.StructField(f"{output}_error", ERROR)]
        if diagnostics:
            added += [T.StructField(f"{output}_ambiguities", AMBIGUITY), T.StructField(f"{output}_repeated_keys", REPEATED), T.StructField(f"{output}_complete", T.BooleanType()), T.StructField(f"{output}_steps", T.LongType())]
        names = {f.name for f in added}
        kept = df.select(*(c for c in df.columns if c not in names or c == column))
        given = [c for c in kept.columns if c not in names]
        schema = T.StructType([*(f for f in kept.schema if f.name not in names), *added])
        source, checked, shape, place = self.source, self.checked, self.shape, kept.columns.index(column)
        kinds = [to_arrow_type(f.dataType) for f in added]

        if not diagnostics and not options.get("strict") and not any(r.strict for r in self.tree.rules):
            options = options | {"check_ambiguity": False}  # nobody would see what it finds
        if getattr(df, "_textloom_spread", None) is not True:  # rows are costly here and small on disk: one input split can hold them all
            kept = kept.repartition(SPREAD * df.sparkSession.sparkContext.defaultParallelism)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query = Query(source, checked)

            def read(text: str) -> list:
                row = [None] * len(added)
                try:
                    out = query.run(text, **options)
                except RunError as error:
                    if on_error == "fail":
                        raise
                    p = error.problems[0]
                    row[1] = {"code": p.code, "message": p.message, "start": p.start, "end": p.end}
                    return row
                row[0] = conform(out.value, shape) if typed else to_json(out.value)
                if diagnostics:
                    row[2] = [{"rule": a.rule, "chosen_value": a.chosen_value, "alternative_value": a.alternative_value, "failure": a.failure, "advice": a.advice, "start": a.chosen[0], "end": a.chosen[1], "other_start": a.alternative[0], "other_end": a.alternative[1]} for a in out.ambiguities]
                    row[3] = [{"key": k.key, "start": k.matched[0], "end": k.matched[1]} for k in out.repeated_keys]
                    row[4], row[5] = out.ambiguity_check_complete, out.steps
                return row

            nothing, known = [None] * len(added), remembered(read)
            for batch in batches:
                columns: list[list] = [[] for _ in added]
                for text in batch.column(place).to_pylist():
                    for values, x in zip(columns, nothing if text is None else known(text), strict=True):
                        values.append(x)
                own = [batch.column(batch.schema.get_field_index(c)) for c in given]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=schema.names)

        out = kept.mapInArrow(scan, schema)
        error = F.col(f"{output}_error")
        if on_error == "drop":
            out = out.where(error.isNull() & F.col(column).isNotNull()) if column in out.columns else out.where(error.isNull())
        out = out if on_error == "null" else out.drop(f"{output}_error")
        out._textloom_spread = True
        return out

    # ---- lines

    def record_rule(self) -> tuple[s.Rule, bool]:
        """The rule of one record, and whether other lines are skipped.

        Raises :class:`native.Cannot` unless the root is a repetition of records of exactly one line each.
        """
        checker = self._checker
        root = next(r for r in self.tree.rules if r.is_root)
        p = root.pattern
        if not isinstance(p, s.Repeat) or p.most is not None or p.lazy or p.separator or p.stop or root.template or root.where:
            raise native.Cannot("the root is not a plain repetition of records")
        skips = False
        if p.skipping is not None:
            skip = checker.resolved(p.skipping)
            if [getattr(x, "kind", "") for x in getattr(skip, "parts", ())] != ["LINE", "NL"]:
                raise native.Cannot("SKIPPING is something else than whole lines")
            skips = True
        item = p.item.inner if isinstance(p.item, s.Label) else p.item
        rule = checker.rules[item.name] if isinstance(item, s.Reference) and item.name in checker.rules else s.Rule("TEXT", item)
        parts = rule.pattern.parts if isinstance(rule.pattern, s.Sequence) else (rule.pattern,)
        last = checker.resolved(parts[-1])
        if not (isinstance(last, s.Primitive) and last.kind == "NL") or len(parts) < 2:
            raise native.Cannot("a record does not end with NL")
        rest = s.Sequence(parts[:-1]) if len(parts) > 2 else parts[0]
        if _within(rest, checker) & {"\r", "\n"}:
            raise native.Cannot("a record can run across lines")
        return rule, skips

    def lines(self, df: DataFrame, column: str = "value", output: str = "record", on_error: str = "fail") -> DataFrame:
        """``df`` holds one line of text a row (batch or stream); the result has one row a record, by native expressions only.

        Lines that are no records are dropped where the query skips lines; otherwise ``on_error`` says what becomes of them.
        """
        rule, skips = self.record_rule()
        low = native.lower(self._checker, rule)
        text = F.concat(F.col(column), F.lit("\n"))  # the line break that the source took away
        holds = F.coalesce(low.holds(text), F.lit(False))
        value = low.value(text).cast(shapes.spark_type(low.shape))
        if skips or on_error == "drop":
            return df.where(low.matches(text)).where(holds).withColumn(output, value)
        ok = low.matches(text) & holds
        if on_error == "fail":
            return df.withColumn(output, F.when(ok, value).when(text.isNotNull(), F.raise_error(F.lit("loom::input::no_parse: a line does not match"))))
        return df.withColumn(output, F.when(ok, value))


_ALL = {"WORD": native._LAST["WORD"], "LETTER": native._LAST["LETTER"], "FLOAT": native._DIGITS | {"."}, "IPV4": native._DIGITS | {"."}, "EOF": frozenset(), "ROW": frozenset(), "COL": frozenset()}


def _within(p: s.Pattern, checker: Checker, seen: frozenset = frozenset()) -> frozenset:
    """Characters that a match of ``p`` can hold."""
    if isinstance(p, s.Literal):
        return frozenset(c if ord(c) < 128 else "sign" for c in p.text)
    if isinstance(p, s.Primitive):
        return _ALL.get(p.kind, native._FIRST.get(p.kind, native.EVERY))
    if isinstance(p, s.Reference):
        if p.name in seen:
            raise native.Cannot(f"`{p.name}` is recursive")
        return _within((checker.rules.get(p.name) or checker.aliases[p.name]).pattern, checker, seen | {p.name})
    if isinstance(p, s.Label):
        return _within(p.inner, checker, seen)
    if isinstance(p, (s.Sequence, s.Choice)):
        return frozenset().union(*(_within(x, checker, seen) for x in (p.parts if isinstance(p, s.Sequence) else p.branches)))
    out = _within(p.item, checker, seen)
    for x in (p.separator, p.skipping):
        out |= _within(x, checker, seen) if x is not None else frozenset()
    if p.stop is not None:
        stop = checker.resolved(p.stop)
        options = [checker.resolved(b) for b in stop.branches] if isinstance(stop, s.Choice) else [stop]
        if any(isinstance(x, s.Primitive) and x.kind == "NL" for x in options):
            out -= {"\r", "\n"}
        out |= _within(p.stop, checker, seen) if p.consume else frozenset()
    return out


def compile(source: str) -> Query:
    """Compile a query; :class:`QueryError` lists all its problems."""
    return Query(source)


def compile_unchecked(source: str) -> Query:
    """Compile what the reader accepts, without the static checks: for tests that put the kernel to odd grammars."""
    return Query(source, checked=False)
