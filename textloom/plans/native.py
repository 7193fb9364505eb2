"""Native lowering: a query whose reading is provably unique becomes Column expressions over one Java regular expression.

A pattern is lowered only if at every point the next character decides what to do: branches begin with different characters, a repetition without a
stop is followed by something that its items cannot begin with, and a stop ends its repetition at its first match.  Then
any way of matching gives the reading that the kernel would choose, there is no ambiguity to report, and all quantifiers can be
possessive (which also keeps the JVM's matcher iterative).  Whatever cannot be proven raises :class:`Cannot`, and the kernel is used.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.chars import JAVA, MARKS, java_literal
from . import shapes
from . import syntax as s
from .checks import Checker
from .shapes import Shape


class Cannot(Exception):
    """Why a query is not lowered."""


#: Characters as the analysis sees them: each ASCII character, and what else there is by kind.
_ASCII = frozenset(map(chr, range(128)))
_OTHER = frozenset(("letter", "mark", "number", "space", "sign"))
EVERY = _ASCII | _OTHER
END = "end of text"
_LETTERS = frozenset(c for c in _ASCII if c.isalpha()) | {"letter"}
_DIGITS = frozenset("0123456789")
_FIRST = {
    "WORD": _LETTERS, "LETTER": _LETTERS, "FLOAT": _DIGITS, "INT": _DIGITS, "DIGIT": _DIGITS, "IPV4": _DIGITS, "BIN": frozenset("01"),
    "HEX": frozenset("0123456789abcdefABCDEF"), "PUNCT": frozenset(c for c in _ASCII if not c.isalnum() and not c.isspace() or c in "\x1c\x1d\x1e\x1f") | {"sign", "mark"},
    "ANY": EVERY, "NL": frozenset("\r\n"), "TAB": frozenset("\t"), "LINE": EVERY - {"\r", "\n"},
}
_LAST = _FIRST | {"WORD": _LETTERS | {"mark"}, "LETTER": _LETTERS | {"mark"}}
_TOKENS = ("WORD", "INT", "FLOAT", "LETTER", "DIGIT", "PUNCT", "IPV4", "HEX", "BIN", "TAB", "NL")
#: Any text; and tokens as a search finds them, which takes each as long as it is, so that none begins inside another.
ALL = r"(?s:.)*+"
FOUND = {"WORD": rf"\p{{IsAlphabetic}}[\p{{IsAlphabetic}}{MARKS}]*+", "INT": "[0-9]++", "FLOAT": r"[0-9]++(?:\.[0-9]++)?+"}
_NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_SPACES = r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z"


def char_class(c: str) -> str:
    if ord(c) < 128:
        return c
    return "letter" if c.isalpha() else "number" if c.isnumeric() else "space" if c.isspace() else "sign"


Value = tuple[Column, Shape]


@dataclass
class Source:
    """A text column and the regular expression whose groups are read from it."""

    column: Column
    regex: str

    def group(self, n: int) -> Column:
        return F.regexp_extract(self.column, self.regex, n) if n else self.column


@dataclass
class Emitted:
    regex: str
    captures: dict[str, Callable[[Source], Value]] = field(default_factory=dict)
    worth: Callable[[Source], Value] | None = None


class Lowering:
    def __init__(self, checker: Checker, mode: dict[str, bool] | None = None):
        self.checker = checker
        self.mode = {"wide": False} if mode is None else mode  # shared with the lowerings inside
        self.groups = 0
        self.active: list[str] = []
        self.guards: list[Callable[[Source], Column]] | None = []

    # ---- characters

    def first(self, p: s.Pattern, seen: frozenset = frozenset()) -> frozenset:
        if isinstance(p, s.Literal):
            c = p.text[0]
            return frozenset(char_class(x) for x in ({c.lower(), c.upper(), c} if p.any_case else {c}) for x in x) | ({"letter"} if p.any_case and c.isalpha() else set())
        if isinstance(p, s.Primitive):
            return _FIRST.get(p.kind, frozenset() if p.kind == "EOF" else EVERY)
        if isinstance(p, s.Reference):
            if p.name in seen:
                raise Cannot(f"`{p.name}` is recursive")
            return self.first(self.target(p), seen | {p.name})
        if isinstance(p, s.Label):
            return self.first(p.inner, seen)
        if isinstance(p, s.Choice):
            return frozenset().union(*(self.first(b, seen) for b in p.branches))
        if isinstance(p, s.Sequence):
            out: frozenset = frozenset()
            for x in p.parts:
                out |= self.first(x, seen)
                if not self.checker.empty(x):
                    break
            return out
        out = self.first(p.item, seen) | (self.first(p.skipping, seen) if p.skipping else frozenset())
        return out | (self.first(p.stop, seen) if p.stop is not None else frozenset())

    def last(self, p: s.Pattern) -> frozenset:
        """Characters that can stand right before what follows ``p``."""
        if isinstance(p, s.Literal):
            return frozenset(char_class(x) for x in {p.text[-1], p.text[-1].lower(), p.text[-1].upper()} for x in x)
        if isinstance(p, s.Primitive):
            return _LAST.get(p.kind, EVERY)
        if isinstance(p, s.Reference):
            return self.last(self.target(p))
        if isinstance(p, s.Label):
            return self.last(p.inner)
        if isinstance(p, s.Choice):
            return frozenset().union(*(self.last(b) for b in p.branches))
        if isinstance(p, s.Sequence):
            out: frozenset = frozenset()
            for x in reversed(p.parts):
                out |= self.last(x)
                if not self.checker.empty(x):
                    break
            return out
        if p.stop is not None and p.consume:
            return self.last(p.stop)
        return self.last(p.item) | (self.last(p.separator) if p.separator else frozenset())

    def target(self, p: s.Reference) -> s.Pattern:
        return (self.checker.rules.get(p.name) or self.checker.aliases[p.name]).pattern

    # ---- one end at every position

    def one_end(self, p: s.Pattern) -> bool:
        """Whether ``p`` can end in one way at most, wherever it starts."""
        if isinstance(p, (s.Literal, s.Primitive)):
            return True
        if isinstance(p, s.Reference):
            return self.one_end(self.target(p))
        if isinstance(p, s.Label):
            return self.one_end(p.inner)
        if isinstance(p, s.Sequence):
            return all(map(self.one_end, p.parts))
        if isinstance(p, s.Choice):
            return all(map(self.one_end, p.branches)) and self.disjoint(p.branches)
        whole = self.one_end(p.item) and (p.separator is None or self.one_end(p.separator)) and p.skipping is None
        return whole and (p.stop is not None or p.least == p.most)

    def disjoint(self, branches) -> bool:
        seen: frozenset = frozenset()
        for b in branches:
            if self.checker.empty(b):
                return False
            own = self.first(b)
            if own & seen:
                return False
            seen |= own
        return True

    # ---- regular expressions; ``follow``: what may come next; ``before``: what may stand before

    def group(self) -> int:
        self.groups += 1
        return self.groups

    def emit(self, p: s.Pattern, follow: frozenset, before: frozenset, want: bool = False) -> Emitted:
        """``want``: the value of the part is needed, so its text gets a group."""
        if isinstance(p, (s.Literal, s.Primitive)):
            if isinstance(p, s.Literal):
                regex = java_literal(p.text, p.any_case)
            elif p.kind not in JAVA:
                raise Cannot(f"{p.kind} has no regular expression")
            elif p.kind == "FLOAT" and "." in before:
                raise Cannot("FLOAT after a dot depends on the digits before it")
            else:
                regex = JAVA[p.kind]
            if not want:
                return Emitted(f"(?:{regex})")
            n = self.group()
            shape = shapes.PRIMITIVES.get(p.kind, shapes.TEXT) if isinstance(p, s.Primitive) else shapes.TEXT
            return Emitted(f"({regex})", worth=lambda src: (src.group(n), shape))
        if isinstance(p, s.Reference):
            return self.reference(p, follow, before, want)
        if isinstance(p, s.Label):
            inner = self.labelled(p.inner, follow, before)
            return Emitted(inner.regex, {p.name: inner.worth}, lambda src: inner.worth(src))
        if isinstance(p, s.Repeat):
            return self.repeat(p, follow, before, want)
        return self.body(p, follow, before, want)

    def labelled(self, p: s.Pattern, follow: frozenset, before: frozenset) -> Emitted:
        """A label's value: the text of a repetition, otherwise what the pattern is worth."""
        if isinstance(p, s.Repeat):
            n = self.group()
            inner = self.repeat(p, follow, before, False, text=n)
            return Emitted(inner.regex, worth=lambda src: (src.group(n), shapes.TEXT))
        if isinstance(p, s.Label):
            own = self.emit(p, follow, before)
            return Emitted(own.regex, worth=lambda src: _record(src, own.captures))
        return self.emit(p, follow, before, True)

    def reference(self, p: s.Reference, follow: frozenset, before: frozenset, want: bool) -> Emitted:
        if p.name in self.checker.aliases:
            inner = self.emit(self.checker.aliases[p.name].pattern, follow, before)
            if not want:
                return Emitted(inner.regex)
            # a group around it, numbered after those inside, which an alias has none of
            n = self.group()
            return Emitted(f"({inner.regex})", worth=lambda src: (src.group(n), shapes.TEXT))
        rule = self.checker.rules[p.name]
        if rule.where is not None:
            raise Cannot(f"the WHERE of `{p.name}` takes part in the choice of a reading")
        worth, regex = self.rule(rule, follow, before)
        return Emitted(regex, {p.name: worth}, worth)

    def rule(self, rule: s.Rule, follow: frozenset, before: frozenset) -> tuple[Callable[[Source], Value], str]:
        if rule.name in self.active:
            raise Cannot(f"`{rule.name}` is recursive")
        self.active.append(rule.name)
        names = tuple(self.checker.rule_captures(rule))
        own = self.body(rule.pattern, follow, before, rule.template is None)
        self.active.pop()
        if rule.template is None:
            return own.worth, own.regex

        def worth(src: Source) -> Value:
            return self.template(rule.template, {n: own.captures[n](src) for n in names})

        return worth, own.regex

    def body(self, p: s.Pattern, follow: frozenset, before: frozenset, want: bool) -> Emitted:
        """A sequence, a choice or a single part, with the default value of its own scope if wanted."""
        if isinstance(p, s.Choice):
            return self.choice(p, follow, before, want)
        parts = p.parts if isinstance(p, s.Sequence) else (p,)
        sole = parts[0] if len(parts) == 1 else None
        value_of_sole = want and (isinstance(sole, s.Repeat) or isinstance(sole, s.Reference) and sole.name in self.checker.rules)
        named = bool(self.checker.captures(p))
        n = self.group() if want and not value_of_sole and not named else 0
        after = [follow] * len(parts)
        for i in range(len(parts) - 2, -1, -1):
            after[i] = self.first(parts[i + 1]) | (after[i + 1] if self.checker.empty(parts[i + 1]) else frozenset())
        captures: dict = {}
        regex = ""
        worth = None
        for part, then in zip(parts, after, strict=True):
            own = self.emit(part, then, before, value_of_sole)
            captures |= own.captures
            regex += own.regex
            worth = own.worth
            before = self.last(part) | (before if self.checker.empty(part) else frozenset())
        if not want:
            return Emitted(regex, captures)
        if value_of_sole:
            return Emitted(regex, captures, worth)
        if named:
            return Emitted(regex, captures, lambda src: _record(src, captures))
        return Emitted(f"({regex})", captures, lambda src: (src.group(n), shapes.TEXT))

    def choice(self, p: s.Choice, follow: frozenset, before: frozenset, want: bool) -> Emitted:
        if not self.disjoint(p.branches):
            raise Cannot("branches of an OR can begin with the same character")
        names = list(self.checker.captures(p))
        if want and names and any(set(self.checker.captures(b)) != set(names) for b in p.branches):
            raise Cannot("the value of an OR has other names in each branch")
        n = self.group() if want and not names else 0
        regexes, taken, owns = [], [], []
        for b in p.branches:
            g = self.group() if names else 0
            own = self.body(b, follow, before, False)
            regexes.append(f"({own.regex})" if names else own.regex)
            taken.append(g)
            owns.append(own)

        def pick(name: str) -> Callable[[Source], Value]:
            def worth(src: Source) -> Value:
                out, shape = None, None
                for g, own in zip(taken, owns, strict=True):
                    if name in own.captures:
                        column, kind = own.captures[name](src)
                        shape = kind if shape is None else shapes.unify(shape, kind)
                        test = src.group(g) != ""
                        out = F.when(test, column) if out is None else out.when(test, column)
                return out, shape

            return worth

        captures = {name: pick(name) for name in names}
        regex = "(?:" + "|".join(regexes) + ")"
        if not want:
            return Emitted(regex, captures)
        if names:
            return Emitted(regex, captures, lambda src: _record(src, captures))
        return Emitted(f"({regex})", captures, lambda src: (src.group(n), shapes.TEXT))

    def stop(self, p: s.Pattern) -> str:
        p = self.checker.resolved(p)
        if isinstance(p, s.Choice):
            parts = [self.checker.resolved(b) for b in p.branches]
            literals = [x for x in parts if isinstance(x, s.Literal)]
            others = [x for x in parts if not isinstance(x, s.Literal)]
            if literals and others or not literals and not self.disjoint([x for x in others if not (isinstance(x, s.Primitive) and x.kind == "EOF")]):
                if not self.disjoint([x for x in parts if not (isinstance(x, s.Primitive) and x.kind == "EOF")]):
                    raise Cannot("the longest stop depends on the text")
            ordered = sorted(literals, key=lambda x: -len(x.text)) + sorted(others, key=lambda x: isinstance(x, s.Primitive) and x.kind == "EOF")
            return "(?:" + "|".join(self.stop(x) for x in ordered) + ")"
        if isinstance(p, (s.Literal, s.Primitive)) and (isinstance(p, s.Literal) or p.kind in JAVA and p.kind != "FLOAT"):
            return java_literal(p.text, p.any_case) if isinstance(p, s.Literal) else JAVA[p.kind]
        if isinstance(p, s.Sequence) and self.one_end(p):
            return "".join(self.stop(x) for x in p.parts)
        raise Cannot("the stop is more than literals and primitives")

    def repeat(self, p: s.Repeat, follow: frozenset, before: frozenset, want: bool, text: int = 0) -> Emitted:
        """``text``: the group that takes the repetition's text without its stop."""
        names = list(self.checker.captures(p.item))
        if p.skipping is not None:
            return self.scan(p, follow, before, want, text, names)
        if p.most == 0:
            raise Cannot("a repetition that never runs")
        starts = self.first(p.item)
        inside = self.last(p.separator or p.item)
        if p.separator is not None:
            going_on = self.first(p.separator)
            if self.checker.empty(p.separator):
                raise Cannot("a separator can be empty")
        else:
            going_on = starts
        if p.stop is None and p.most == 1 and p.least == 0:
            if starts & follow:
                raise Cannot("what follows an optional part can begin like it")
        elif p.stop is None and p.least != p.most:
            clash = (going_on if p.least > 0 or p.separator is None else going_on | starts) & follow
            if clash or p.least == 0 and starts & follow:
                raise Cannot("what follows a repetition can begin like another item")
        if self.checker.empty(p.item) and p.separator is None:
            raise Cannot("an item can be empty")
        then = (going_on if p.most != 1 else frozenset()) | follow | (self.first(p.stop) | {END} if p.stop is not None else frozenset())
        single = p.single
        needs = want or bool(names)
        outer = text or (self.group() if needs else 0)
        stop = self.stop(p.stop) if p.stop is not None else None
        guard = f"(?!{stop})" if stop else ""
        if single and needs and not text:
            if self.checker.empty(p.item):
                raise Cannot("an optional part can be empty")
            own = self.emit(p.item, then, before, want)
            item = own.regex
            inner = self
        else:
            inner = Lowering(self.checker, self.mode)
            inner.active = list(self.active)
            inner.guards = None
            own = inner.emit(p.item, then, before | inside, want)
            item = _anonymous(own.regex)
        if p.separator is not None:
            plain = Lowering(self.checker, self.mode)
            separator = _anonymous(plain.emit(p.separator, starts, self.last(p.item)).regex)
            low, high = max(p.least - 1, 0), "" if p.most is None else p.most - 1
            regex = f"(?:{guard}{item})(?:{guard}{separator}{item}){{{low},{high}}}+"
            if p.least == 0:
                regex = f"(?:{regex})?+"
        else:
            separator = ""
            regex = f"(?:{guard}{item}){{{p.least},{'' if p.most is None else p.most}}}+"
        regex = f"({regex})" if outer else f"(?:{regex})"
        if stop:
            regex += f"(?>{stop})" if p.consume else f"(?={stop})"
        if text or not needs:
            return Emitted(regex, {} if not names else self.lists(p, outer, names, own, inner, item, separator))
        if single:
            def maybe(worth):
                def value(src: Source) -> Value:
                    column, shape = worth(src)
                    return F.when(src.group(outer) != "", column), shape

                return value

            return Emitted(regex, {n: maybe(own.captures[n]) for n in names}, maybe(own.worth) if want else None)
        return Emitted(regex, self.lists(p, outer, names, own, inner, item, separator), self.items(outer, own.worth, item, own.regex, separator) if want else None)

    def lists(self, p, outer, names, own, inner, item, separator) -> dict:
        if names and self.checker.optional_choice(p.item):
            raise Cannot("items of a repetition capture different names")
        return {n: self.items(outer, own.captures[n], item, own.regex, separator) for n in names}

    def items(self, outer: int, worth, item: str, with_groups: str, separator: str) -> Callable[[Source], Value]:
        """The list of the items' values, read from the repetition's text one item and separator at a time."""
        each = f"({item})(?:{separator})?+" if separator else f"({item})"

        def value(src: Source) -> Value:
            shape: list[Shape] = []

            def one(x: Column) -> Column:
                column, kind = worth(Source(x, rf"\A{with_groups}\z"))
                shape.append(kind)
                return column

            found = F.regexp_extract_all(src.group(outer), F.lit(each), F.lit(1))
            return F.transform(found, one), shapes.array(shape[0])

        return value

    def scan(self, p: s.Repeat, follow: frozenset, before: frozenset, want: bool, text: int, names: list[str]) -> Emitted:
        """``... SKIPPING ANY`` over all the rest of the text, with items that are single tokens: what a search for the token finds."""
        skip = self.checker.resolved(p.skipping)
        if not (isinstance(skip, s.Primitive) and skip.kind == "ANY") or p.separator or p.stop or p.most is not None or p.lazy or follow != {END} or before:
            raise Cannot("SKIPPING is lowered only as a search over the whole text")
        inner, rule, label = p.item, None, None
        while True:
            if isinstance(inner, s.Label) and label is None and rule is None:
                label, inner = inner.name, inner.inner
            elif isinstance(inner, s.Reference) and inner.name in self.checker.rules and rule is None:
                rule = self.checker.rules[inner.name]
                label = label or rule.name
                inner = rule.pattern
            else:
                break
        token = inner.inner if isinstance(inner, s.Label) else inner
        token = self.checker.resolved(token)
        if not (isinstance(token, s.Primitive) and token.kind in _TOKENS or isinstance(token, s.Literal)):
            raise Cannot("SKIPPING is lowered only around single tokens")
        if rule is not None and rule.where is not None and isinstance(token, s.Primitive) and token.kind == "IPV4":
            raise Cannot("another address can begin inside a rejected one")
        if isinstance(token, s.Literal):
            regex = java_literal(token.text, token.any_case)
            if rule is not None and rule.where is not None:
                raise Cannot("another match can begin inside a rejected one")
        else:
            regex = FOUND.get(token.kind) or JAVA[token.kind]
        kind = shapes.PRIMITIVES.get(token.kind, shapes.TEXT) if isinstance(token, s.Primitive) else shapes.TEXT
        lowering = Lowering(self.checker, self.mode)
        lowering.guards = None

        def environment(x: Column) -> dict[str, Value]:
            return {inner.name: (x, kind)} if isinstance(inner, s.Label) else {}

        def worth(x: Column) -> Value:
            if rule is None:
                return x, kind
            if rule.template is not None:
                return lowering.template(rule.template, environment(x))
            own = environment(x)
            return lowering.record(own) if own else (x, kind)

        def found(src: Source) -> Column:
            out = F.regexp_extract_all(src.column, F.lit(regex), F.lit(0))
            if rule is not None and rule.where is not None:
                with self.wide():
                    out = F.filter(out, lambda x: lowering.condition(rule.where, environment(x)))
            return out

        def value(src: Source) -> Value:
            if rule is None:
                return found(src), shapes.array(kind)
            shape: list[Shape] = []

            def one(x: Column) -> Column:
                column, own = worth(x)
                shape.append(own)
                return column

            out = F.transform(found(src), one)
            return out, shapes.array(shape[0])

        if text:
            raise Cannot("the text of a search is the whole text")
        if self.guards is None:
            raise Cannot("a search inside a repetition")
        if p.least > 0:
            if p.least == 1 and (rule is None or rule.where is None):
                self.guards.append(lambda src: src.column.rlike(regex))
            else:
                self.guards.append(lambda src: F.size(found(src)) >= p.least)
        return Emitted(ALL, {label: value} if label else {}, value)

    # ---- templates and conditions

    def record(self, values: dict[str, Value]) -> Value:
        return F.struct(*(c.alias(n) for n, (c, _) in values.items())), shapes.record({n: k for n, (_, k) in values.items()})

    def template(self, t: s.Template, names: dict[str, Value]) -> Value:
        if isinstance(t, s.Constant):
            v = t.value
            if v is None:
                return F.lit(None).cast("string"), shapes.NULL
            if isinstance(v, bool):
                return F.lit(v), shapes.BOOLEAN
            if isinstance(v, str):
                return F.lit(v), shapes.TEXT
            if isinstance(v, int) and v >= 1 << 63:
                raise Cannot("a constant beyond 64 bits")
            return (F.lit(v).cast("bigint"), shapes.INT) if isinstance(v, int) else (F.lit(v), shapes.FLOAT)
        if isinstance(t, s.Path):
            if t.names[0] not in names:
                raise Cannot(f"`{t.names[0]}` is known only at run time")
            column, shape = names[t.names[0]]
            for n in t.names[1:]:
                if shape.kind != "object":
                    raise Cannot("a field of a value without a fixed shape")
                column, shape = column[n], shape.field(n)
            return column, shape
        if isinstance(t, s.Call):
            return self.call(t, [self.template(a, names) for a in t.arguments])
        if isinstance(t, s.Array):
            parts, shape, plain = [], None, []
            for e in t.elements:
                if e.each is None:
                    column, own = self.template(e.value, names)
                    plain.append(column)
                else:
                    if plain:
                        parts.append(F.array(*plain))
                        plain = []
                    column, own = self.loop(e, names)
                    parts.append(column)
                shape = own if shape is None else shapes.unify(shape, own)
            if shape is None:
                raise Cannot("an empty list has no type")
            if shape == shapes.UNKNOWN or shape == shapes.NUMBER:
                raise Cannot("a list of values of different kinds")
            if plain:
                parts.append(F.array(*plain))
            return (parts[0] if len(parts) == 1 else F.concat(*parts)), shapes.array(shape)
        values: dict[str, Value] = {}
        for e in t.entries:
            if e.key is None or e.each is not None or e.collect or not isinstance(e.key, s.Constant) or not isinstance(e.key.value, str) or e.key.value in values:
                raise Cannot("an object whose keys depend on the text")
            values[e.key.value] = self.template(e.value, names)
        if not values:
            raise Cannot("an empty object has no type")
        return self.record(values)

    def loop(self, e: s.Element, names: dict[str, Value]) -> Value:
        each = e.each
        column, shape = names[each.variable] if each.source is None and each.variable in names else self.template(each.source or s.Path((each.variable,)), names)
        if shape.kind != "array":
            raise Cannot("FOR over a value that is not known to be a list")
        out: list[Shape] = []
        guards, self.guards = self.guards, None

        def one(x: Column) -> Column:
            inner = dict(names)
            if shape.item.kind == "object":
                inner |= {n: (x[n], k) for n, k in shape.item.fields}
            inner[each.variable] = (x, shape.item)
            value, kind = self.template(e.value, inner)
            out.append(kind)
            return value

        made = F.transform(column, one)
        self.guards = guards
        return F.coalesce(made, F.array()), out[0]

    @contextmanager
    def wide(self):
        """For conditions: they compare doubles, so whole numbers beyond 64 bits count too, which as values are null."""
        was, self.mode["wide"] = self.mode["wide"], True
        try:
            yield
        finally:
            self.mode["wide"] = was

    def number(self, column: Column, shape: Shape) -> Column | None:
        """As a double, null where the text is no number; None if the kind never is one."""
        if shape.kind in ("int", "float", "number"):
            return column.cast("double")
        if shape.kind in ("digits", "decimal"):
            return column.try_cast("double")
        if shape.kind in shapes.TEXTS:
            text = F.regexp_replace(column, _SPACES, "")
            return F.when(text.rlike(_NUMBER), text.try_cast("double"))
        return None

    def call(self, t: s.Call, own: list[Value]) -> Value:
        name, (x, shape) = t.function.upper(), own[0]
        text = shape.kind in shapes.TEXTS
        if name == "NUM":
            if shape.kind in ("int", "float", "number"):
                return x, shape
            if shape.kind == "digits":
                return (x.try_cast("double"), shapes.FLOAT) if self.mode["wide"] else (x.try_cast("bigint"), shapes.INT)
            if shape.kind == "decimal":
                return x.try_cast("double"), shapes.FLOAT
            raise Cannot("NUM of text that may be no number, or a whole one")
        if name in ("LOWER", "UPPER", "TRIM") and text:
            return {"LOWER": F.lower, "UPPER": F.upper, "TRIM": lambda c: F.regexp_replace(c, _SPACES, "")}[name](x), shapes.TEXT
        if name == "COUNT" and shape.kind == "array":
            return F.coalesce(F.size(x).cast("bigint"), F.lit(0).cast("bigint")), shapes.INT
        if name in ("FIRST", "LAST") and shape.kind == "array":
            return F.try_element_at(x, F.lit(1 if name == "FIRST" else -1)), shape.item
        if name == "JOIN" and own[1][1].kind in shapes.TEXTS and shape.kind == "array" and shape.item.kind in (*shapes.TEXTS, "int"):
            return F.call_function("array_join", x.cast("array<string>"), own[1][0]), shapes.TEXT
        if name == "JOIN" and text:
            return x, shapes.TEXT
        raise Cannot(f"{name} of {shape.kind}")

    def condition(self, c: s.Condition, names: dict[str, Value]) -> Column:
        if c.kind in ("and", "or"):
            a, b = (self.condition(p, names) for p in c.parts)
            return a & b if c.kind == "and" else a | b
        if c.kind == "not":
            return ~self.condition(c.parts[0], names)
        (a, x), *rest = [self.template(p, names) for p in c.parts]
        if c.kind == "truthy":
            if x.kind in shapes.TEXTS:
                return F.coalesce(a != "", F.lit(False))
            if x.kind == "array":
                return F.coalesce(F.size(a) > 0, F.lit(False))
            if x.kind in ("int", "float", "number", "object"):
                return a.isNotNull()
            raise Cannot(f"the truth of {x.kind}")
        b, y = rest[0]
        numeric = ("int", "float", "number")
        if c.operator in ("=", "!="):
            if x.kind in numeric or y.kind in numeric:
                m, n = self.number(a, x), self.number(b, y)
                if m is None or n is None:
                    raise Cannot("equality of values of different kinds")
                same = F.coalesce(m == n, F.lit(False))
            elif x.kind in shapes.TEXTS and y.kind in shapes.TEXTS or x.kind == "null" or y.kind == "null":
                same = a.eqNullSafe(b)
            else:
                raise Cannot("equality of lists or objects")
            return same if c.operator == "=" else ~same
        if c.operator in ("<", "<=", ">", ">="):
            sure = (*numeric, "digits", "decimal")
            if x.kind in sure and y.kind in sure:
                m, n = self.number(a, x), self.number(b, y)
            elif x.kind == "text" and isinstance(c.parts[1], s.Constant) and isinstance(c.parts[1].value, str) and not _is_number(c.parts[1].value):
                m, n = a, b
            else:
                raise Cannot("an order that may be of numbers, of texts, or an error")
            return {"<": m < n, "<=": m <= n, ">": m > n, ">=": m >= n}[c.operator]
        if x.kind in shapes.TEXTS and y.kind in shapes.TEXTS:
            test = {"CONTAINS": a.contains, "STARTSWITH": a.startswith, "ENDSWITH": a.endswith}[c.operator](b)
            return F.coalesce(test, F.lit(False))
        if c.operator == "CONTAINS" and x.kind == "array" and x.item.kind in shapes.TEXTS and y.kind in shapes.TEXTS:
            return F.coalesce(F.array_contains(a, b), F.lit(False))
        raise Cannot(f"{c.operator} of {x.kind} and {y.kind}")


def _is_number(text: str) -> bool:
    from ..functions.values import to_number

    return to_number(text) is not None


def _record(src: Source, captures: dict) -> Value:
    own = {n: worth(src) for n, worth in captures.items()}
    return F.struct(*(c.alias(n) for n, (c, _) in own.items())), shapes.record({n: k for n, (_, k) in own.items()})


def _anonymous(regex: str) -> str:
    """The same regular expression without capturing groups."""
    out, i, in_class = [], 0, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out.append(regex[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]":
            in_class -= 1
        out.append("(?:" if c == "(" and not in_class and regex[i + 1] != "?" else c)
        i += 1
    return "".join(out)


@dataclass
class Lowered:
    """A query as columns: whether a text matches, whether the condition holds, and the value."""

    regex: str
    matches: Callable[[Column], Column]
    holds: Callable[[Column], Column]
    value: Callable[[Column], Column]
    shape: Shape


def lower(checker: Checker, rule: s.Rule | None = None) -> Lowered:
    """Lower the root rule (or ``rule``) over whole texts; :class:`Cannot` says why not."""
    rule = rule or next(r for r in checker.query.rules if r.is_root)
    low = Lowering(checker)
    low.active.append(rule.name)
    own = low.body(rule.pattern, frozenset({END}), frozenset(), rule.template is None)
    regex = rf"\A{own.regex}\z"
    names = tuple(checker.captures(rule.pattern))

    def environment(column: Column) -> dict[str, Value]:
        src = Source(column, regex)
        return {n: own.captures[n](src) for n in names}

    def value(column: Column) -> Value:
        return own.worth(Source(column, regex)) if rule.template is None else low.template(rule.template, environment(column))

    def holds(column: Column) -> Column:
        out = F.lit(True)
        for g in low.guards or ():
            out = out & g(Source(column, regex))
        if rule.where is None:
            return out
        with low.wide():
            return out & low.condition(rule.where, environment(column))

    shape = value(F.col("text"))[1]
    holds(F.col("text"))
    plain = _anonymous(regex)
    matches = (lambda c: F.when(c.isNotNull(), F.lit(True))) if own.regex == ALL else (lambda c: c.rlike(plain))
    return Lowered(regex, matches, holds, lambda c: value(c)[0], shape)
