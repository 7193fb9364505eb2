"""From the syntax tree to what the kernel walks: nodes with branches of steps, and repetitions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions import chars
from ..plans import syntax as s
from ..plans.checks import Checker
from ..plans.straight import Proof


@dataclass(eq=False)
class Step:
    """One part of a branch: a terminal or a node, and the capture it makes."""

    match: Callable | None = None
    kind: str = ""  # of a terminal: the primitive's name, or literal
    node: Node | None = None
    capture: str | None = None
    labelled: bool = False
    described: str = ""
    run: Callable | None = None  # of characters up to a stop, taken as one terminal: where the stop begins
    ends: Callable | None = None  # of a repeated terminal, taken as one with many ends: all of them; ``match`` gives the last
    final: bool = False  # of such a repetition: whether only the end of the text can follow it
    shortest: bool = False  # of such a repetition: whether it is LAZY

    @property
    def lazy(self) -> bool:
        return self.shortest or self.node is not None and self.node.kind == "repeat" and self.node.repeat.lazy

    def names(self) -> tuple[str, ...]:
        """The captures that this step can make in its scope, in order."""
        if self.capture:
            return (self.capture,)
        if self.node is None or self.node.kind in ("alias", "rule"):
            return ()
        if self.node.kind == "repeat":
            return self.node.item.names()
        return self.node.names()


@dataclass(eq=False)
class Node:
    kind: str  # rule, alias, group, repeat
    name: str = ""
    branches: list[list[Step]] = field(default_factory=list)
    rule: s.Rule | None = None
    repeat: s.Repeat | None = None
    item: Step | None = None
    separator: Step | None = None
    skipping: Step | None = None
    stop: Callable | None = None  # (text, position) -> ends
    stop_described: str = ""
    straight: bool = False  # whether it can end in one way only, and be read in one way
    wanted: bool = True  # of a repetition: whether anybody asks for its items
    _height: int | None = None

    _names: tuple[str, ...] | None = None

    def names(self) -> tuple[str, ...]:
        if self._names is None:
            self._names = tuple(dict.fromkeys(n for b in self.branches for x in b for n in x.names()))
        return self._names

    def height(self) -> int:
        """How many rules nest in it at most, if it is not recursive."""
        if self._height is None:
            steps = [x for b in self.branches for x in b] + [x for x in (self.item, self.separator) if x is not None]
            self._height = (self.kind == "rule") + max((x.node.height() for x in steps if x.node is not None), default=0)
        return self._height


class Grammar:
    def __init__(self, query: s.Query, fuse: bool = True, checker: Checker | None = None):
        """``fuse``: take characters up to a stop in one step where nobody asks for them one by one.

        ``checker``: of a checked query; then what has one reading only is read straight on.
        """
        self.query, self.fuse, self._plain = query, fuse, None
        self.proof = Proof(checker) if checker is not None and fuse else None
        self.referenced: set[str] = set()
        self.rules = {r.name: Node("rule", r.name, rule=r) for r in query.rules}
        self.aliases = {a.name: Node("alias", a.name) for a in query.aliases}
        self.patterns = {a.name: a.pattern for a in query.aliases}
        for r in query.rules:
            self.rules[r.name].branches = self.body(r.pattern)
            if r.is_root:
                self.root = self.rules[r.name]
            self.rules[r.name].straight = r.where is None and self.one_end(r.pattern)
        for a in query.aliases:
            self.aliases[a.name].branches = self.body(a.pattern)
            self.aliases[a.name].straight = self.one_end(a.pattern)
        if self.root.name not in self.referenced:
            for branch in self.root.branches:
                branch[-1].final = branch[-1].ends is not None
        self.straight = self.proof is not None and self.proof.whole(self.root.rule.pattern)

    @property
    def plain(self) -> Grammar:
        """The same grammar character by character, which can explain where a text went wrong."""
        if self._plain is None:
            self._plain = Grammar(self.query, False) if self.fuse else self
        return self._plain

    def one_end(self, p: s.Pattern) -> bool:
        return self.proof is not None and self.proof.one_end(p)

    def group(self, p: s.Pattern) -> Node:
        return Node("group", branches=self.body(p), straight=self.one_end(p))

    def body(self, p: s.Pattern) -> list[list[Step]]:
        if isinstance(p, s.Choice):
            return [self.parts(b) for b in p.branches]
        return [self.parts(p)]

    def parts(self, p: s.Pattern) -> list[Step]:
        parts = p.parts if isinstance(p, s.Sequence) else (p,)
        if len(parts) == 1:
            return [self.step(p)]
        return [self.fused(x) if self.fusible(x) else self.spanned(x) if self.spannable(x) else self.step(x) for x in parts]

    def fusible(self, p: s.Pattern) -> bool:
        if not self.fuse or not isinstance(p, s.Repeat) or p.stop is None or p.least or p.most is not None or p.separator or p.skipping:
            return False
        item = p.item
        while isinstance(item, s.Reference) and item.name in self.patterns:
            item = self.patterns[item.name]
        return isinstance(item, s.Primitive) and item.kind == "ANY"

    def fused(self, p: s.Repeat) -> Step:
        stop = self.stop(p.stop)
        literal = p.stop.text if isinstance(p.stop, s.Literal) and not p.stop.any_case else None

        def begins(text, i):
            if literal is not None:
                at = text.text.find(literal, i)
                return None if at < 0 else at
            return next((j for j in range(i, len(text.text) + 1) if stop(text, j)), None)

        def match(text, i):
            at = begins(text, i)
            return None if at is None else max(stop(text, at)) if p.consume else at

        return Step(match, "run", described=s.show_pattern(p.stop, True), run=begins)

    def spannable(self, p: s.Pattern) -> bool:
        """Whether ``p`` repeats one kind of character: its ends follow from where it starts."""
        return self.fuse and isinstance(p, s.Repeat) and p.stop is None and p.separator is None and p.skipping is None and self.character(p.item) is not None

    def character(self, p: s.Pattern) -> s.Primitive | None:
        while isinstance(p, s.Reference) and p.name in self.patterns:
            p = self.patterns[p.name]
        return p if isinstance(p, s.Primitive) and p.kind in chars.CHARACTERS else None

    def spanned(self, p: s.Repeat) -> Step:
        primitive = self.character(p.item)
        one, several = chars.MATCH[primitive.kind], chars.repeated(primitive.kind, p.least, p.most)
        least, most = p.least, p.most

        def ends(text, i):
            out, n = [], 0
            while True:
                if n >= least:
                    out.append(i)
                if n == most:
                    return out
                i = one(text, i)
                if i is None:
                    return out
                n += 1

        return Step(several, "span", described=primitive.kind, ends=ends, shortest=p.lazy)

    def step(self, p: s.Pattern) -> Step:
        if isinstance(p, s.Literal):
            return Step(chars.literal(p.text, p.any_case), "literal", described=s.show_pattern(p))
        if isinstance(p, s.Primitive):
            return Step(chars.MATCH[p.kind], p.kind, described=p.kind)
        if isinstance(p, s.Reference):
            if p.name in self.rules:
                self.referenced.add(p.name)
                return Step(node=self.rules[p.name], capture=p.name)
            return Step(node=self.aliases[p.name])
        if isinstance(p, s.Label):
            if self.fusible(p.inner):
                inner = self.fused(p.inner)
            elif self.spannable(p.inner):
                inner = self.spanned(p.inner)
            elif isinstance(p.inner, (s.Label, s.Sequence, s.Choice)):
                inner = Step(node=self.group(p.inner))
            else:
                inner = self.step(p.inner)
                if isinstance(p.inner, s.Repeat):
                    inner.node.wanted = False  # its text is the value
            inner.capture, inner.labelled = p.name, True
            return inner
        if isinstance(p, s.Repeat):
            node = Node("repeat", repeat=p, item=self.step(p.item), straight=self.one_end(p))
            node.separator = self.step(p.separator) if p.separator else None
            node.skipping = self.step(p.skipping) if p.skipping else None
            if p.stop is not None:
                node.stop, node.stop_described = self.stop(p.stop), s.show_pattern(p.stop, True)
            return Step(node=node)
        return Step(node=self.group(p))

    def stop(self, p: s.Pattern) -> Callable:
        """All ends of a stop at a position."""
        if isinstance(p, s.Reference):
            return self.stop(self.patterns[p.name])
        if isinstance(p, (s.Literal, s.Primitive)):
            match = chars.literal(p.text, p.any_case) if isinstance(p, s.Literal) else chars.MATCH[p.kind]

            def one(text, i):
                end = match(text, i)
                return () if end is None else (end,)

            return one
        if isinstance(p, s.Choice):
            branches = [self.stop(b) for b in p.branches]
            return lambda text, i: {e for b in branches for e in b(text, i)}
        if isinstance(p, s.Sequence):
            parts = [self.stop(x) for x in p.parts]

            def chain(text, i):
                at = {i}
                for part in parts:
                    at = {e for j in at for e in part(text, j)}
                    if not at:
                        break
                return at

            return chain
        item, least, most = self.stop(p.item), p.least, p.most

        def repeated(text, i):
            at, out, n = {i}, set(), 0
            if least == 0:
                out.add(i)
            while at and (most is None or n < most):
                at = {e for j in at for e in item(text, j)}
                n += 1
                if n >= least:
                    at -= out
                    out |= at
            return out

        return repeated
