"""The matching kernel: recognise, choose one reading, evaluate it, and look for readings that would change the output.

Recognition explores each (node, position) once from a work list, so left and deep recursion need no stack; what it finds is a
graph of configurations whose edges are the matches of steps.  Choosing walks that graph in the order of preference, depth first,
over the edges from which the wanted end can be reached, and remembers the choice for each (node, start, end).

What is proven to have one reading at most (``plans.straight``), a whole query or parts of it, is read straight on instead, without a graph.
"""

from __future__ import annotations

import sys
from collections import deque
from contextlib import contextmanager
from dataclasses import dataclass, field

from ..functions import values
from ..functions.chars import Text, _BREAK
from ..functions.json_text import same, to_json
from ..functions.values import EvalError
from ..plans import syntax as s
from ..plans.diagnostics import Problem, RunError
from .grammar import Grammar, Node, Step

MAX_REPORTS, MAX_EXPECTED = 20, 8


@dataclass(frozen=True)
class Options:
    max_steps: int = 200_000_000
    max_depth: int = 10_000
    strict: bool = False
    check_ambiguity: bool = True
    ambiguity_steps: int = 5_000_000


class _Call:
    """A node at a position: its configurations, the edges between them, and where it can end."""

    __slots__ = ("node", "at", "edges", "back", "ends", "accepts", "by_end", "waiting")

    def __init__(self, node: Node, at: int):
        self.node, self.at = node, at
        self.edges: dict[tuple, list] = {}  # configuration -> [(order, end, next configuration, step, role)]
        self.back: dict[tuple, list] = {}  # configuration -> those with an edge to it
        self.accepts: dict[tuple, int] = {}  # configuration -> end
        self.by_end: dict[int, list] = {}  # end -> configurations
        self.ends: set[int] = set()
        self.waiting: list = []  # (call, configuration, order, next, step, role)


class Part:
    """A step of a chosen reading: from ``i`` to ``j``."""

    __slots__ = ("step", "role", "i", "j", "tree")

    def __init__(self, step: Step | None, role: str, i: int, j: int, tree: Tree | None):
        self.step, self.role, self.i, self.j, self.tree = step, role, i, j, tree


class Tree:
    __slots__ = ("node", "i", "j", "branch", "parts", "value", "known", "inner_end")

    def __init__(self, node: Node, i: int, j: int, branch: int, parts: list[Part], inner_end: int):
        self.node, self.i, self.j, self.branch, self.parts, self.inner_end = node, i, j, branch, parts, inner_end
        self.known, self.value = False, None

    def branch_index(self, starts: list[tuple]) -> int:
        return next((k for k, c in enumerate(starts) if c[0] == self.branch), len(starts))


@dataclass
class Ambiguity:
    rule: str
    chosen: tuple[int, int]
    alternative: tuple[int, int]
    chosen_value: str
    alternative_value: str | None
    failure: str | None
    advice: str  # branch_order, stop_crossed_lines, more_specific_pattern
    strict: bool


@dataclass
class RepeatedKey:
    key: str
    entry: tuple[int, int]
    matched: tuple[int, int]


@dataclass
class Output:
    value: object
    ambiguities: list[Ambiguity] = field(default_factory=list)
    repeated_keys: list[RepeatedKey] = field(default_factory=list)
    ambiguity_check_complete: bool = False
    steps: int = 0


def nesting(tree: Tree) -> int:
    """How many rules nest in a reading."""
    return (tree.node.kind == "rule") + max((nesting(p.tree) for p in tree.parts if p.tree is not None), default=0)


class _Stop(Exception):
    """The ambiguity check ran out of its own budget."""


class _TooDeep(Exception):
    pass


class Kernel:
    """One run of a grammar on one text."""

    def __init__(self, grammar: Grammar, text: str, options: Options):
        self.grammar, self.text, self.options = grammar, Text(text), options
        self.steps, self.limit, self.quiet = 0, options.max_steps, False
        self.calls: dict[tuple, _Call] = {}
        self.work: list = []
        self.chosen: dict[tuple, Tree | None] = {}
        self.trees: dict[tuple, Tree | None] = {}  # of parts that are read straight on, by node and start
        self.live_sets: dict[tuple, set] = {}
        self.far, self.expected = -1, {}
        self.repeated: dict[int, RepeatedKey] = {}
        self.reporting = False

    def spend(self, n: int = 1) -> None:
        self.steps += n
        if self.steps > self.limit:
            if self.quiet:
                raise _Stop
            raise RunError([Problem("loom::input::too_expensive", f"matching took more than {self.options.max_steps} steps", 0, min(1, len(self.text.text)), "make the pattern more specific, or raise max_steps", source="input")])

    # ---- recognition

    def recognise(self) -> _Call:
        root = self.call(self.grammar.root, 0)
        work = self.work
        while work:
            call, config = work.pop()
            self.spend()
            self.explore(call, config)
        return root

    def call(self, node: Node, at: int) -> _Call:
        key = (node, at)
        call = self.calls.get(key)
        if call is None:
            call = self.calls[key] = _Call(node, at)
            if node.kind == "repeat":
                self.reach(call, (0, 0, at))
            else:
                for b in range(len(node.branches) - 1, -1, -1):
                    self.reach(call, (b, 0, at))
        return call

    def reach(self, call: _Call, config: tuple) -> None:
        if config not in call.edges:
            call.edges[config] = []
            self.work.append((call, config))

    def explore(self, call: _Call, config: tuple) -> None:
        node, (a, b, at) = call.node, config
        if node.kind != "repeat":
            branch = node.branches[a]
            if b == len(branch):
                self.accept(call, config, at)
            else:
                self.take(call, config, 0, branch[b], (a, b + 1), "part")
            return
        r = node.repeat
        full = r.most is not None and a >= r.most
        stops = node.stop(self.text, at) if node.stop and b == 0 else ()
        if b == 0 and a >= r.least:
            if node.stop is None:
                self.accept(call, config, at)
            elif stops:
                self.accept(call, config, max(stops) if r.consume else at)
            else:
                self.miss(at, node.stop_described, call)
        if b == 0 and r.most == 0:
            pass
        elif b == 1 or not full and not stops:
            more = min(a + 1, max(r.least, 1)) if r.most is None else a + 1
            if b == 0 and node.separator is not None and a > 0:
                self.take(call, config, 0, node.separator, (a, 1), "separator")
            else:
                self.take(call, config, 0, node.item, (more, 0), "item")
        if node.skipping is not None:
            self.take(call, config, 1, node.skipping, (a, b), "skip")

    def take(self, call: _Call, config: tuple, order: int, step: Step, to: tuple, role: str) -> None:
        at = config[2]
        if step.ends is not None:
            if step.final:
                size = len(self.text.text)
                ends = (size,) if step.match(self.text, at) == size else ()
                self.spend(1 + (size - at) // 8)
            else:
                ends = step.ends(self.text, at)
                self.spend(len(ends))
            for end in ends:
                self.link(call, config, order, end, to, step, role)
            return
        if step.match is not None:
            end = step.match(self.text, at)
            if end is None:
                self.miss(len(self.text.text) if step.run else at, step.described, call)
            else:
                if step.run:
                    self.spend(1 + (end - at) // 8)
                self.link(call, config, order, end, to, step, role)
            return
        if step.node.straight:
            tree = self.straight_part(step.node, at)
            if tree is not None:
                self.link(call, config, order, tree.j, to, step, role)
            return
        child = self.call(step.node, at)
        child.waiting.append((call, config, order, to, step, role))
        for end in tuple(child.ends):
            self.link(call, config, order, end, to, step, role)

    def link(self, call: _Call, config: tuple, order: int, end: int, to: tuple, step: Step, role: str) -> None:
        following = (*to, end)
        call.edges[config].append((order, end, following, step, role))
        call.back.setdefault(following, []).append(config)
        self.reach(call, following)

    def accept(self, call: _Call, config: tuple, end: int) -> None:
        call.accepts[config] = end
        call.by_end.setdefault(end, []).append(config)
        if end not in call.ends:
            call.ends.add(end)
            for waiter, was, order, to, step, role in call.waiting:
                self.spend()
                self.link(waiter, was, order, end, to, step, role)

    def miss(self, at: int, described: str, call: _Call) -> None:
        if at >= self.far:
            if at > self.far:
                self.far, self.expected = at, {}
            rules = self.expected.setdefault(described, [])
            if call.node.kind == "rule" and call.at == at and not call.node.rule.is_root and call.node.name not in rules:
                rules.append(call.node.name)

    # ---- what has one reading at most

    def straight_part(self, node: Node, at: int) -> Tree | None:
        key = (node, at)
        if key not in self.trees:
            self.trees[key] = self.straight(node, at, True)
        return self.trees[key]

    def straight(self, node: Node, at: int, all_parts: bool) -> Tree | None:
        """The only reading of ``node`` from ``at``; ``all_parts``: with the items of repetitions that nobody asks for."""
        if node.kind == "repeat":
            return self.straight_repeat(node, at, all_parts)
        text = self.text
        for b, branch in enumerate(node.branches):
            self.spend(1 + len(branch))
            parts, here = [], at
            for step in branch:
                if step.match is not None:
                    end = step.match(text, here)
                    if end is None:
                        break
                    if step.run is not None or step.ends is not None:
                        self.spend((end - here) // 8)
                    parts.append(Part(step, "part", here, end, None))
                else:
                    tree = self.straight(step.node, here, all_parts)
                    if tree is None:
                        break
                    end = tree.j
                    parts.append(Part(step, "part", here, end, tree))
                here = end
            else:
                return Tree(node, at, here, b, parts, here)
        return None

    def straight_repeat(self, node: Node, at: int, all_parts: bool) -> Tree | None:
        text, r, stop, separator = self.text, node.repeat, node.stop, node.separator
        keep = all_parts or node.wanted or bool(node.item.names())
        parts: list[Part] = []
        n, here = 0, at
        while r.most is None or n < r.most:
            if stop is not None and stop(text, here):
                break
            self.spend()
            begin, between = here, None
            if n and separator is not None:
                between = self.straight_step(separator, here, all_parts)
                if between is None:
                    break
                begin = between[0]
            item = self.straight_step(node.item, begin, all_parts)
            if item is None:
                break
            if keep:
                if between is not None:
                    parts.append(Part(separator, "separator", here, begin, between[1]))
                parts.append(Part(node.item, "item", begin, *item))
            here = item[0]
            n += 1
        if n < r.least:
            return None
        end = here
        if stop is not None:
            ends = stop(text, here)
            if not ends:
                return None
            if r.consume:
                end = max(ends)
                parts.append(Part(None, "stop", here, end, None))
        return Tree(node, at, end, 0, parts, here)

    def straight_step(self, step: Step, at: int, all_parts: bool) -> tuple[int, Tree | None] | None:
        if step.match is not None:
            end = step.match(self.text, at)
            return None if end is None else (end, None)
        tree = self.straight(step.node, at, all_parts)
        return None if tree is None else (tree.j, tree)

    # ---- choosing

    def live(self, call: _Call, end: int) -> set:
        """Configurations from which the node can still end at ``end``."""
        key = (call.node, call.at, end)
        out = self.live_sets.get(key)
        if out is None:
            out = set(call.by_end.get(end, ()))
            work, back = list(out), call.back
            while work:
                for config in back.get(work.pop(), ()):
                    if config not in out:
                        out.add(config)
                        work.append(config)
            self.spend(len(out))
            self.live_sets[key] = out
        return out

    def options_at(self, call: _Call, config: tuple, end: int, live: set) -> list:
        """What can follow ``config``, most preferred first; None stands for ending here."""
        edges = call.edges[config]
        if len(edges) <= 1 and config not in call.accepts:
            return edges if edges and edges[0][2] in live else []
        by_order: dict[int, list] = {}
        for e in edges:
            if e[2] in live:
                by_order.setdefault(e[0], []).append(e)
        out: list = []
        for order in sorted(by_order):
            own = by_order[order]
            if len(own) > 1:
                own.sort(key=lambda e: e[1], reverse=not own[0][3].lazy)
            out.extend(own)
        if call.accepts.get(config) == end:
            if call.node.kind == "repeat" and call.node.repeat.lazy:
                out.insert(0, None)
            else:
                out.append(None)
        return out

    def starts(self, call: _Call, live: set) -> list[tuple]:
        if call.node.kind == "repeat":
            return [c for c in ((0, 0, call.at),) if c in live]
        return [c for c in ((b, 0, call.at) for b in range(len(call.node.branches))) if c in live]

    def best(self, node: Node, i: int, j: int, depth: int) -> Tree | None:
        if node.straight:
            tree = self.straight_part(node, i)
            if tree is None or tree.j != j:
                return None
            if depth + node.height() > self.options.max_depth and depth + nesting(tree) > self.options.max_depth:
                raise _TooDeep
            return tree
        key = (node, i, j)
        if key in self.chosen:
            return self.chosen[key]
        if node.kind == "rule":
            depth += 1
            if depth > self.options.max_depth:
                raise _TooDeep
        call = self.calls[node, i]
        live = self.live(call, j)
        self.chosen[key] = None
        out = None
        for start in self.starts(call, live):
            out = self.walk(call, j, live, start, [], depth)
            if out is not None:
                break
        self.chosen[key] = out
        return out

    def walk(self, call: _Call, end: int, live: set, config: tuple, parts: list[Part], depth: int, dead: set | None = None) -> Tree | None:
        """The first path from ``config`` on to ``end`` whose children can be read and whose condition holds."""
        dead = set() if dead is None else dead
        rejected = 0  # paths that only the condition turned down
        stack = [(config, iter(self.options_at(call, config, end, live)), rejected)]
        on_path = {config}
        base = len(parts)
        while stack:
            config, options, before = stack[-1]
            option = next(options, False)
            if option is False:
                stack.pop()
                on_path.discard(config)
                if rejected == before:
                    dead.add(config)
                if len(parts) > base:
                    parts.pop()
                continue
            self.spend()
            if option is None:
                own = list(parts)
                if call.node.stop is not None and call.node.repeat.consume:
                    own.append(Part(None, "stop", config[2], end, None))
                tree = Tree(call.node, call.at, end, config[0] if call.node.kind != "repeat" else 0, own, config[2])
                if self.holds(tree):
                    return tree
                rejected += 1
                continue
            _, to, following, step, role = option
            if following in dead or following in on_path:
                continue
            child = None
            if step.node is not None:
                child = self.best(step.node, config[2], to, depth)
                if child is None:
                    continue
            parts.append(Part(step, role, config[2], to, child))
            on_path.add(following)
            stack.append((following, iter(self.options_at(call, following, end, live)), rejected))
        return None

    def holds(self, tree: Tree) -> bool:
        if tree.node.kind != "rule" or tree.node.rule.where is None:
            return True
        was, self.reporting = self.reporting, False
        try:
            return self.condition(tree.node.rule.where, self.environment(tree))
        except EvalError as error:
            raise self.failed(error, tree) from None
        finally:
            self.reporting = was

    def failed(self, error: EvalError, tree: Tree) -> RunError:
        start, end = getattr(error, "place", (tree.node.rule.start, tree.node.rule.end))
        related = (("input", tree.i, tree.j, f"`{tree.node.name}` matched this"),)
        return RunError([Problem("loom::eval::error", str(error), start, end, None, "while evaluating this", related=related)])

    # ---- values

    def captures(self, parts: list[Part]) -> dict:
        out: dict = {}
        for p in parts:
            if p.role == "part" or p.role == "item":
                self.capture(p, out)
        return out

    def capture(self, p: Part, out: dict) -> None:
        step = p.step
        if step.capture:
            out[step.capture] = self.worth(p)
        elif p.tree is not None and p.tree.node.kind == "group":
            out.update(self.captures(p.tree.parts))
        elif p.tree is not None and p.tree.node.kind == "repeat":
            names = p.tree.node.item.names()
            if names:
                items = [self.captures([x]) for x in p.tree.parts if x.role == "item"]
                for n in names:
                    if p.tree.node.repeat.single:
                        out[n] = items[0].get(n) if items else None
                    else:
                        out[n] = [x[n] for x in items if n in x]

    def worth(self, p: Part):
        """The value of a part that is captured, or is an item."""
        if p.tree is None:
            if p.step.kind == "ROW":
                return self.text.row(p.i)
            if p.step.kind == "COL":
                return self.text.column(p.i)
            if p.step.run:
                return self.text.text[p.i : p.step.run(self.text, p.i)]
            return self.text.text[p.i : p.j]
        kind = p.tree.node.kind
        if kind == "rule":
            return self.rule_value(p.tree)
        if kind == "group":
            return self.default(p.tree)
        if kind == "repeat":
            return self.text.text[p.tree.i : p.tree.inner_end] if p.step.labelled else self.items(p.tree)
        return self.text.text[p.i : p.j]

    def items(self, tree: Tree):
        out = [self.worth(p) for p in tree.parts if p.role == "item"]
        if tree.node.repeat.single:
            return out[0] if out else None
        return out

    def default(self, tree: Tree):
        branch = tree.node.branches[tree.branch]
        if len(branch) == 1:
            step = branch[0]
            if step.node is not None and not step.labelled and step.node.kind in ("repeat", "rule"):
                return self.items(tree.parts[0].tree) if step.node.kind == "repeat" else self.rule_value(tree.parts[0].tree)
        if any(x.names() for x in branch):
            return self.captures(tree.parts)
        if len(branch) == 1 and branch[0].node is not None and branch[0].node.kind == "group":
            return self.default(tree.parts[0].tree)
        return self.text.text[tree.i : tree.j]

    def environment(self, tree: Tree) -> dict:
        return dict.fromkeys(tree.node.names()) | self.captures(tree.parts)

    def rule_value(self, tree: Tree):
        if not tree.known:
            self.spend(1 + len(tree.parts))
            template = tree.node.rule.template
            if template is None:
                tree.value = self.default(tree)
            else:
                try:
                    tree.value = self.template(template, self.environment(tree), tree)
                except EvalError as error:
                    raise self.failed(error, tree) from None
            tree.known = True
        return tree.value

    def template(self, t: s.Template, names: dict, tree: Tree | None):
        self.spend()
        if isinstance(t, s.Constant):
            return t.value
        try:
            if isinstance(t, s.Path):
                value = names.get(t.names[0])
                for n, field_name in enumerate(t.names[1:], 1):
                    if value is not None and not isinstance(value, dict):
                        raise EvalError(f"`{'.'.join(t.names[:n])}` is {values.kind(value)}, which has no fields")
                    value = value.get(field_name) if value is not None else None
                return value
            if isinstance(t, s.Call):
                arguments = [self.template(a, names, tree) for a in t.arguments]
                return values.call(t.function.upper(), arguments, lambda k: self.again(k, t, tree))
            if isinstance(t, s.Array):
                out = []
                for e in t.elements:
                    if e.each is None:
                        out.append(self.template(e.value, names, tree))
                    else:
                        out.extend(self.template(e.value, inner, tree) for inner in self.iterate(e.each, names, tree))
                return out
            made: dict = {}
            collected: set = set()
            for e in t.entries:
                if e.key is None:
                    value = self.template(e.value, names, tree)
                    for item in value if isinstance(value, list) else [value]:
                        if item is not None:
                            if not isinstance(item, dict):
                                raise EvalError(f"only objects can be merged, not {values.kind(item)}")
                            for k, v in item.items():
                                self.put(made, collected, k, v, e, tree)
                    continue
                for inner in [names] if e.each is None else self.iterate(e.each, names, tree):
                    key = values.key_text(self.template(e.key, inner, tree))
                    self.put(made, collected, key, self.template(e.value, inner, tree), e, tree)
            return made
        except EvalError as error:
            if not hasattr(error, "place"):
                error.place = (t.start, t.end)
            raise

    def put(self, made: dict, collected: set, key: str, value, entry: s.Entry, tree: Tree | None) -> None:
        if entry.collect and key in collected:
            made[key].append(value)
            return
        if key in made:
            self.again(key, entry, tree)
        made[key] = [value] if entry.collect else value
        (collected.add if entry.collect else collected.discard)(key)

    def again(self, key: str, entry, tree: Tree | None) -> None:
        if self.reporting and tree is not None and id(entry) not in self.repeated:
            self.repeated[id(entry)] = RepeatedKey(key, (entry.start, entry.end), (tree.i, tree.j))

    def iterate(self, each: s.Each, names: dict, tree: Tree | None) -> list[dict]:
        source = names.get(each.variable) if each.source is None else self.template(each.source, names, tree)
        if source is None:
            return []
        if not isinstance(source, list):
            error = EvalError(f"`FOR {each.variable}` needs a list, got {values.kind(source)}")
            error.place = (each.start, each.end)
            raise error
        return [names | (x if isinstance(x, dict) else {}) | {each.variable: x} for x in source]

    def condition(self, c: s.Condition, names: dict) -> bool:
        self.spend()
        if c.kind == "not":
            return not self.condition(c.parts[0], names)
        if c.kind == "and":
            return self.condition(c.parts[0], names) and self.condition(c.parts[1], names)
        if c.kind == "or":
            return self.condition(c.parts[0], names) or self.condition(c.parts[1], names)
        if c.kind == "truthy":
            return values.truthy(self.template(c.parts[0], names, None))
        try:
            return values.compare(self.template(c.parts[0], names, None), c.operator, self.template(c.parts[1], names, None))
        except EvalError as error:
            if not hasattr(error, "place"):
                error.place = (c.start, c.end)
            raise

    # ---- the whole run

    def run(self) -> Output:
        size = len(self.text.text)
        if self.grammar.straight and self.grammar.root.height() <= self.options.max_depth:
            return self.run_straight()
        root = self.recognise()
        if size not in root.ends:
            if self.grammar.fuse:
                plain = Kernel(self.grammar.plain, self.text.text, self.options)
                raise RunError([plain.no_parse(plain.recognise())])
            raise RunError([self.no_parse(root)])
        try:
            tree = self.best(self.grammar.root, 0, size, 0)
        except _TooDeep:
            raise RunError([Problem("loom::input::too_deep", f"rule matches nest more than {self.options.max_depth} levels", 0, min(1, size), "raise max_depth", source="input")]) from None
        if tree is None:
            raise self.unsatisfied()
        out = self.valued(tree)
        if self.options.check_ambiguity:
            spent, self.steps, self.limit, self.quiet = self.steps, 0, self.options.ambiguity_steps, True
            try:
                self.analyse(tree, out.ambiguities)
                out.ambiguity_check_complete = True
            except _Stop:
                pass
            self.steps = spent
            strict = [a for a in out.ambiguities if a.strict]
            if strict:
                raise RunError([ambiguity_problem(a) for a in strict])
        out.steps = self.steps
        return out

    def run_straight(self) -> Output:
        tree = self.straight(self.grammar.root, 0, False)
        if tree is None or tree.j != len(self.text.text):
            plain = Kernel(self.grammar.plain, self.text.text, self.options)
            raise RunError([plain.no_parse(plain.recognise())])
        if not self.holds(tree):
            raise self.unsatisfied()
        out = self.valued(tree)
        out.ambiguity_check_complete, out.steps = self.options.check_ambiguity, self.steps
        return out

    def unsatisfied(self) -> RunError:
        return RunError([Problem("loom::input::no_parse", "the text matches the patterns, but no reading satisfies the WHERE conditions", 0, len(self.text.text), None, source="input")])

    def valued(self, tree: Tree) -> Output:
        self.reporting = True
        out = Output(self.rule_value(tree))
        self.reporting = False
        out.repeated_keys = list(self.repeated.values())
        if self.options.strict and out.repeated_keys:
            raise RunError([repeated_problem(k, "error") for k in out.repeated_keys])
        return out

    # ---- ambiguity

    def analyse(self, root: Tree, found: list[Ambiguity]) -> None:
        queue: deque = deque([(root, (), 1)])
        while queue and len(found) < MAX_REPORTS:
            tree, above, depth = queue.popleft()
            self.spend()
            if tree.node.straight:
                continue
            report = self.alternative(tree, above, depth)
            if report is not None:
                found.append(report)
            for n, p in enumerate(tree.parts):
                if p.tree is not None and p.role in ("part", "item") and p.tree.node.kind != "alias":
                    queue.append((p.tree, (tree, n, above), depth + (tree.node.kind == "rule")))

    def alternative(self, tree: Tree, above: tuple, depth: int) -> Ambiguity | None:
        """The first reading that differs from ``tree`` in one decision and changes the output."""
        call = self.calls[tree.node, tree.i]
        live = self.live(call, tree.j)
        real = [p for p in tree.parts if p.role != "stop"]
        if call.node.kind != "repeat" and len(call.node.branches) > 1:
            for config in self.starts(call, live)[tree.branch_index(self.starts(call, live)) + 1 :]:
                report = self.try_path(call, tree, above, live, [], config, (tree.i, tree.j), (tree.i, tree.j), "branch_order", depth)
                if report is not None:
                    return report
        config = (tree.branch, 0, tree.i) if call.node.kind != "repeat" else (0, 0, tree.i)
        for n in range(len(real) + 1):
            options = self.options_at(call, config, tree.j, live)
            self.spend(len(options))
            if len(options) == 1 and n < len(real):
                config = options[0][2]
                continue
            at = next((k for k, o in enumerate(options) if (o is None) == (n == len(real)) and (o is None or (o[1], o[3]) == (real[n].j, real[n].step))), None)
            if at is None:
                break
            chosen = options[at]
            lazy = call.node.kind == "repeat" and call.node.repeat.lazy
            for o in options[at + 1 :]:
                if o is not None and o[4] == "skip" or chosen is not None and chosen[4] == "skip":
                    continue
                if lazy and (o is None or chosen is None):
                    continue
                if o is not None and chosen is not None and o[3] is chosen[3] and (o[3].lazy or o[4] == "separator"):
                    continue
                prefix = list(real[:n])
                begin = config[2]
                following = None
                if o is not None:
                    following = o[2]
                report = self.try_path(call, tree, above, live, prefix, following, (begin, chosen[1] if chosen else begin), (begin, o[1] if o else begin), "more_specific_pattern", depth, o, config)
                if report is not None:
                    return report
            if n < len(real):
                config = chosen[2]
        return None

    def try_path(self, call, tree, above, live, prefix, config, chosen, other, advice, depth, option=None, was=None) -> Ambiguity | None:
        failure = new = None
        try:
            if option is not None:
                child = self.best(option[3].node, was[2], option[1], depth) if option[3].node is not None else None
                if option[3].node is not None and child is None:
                    return None
                prefix.append(Part(option[3], option[4], was[2], option[1], child))
            if config is None:
                own = list(prefix)
                if call.node.stop is not None and call.node.repeat.consume:
                    own.append(Part(None, "stop", was[2], tree.j, None))
                new = Tree(call.node, call.at, tree.j, tree.branch, own, was[2])
                if not self.holds(new):
                    return None
            else:
                new = self.walk(call, tree.j, live, config, prefix, depth)
                if new is None:
                    return None
        except RunError as error:
            failure = error.problems[0].message
        except _TooDeep:
            failure = f"it nests more than {self.options.max_depth} rule matches"
        if tree.node.kind == "repeat" and advice == "more_specific_pattern" or new is not None:
            if new is not None and self.crossed(tree) and not self.crossed(new):
                advice = "stop_crossed_lines"
        return self.compared(tree, new, above, chosen, other, advice, failure)

    def crossed(self, tree: Tree) -> bool:
        """Whether a repetition with a stop runs across a line break in the reading."""
        work = [tree]
        while work:
            t = work.pop()
            if t.node.stop is not None and _BREAK.search(self.text.text[t.i : t.inner_end].rstrip("\r\n")):
                return True
            if any(p.step is not None and p.step.run and _BREAK.search(self.text.text[p.i : p.step.run(self.text, p.i)].rstrip("\r\n")) for p in t.parts):
                return True
            work.extend(p.tree for p in t.parts if p.tree is not None and p.role in ("part", "item"))
        return False

    def offered(self, tree: Tree):
        """What a reading contributes to its surroundings."""
        self.spend(1 + len(tree.parts))
        if tree.node.kind == "rule":
            return self.rule_value(tree)
        if tree.node.kind == "repeat":
            out: dict = {}
            self.capture(Part(Step(node=tree.node), "part", tree.i, tree.j, tree), out)
            return [out, self.items(tree), self.text.text[tree.i : tree.inner_end]]
        return [self.captures(tree.parts), self.default(tree), tree.branch if tree.node.names() else None][:2]

    def compared(self, tree, new, above, chosen, other, advice, failure) -> Ambiguity | None:
        """Follow a difference upward; a report if the output differs in the end."""
        nearest = None
        values_of = None
        old, own = tree, new
        rest = above
        while True:
            if failure is None:
                try:
                    if own is not new and not self.holds(own):
                        return None
                    before, after = self.offered(old), self.offered(own)
                except RunError as error:
                    failure = error.problems[0].message
                    before = after = None
                else:
                    if same(before, after):
                        return None
            if old.node.kind == "rule" and nearest is None:
                nearest = old
                values_of = (self.rule_value(old), None if failure else after)
            if not rest:
                break
            parent, n, rest = rest
            if failure is None:
                p = parent.parts[n]
                parts = list(parent.parts)
                parts[n] = Part(p.step, p.role, p.i, p.j, own)
                own = Tree(parent.node, parent.i, parent.j, parent.branch, parts, parent.inner_end)
            old = parent
            if failure is not None and nearest is not None:
                break
        if failure is not None and advice == "stop_crossed_lines":
            advice = "more_specific_pattern"
        rule = nearest.node
        return Ambiguity(rule.name, chosen, other, to_json(values_of[0]), None if failure else to_json(values_of[1]), failure, advice, self.options.strict or rule.rule.strict)

    # ---- why a text does not match

    def no_parse(self, root: _Call) -> Problem:
        text, far = self.text, max(self.far, 0)
        size = len(text.text)
        described = []
        if far in root.ends and far < size:
            described.append("the end of the text")
        for what, rules in self.expected.items():
            named = " or ".join(f"`{r}`" for r in rules)
            described.append(what + (f" (the start of {named})" if rules else ""))
        listed = described[:MAX_EXPECTED]
        more = len(described) - len(listed)
        expected = " or ".join(listed) + (f", or one of {more} other things" if more else "")
        if size == 0:
            return Problem("loom::input::no_parse", "the text is empty", 0, 0, f"expected {expected}" if expected else None, source="input")
        related, crossed = (), None
        begun = [c for (n, _), c in self.calls.items() if n.stop is not None and any(k[2] == far for k in c.edges) and _BREAK.search(text.text[c.at : far].rstrip("\r\n"))]
        if begun:
            c = min(begun, key=lambda c: c.at)
            row = text.row(c.at)
            related = (("input", c.at, _BREAK.search(text.text, c.at).start(), f"the {'UNTIL' if c.node.repeat.consume else 'UNTILBEFORE'} started here, on line {row}"),)
            crossed = f"the repetition that started on line {row} was still running; the problem is probably on that line"
        if far >= size:
            return Problem("loom::input::no_parse", "the text ends too early", size - 1, size, crossed, f"expected {expected} after this", source="input", related=related)
        end = text.word_end(far) or text.number_end(far) or far + 1
        m = _BREAK.match(text.text, far)
        end = m.end() if m else end
        piece = to_json(text.text[far:end])
        help = f"the text does not match from the start; found {piece}" if far == 0 else f"the text matched up to here; found {piece}"
        if "LINE" in self.expected and text.column(far) > 1:
            help = "LINE matches whole lines only; for the rest of a line write `ANY UNTILBEFORE NL`, e.g. `ALIAS rest = ANY UNTILBEFORE NL`"
        return Problem("loom::input::no_parse", "the text does not match", far, end, crossed or help, f"expected {expected}" if expected else "unexpected", source="input", related=related)


def repeated_problem(k: RepeatedKey, severity: str = "warning") -> Problem:
    return Problem("loom::eval::repeated_key", f"the key {to_json(k.key)} is set more than once; the later value is kept", *k.entry, "collect the values with LISTOF", "set again here", severity, related=(("input", *k.matched, "in this text"),))


_ADVICE = {
    "branch_order": "the first branch won because it comes first; list the special case first, or exclude it with WHERE",
    "stop_crossed_lines": "the chosen reading runs across lines; add NL to the stop, or a stop that says where a value of several lines ends",
    "more_specific_pattern": "make the pattern more specific, with literals, SPLITBY or LAZY",
}


def ambiguity_problem(a: Ambiguity) -> Problem:
    other = f"another reading gives {a.alternative_value}" if a.failure is None else f"another reading of this text exists but fails to evaluate: {a.failure}"
    return Problem("loom::input::ambiguous", f"`{a.rule}` can be read in more than one way: chosen {a.chosen_value}; {other}", *a.chosen, _ADVICE[a.advice], "chosen", "error" if a.strict else "warning", "input", (("input", *a.alternative, "another reading"),))


@contextmanager
def deep_stack(calls: int = 200_000):
    """Room for that many nested calls."""
    was = sys.getrecursionlimit()
    sys.setrecursionlimit(max(was, calls))
    try:
        yield
    finally:
        sys.setrecursionlimit(was)


def run(grammar: Grammar, text: str, options: Options) -> Output:
    """Run with a stack that is deep enough for ``max_depth`` nested matches."""
    with deep_stack(60 * min(options.max_depth, 100_000) + 200_000):
        return Kernel(grammar, text, options).run()
