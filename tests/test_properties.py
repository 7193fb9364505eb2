"""Random grammars: the kernel accepts what a naive matcher accepts, printing reads back, and runs are deterministic."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textloom import QueryError, RunError, compile
from textloom.functions import chars
from textloom.functions.json_text import to_json
from textloom.plans import syntax as s

leaf = st.sampled_from(["'a'", "'ab'", "','", "' '", "i'A'", "WORD", "INT", "DIGIT", "LETTER", "PUNCT", "NL", "r1", "r2", "al"])


def combine(inner):
    item = inner.map(lambda p: f"({p})")
    bounds = st.sampled_from(["0 TO 1", "0 TO n", "1 TO n", "1 TO 2", "2 TO 3", "1 TO n LAZY"])
    return st.one_of(
        st.lists(item, min_size=2, max_size=3).map(" ".join), st.lists(item, min_size=2, max_size=3).map(" OR ".join),
        st.tuples(bounds, item, st.sampled_from(["", " SPLITBY ','", " SKIPPING ' '", " UNTIL ','", " UNTILBEFORE (' ' OR EOF)"])).map(lambda t: f"{t[0]} {t[1]}{t[2]}"),
    )


pattern = st.recursive(leaf, combine, max_leaves=6)
texts = st.lists(st.sampled_from(["a", "b", "ab", "A", "1", "42", ",", " ", "\n", "é"]), max_size=8).map("".join)


def ends(p: s.Pattern, names: dict, text: chars.Text, i: int, depth: int = 0) -> set[int]:
    """All ends of ``p`` at ``i``, by the definition; recursion without progress is cut by depth."""
    if depth > 40:
        return set()
    go = lambda q, j: ends(q, names, text, j, depth + 1)
    if isinstance(p, s.Literal):
        e = chars.literal(p.text, p.any_case)(text, i)
    elif isinstance(p, s.Primitive):
        e = chars.MATCH[p.kind](text, i)
    elif isinstance(p, s.Reference):
        return go(names[p.name], i)
    elif isinstance(p, s.Label):
        return go(p.inner, i)
    elif isinstance(p, s.Choice):
        return set().union(*(go(b, i) for b in p.branches))
    elif isinstance(p, s.Sequence):
        at = {i}
        for part in p.parts:
            at = {e for j in at for e in go(part, j)}
        return at
    else:
        def skipped(at):
            at = set(at)
            while p.skipping is not None and (more := {e for j in at for e in go(p.skipping, j)} - at):
                at |= more
            return at

        def open_(at):
            return {j for j in at if p.stop is None or not go(p.stop, j)}

        out, at, n = set(skipped({i}) if p.least == 0 else ()), {i}, 0
        while at and (p.most is None or n < p.most) and n <= len(text.text) + 1:
            if n == 0 or p.separator is None:
                start = open_(skipped(at))
            else:
                start = skipped({e for j in open_(skipped(at)) for e in go(p.separator, j)})
            at = {e for j in start for e in go(p.item, j)}
            n += 1
            if n >= p.least:
                out |= skipped(at)
        if p.stop is not None:
            out = {max(go(p.stop, j)) if p.consume else j for j in out if go(p.stop, j)}
        return out
    return set() if e is None else {e}


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(pattern, pattern, texts)
def test_kernel_accepts_what_the_definition_says(a, b, text):
    source = f"TEXT = {a}\nr1 = {b}\nr2 = 'b' OR 'c' r1\nALIAS al = 'b' OR DIGIT"
    try:
        query = compile(source)
    except QueryError:
        return
    assert s.parse(s.show(query.tree)) == query.tree
    names = {d.name: d.pattern for d in (*query.tree.rules, *query.tree.aliases)}
    wanted = len(text) in ends(names["TEXT"], names, chars.Text(text), 0)
    try:
        out = query.run(text)
    except RunError as error:
        assert not wanted and error.code == "loom::input::no_parse"
    else:
        assert wanted and to_json(query.run(text).value) == to_json(out.value)
