"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags; inline markup does not cut.  A block is described by its word count and link
density, those of the blocks before and after it, and three signs of the markup: whether it is a heading, stands in an article, and whether a class
name or id around it consists of nothing but words for page furniture (``MARKS`` and ``PLAIN``).  A decision tree, trained with numpy on the small
table below, says from these nine numbers which blocks are main text; on pages without an article element the words and link densities decide.

Markup decides alone only where it says what a block is: elements for menus, page headers and footers, sidebars, forms, dialogs and
hidden parts (``FURNITURE``, ``ROLES``) are no main text, though they count as neighbours.  Scripts, styles, titles, comments and tags never are text.

Character references are decoded; white space in a block becomes one space; kept blocks are joined by one space in page order.  Null and
empty pages have the empty text; repeated rows each get their text; other columns of the input, whatever their names, are not carried.  Pages are read
whole, in time linear in their length: unclosed and stray tags are looked up by name, and a tag whose quotes do not end by the page's end
is read up to its first ``>``, as are all tags after it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?|=)?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW = frozenset("script style title iframe noembed noframes".split())  # up to the end tag, all is none of the page's text
FURNITURE = frozenset("nav footer aside form menu dialog select datalist template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button canvas cite code data del dfn em font i img input ins kbd label map mark object output q ruby rb rt rp s samp small span strike strong sub sup svg text time "
    "tspan tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle semantics annotation path g".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words for page furniture in class names and ids, and words that say nothing beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr notice popup modal newsletter subscribe signup login nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar related share sharing social footer masthead comment comments disqus reply replies".split()
)
PLAIN = frozenset(
    "box list container wrapper wrap section block area slot banner bar link links button buttons main site page top bottom left right post posts article articles user reader "
    "widget inner outer group item items content text head title form thread row unit".split()
)
#: words, link density, words before, link density before, words after, link density after, heading, article, marked -> main text
LABELLED = (
    # in a part whose name says furniture
    ((8, 0.0, 2, 1.0, 9, 0.0, 0, 0, 1), 0), ((40, 0.0, 6, 0.0, 80, 0.0, 0, 0, 1), 0), ((120, 0.0, 90, 0.0, 60, 0.0, 0, 0, 1), 0), ((3, 1.0, 3, 1.0, 3, 1.0, 0, 0, 1), 0),
    ((25, 0.1, 60, 0.0, 30, 0.1, 0, 1, 1), 0), ((7, 0.0, 90, 0.0, 45, 0.0, 1, 1, 1), 0), ((90, 0.0, 30, 0.0, 85, 0.0, 0, 1, 1), 0), ((1, 1.0, 70, 0.0, 0, 0.0, 0, 1, 1), 0),
    ((12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), 0), ((14, 0.0, 80, 0.0, 0, 0.0, 0, 1, 1), 0), ((6, 0.0, 20, 0.0, 30, 0.0, 1, 0, 1), 0), ((55, 0.3, 14, 0.0, 2, 1.0, 0, 1, 1), 0),
    # in an article: paragraphs of any length, lists of links, headings
    ((12, 0.0, 9, 0.0, 80, 0.0, 1, 1, 0), 1), ((1, 0.0, 6, 1.0, 70, 0.0, 1, 1, 0), 1), ((80, 0.0, 12, 0.0, 60, 0.0, 0, 1, 0), 1), ((2, 0.0, 60, 0.0, 90, 0.0, 0, 1, 0), 1),
    ((1, 0.0, 40, 0.0, 8, 1.0, 0, 1, 0), 1), ((6, 1.0, 50, 0.0, 60, 0.0, 0, 1, 0), 1), ((4, 1.0, 5, 1.0, 6, 1.0, 0, 1, 0), 1), ((9, 0.6, 3, 1.0, 0, 0.0, 0, 1, 0), 1),
    ((3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0), 1), ((2, 1.0, 0, 0.0, 2, 1.0, 0, 1, 0), 1), ((30, 0.9, 3, 1.0, 50, 0.0, 0, 1, 0), 1), ((5, 0.0, 4, 1.0, 3, 1.0, 0, 1, 0), 1),
    ((1, 1.0, 3, 1.0, 0, 0.0, 0, 1, 0), 1), ((150, 0.0, 0, 0.0, 4, 1.0, 0, 1, 0), 1), ((7, 0.0, 2, 1.0, 5, 0.0, 0, 1, 0), 1), ((11, 1.0, 2, 0.0, 2, 1.0, 1, 1, 0), 1),
    ((3, 0.0, 5, 0.0, 0, 0.0, 0, 1, 0), 1), ((6, 0.0, 9, 1.0, 0, 0.0, 0, 1, 0), 1), ((2, 0.4, 4, 1.0, 1, 0.0, 0, 1, 0), 1), ((8, 0.9, 60, 0.0, 9, 1.0, 0, 1, 0), 1),
    ((3, 0.0, 14, 1.0, 0, 0.0, 0, 1, 0), 1), ((3, 0.1, 2, 1.0, 0, 0.0, 0, 1, 0), 1), ((3, 0.0, 30, 0.7, 2, 0.0, 0, 1, 0), 1), ((4, 0.2, 1, 0.8, 0, 0.0, 0, 1, 0), 1),
    # elsewhere: running text, whatever stands beside it
    ((70, 0.0, 10, 0.0, 55, 0.0, 0, 0, 0), 1), ((45, 0.05, 60, 0.0, 65, 0.0, 0, 0, 0), 1), ((60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0), 1), ((22, 0.0, 80, 0.0, 3, 1.0, 0, 0, 0), 1),
    ((30, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0), 1), ((16, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), 1), ((80, 0.3, 2, 1.0, 4, 1.0, 0, 0, 0), 1), ((14, 0.1, 45, 0.0, 50, 0.0, 0, 0, 0), 1),
    ((120, 0.4, 3, 0.0, 60, 0.2, 0, 0, 0), 1), ((18, 0.3, 40, 0.1, 2, 1.0, 0, 0, 0), 1), ((35, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0), 1), ((15, 0.0, 0, 0.0, 4, 1.0, 0, 0, 0), 1),
    ((80, 0.0, 10, 0.0, 0, 0.0, 0, 0, 0), 1), ((25, 0.0, 12, 1.0, 0, 0.0, 0, 0, 0), 1), ((20, 0.2, 6, 1.0, 3, 1.0, 0, 0, 0), 1), ((50, 0.1, 7, 0.0, 9, 1.0, 0, 0, 0), 1),
    # elsewhere: short text beside running text, or where there are no links at all
    ((5, 0.0, 75, 0.0, 60, 0.0, 0, 0, 0), 1), ((3, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0), 1), ((6, 0.0, 0, 0.0, 40, 0.0, 0, 0, 0), 1), ((4, 0.0, 5, 0.0, 6, 0.0, 0, 0, 0), 1),
    ((2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0), 1), ((7, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0), 1), ((8, 0.1, 60, 0.0, 2, 0.0, 0, 0, 0), 1), ((1, 0.0, 25, 0.2, 20, 0.1, 0, 0, 0), 1),
    ((3, 0.0, 8, 0.0, 0, 0.0, 0, 0, 0), 1), ((3, 0.1, 4, 0.0, 0, 0.0, 0, 0, 0), 1), ((3, 0.0, 12, 0.2, 0, 0.0, 0, 0, 0), 1), ((3, 0.2, 1, 0.0, 0, 0.0, 1, 0, 0), 1),
    # elsewhere: headings of running text
    ((8, 0.0, 3, 1.0, 90, 0.0, 1, 0, 0), 1), ((2, 0.0, 2, 1.0, 25, 0.0, 1, 0, 0), 1), ((5, 0.0, 75, 0.0, 60, 0.0, 1, 0, 0), 1), ((6, 0.0, 1, 1.0, 12, 0.1, 1, 0, 0), 1),
    ((4, 0.0, 3, 1.0, 6, 0.0, 1, 0, 0), 1), ((9, 1.0, 0, 0.0, 70, 0.0, 1, 0, 0), 1), ((7, 1.0, 3, 1.0, 40, 0.0, 1, 0, 0), 1), ((3, 0.0, 4, 1.0, 1, 0.0, 1, 0, 0), 1),
    # elsewhere: links within running text
    ((6, 1.0, 50, 0.0, 60, 0.0, 0, 0, 0), 1), ((3, 1.0, 20, 0.0, 35, 0.1, 0, 0, 0), 1), ((12, 0.7, 80, 0.0, 25, 0.0, 0, 0, 0), 1), ((30, 0.6, 40, 0.0, 45, 0.0, 0, 0, 0), 1),
    # elsewhere: menus, lists of links, and short text between them
    ((3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), 0), ((12, 0.9, 9, 0.9, 20, 0.0, 0, 0, 0), 0), ((30, 0.8, 4, 1.0, 6, 0.9, 0, 0, 0), 0), ((1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), 0),
    ((6, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0), 0), ((4, 1.0, 70, 0.0, 3, 1.0, 0, 0, 0), 0), ((5, 1.0, 90, 0.0, 0, 0.0, 0, 0, 0), 0), ((40, 1.0, 2, 1.0, 1, 1.0, 0, 0, 0), 0),
    ((4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), 0), ((2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), 0), ((3, 0.0, 4, 1.0, 0, 0.0, 0, 0, 0), 0), ((6, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0), 0),
    ((9, 0.5, 3, 0.8, 4, 0.8, 0, 0, 0), 0), ((2, 0.5, 2, 1.0, 2, 1.0, 0, 0, 0), 0), ((3, 0.0, 3, 1.0, 5, 1.0, 1, 0, 0), 0), ((1, 0.0, 9, 1.0, 2, 1.0, 1, 0, 0), 0),
    ((7, 0.6, 30, 0.9, 0, 0.0, 0, 0, 0), 0), ((5, 0.8, 12, 0.9, 40, 0.0, 0, 0, 0), 0), ((15, 1.0, 60, 0.0, 8, 1.0, 0, 0, 0), 0), ((60, 0.9, 80, 0.0, 0, 0.0, 0, 0, 0), 0),
    ((9, 1.0, 4, 0.0, 30, 0.0, 0, 0, 0), 0), ((20, 0.9, 1, 1.0, 30, 0.0, 0, 0, 0), 0), ((15, 1.0, 8, 0.0, 40, 0.0, 0, 0, 0), 0), ((8, 0.9, 12, 1.0, 25, 0.0, 0, 0, 0), 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> tuple:
    """A decision tree by Gini impurity: (column, threshold, left, right), or (share,) for a leaf."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for column in range(x.shape[1]):
        values = np.unique(x[:, column])
        for threshold in (values[1:] + values[:-1]) / 2:
            left = x[:, column] <= threshold
            p, q = y[left].mean(), y[~left].mean()
            impurity = left.mean() * p * (1 - p) + (~left).mean() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, column, float(threshold), left)
    if best is None or best[0] >= share * (1 - share) - 1e-12:
        return (share,)
    _, column, threshold, left = best
    return (column, threshold, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def trained(rows=LABELLED) -> tuple:
    return grow(np.array([r for r, _ in rows], dtype=float), np.array([k for _, k in rows], dtype=float))


def judged(tree: tuple, features: tuple) -> bool:
    while len(tree) == 4:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def says_furniture(value: str) -> bool:
    """Whether a class or id has a name of furniture words alone, such as ``cookie-notice`` or ``related posts``; ``share-price`` is none."""
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not MARKS.isdisjoint(parts) and all(p in MARKS or p in PLAIN for p in parts):
            return True
    return False


class _Reader:
    """Reads the tags of one page."""

    def __init__(self, page: str):
        self.page, self.lenient, self.last = page, False, page.rfind(">")

    def tag(self, at: int) -> tuple[int, str, dict[str, str]] | None:
        """(end, name with a slash if it closes, attributes) of the tag that begins at ``at``; None if ``<`` is text there."""
        page = self.page
        head = _NAME.match(page, at)
        if not head or self.last < at:
            return None
        name, where = head[1].lower(), head.end()
        found: dict[str, str] = {}
        if not self.lenient:
            while True:
                m = _ATTRIBUTE.match(page, where)
                where = m.end()
                if m[1]:
                    found.setdefault(m[1].lower(), m[2].strip("\"'") if m[2] else "")
                elif where == m.start() or where >= len(page) or page[where] == ">":
                    break
            if where < len(page) and page[where] == ">":
                return where + 1, "/" * (page[at + 1] == "/") + name, found
            self.lenient, found = True, {}
        end = page.find(">", head.end())
        return (end + 1, "/" * (page[at + 1] == "/") + name, found) if end >= 0 else None


def blocks(page: str) -> list[tuple[str, int, float, bool, bool, bool, bool]]:
    """(text, words, link density, furniture, heading, article, marked) of each block that has words, in page order."""
    out: list = []
    reader = _Reader(page)
    stack: list[tuple] = []  # name; furniture, heading, article, marked, link as they were outside; places of the open p and li that would end here
    opened: dict[str, int] = {}
    state = [False] * 5
    parts: list[str] = []
    linked: list[str] = []
    described = (False,) * 4

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            n = len(text.split(" "))
            out.append((text, n, min(1.0, len(" ".join(linked).split()) / n), *described))
        parts.clear()
        linked.clear()

    def say(raw: str) -> None:
        nonlocal described
        if not parts:
            if raw.isspace():
                return
            described = tuple(state[:4])
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if state[4]:
            linked.append(text)

    def close(depth: int) -> None:
        state[:] = stack[depth][1:6]
        for entry in stack[depth:]:
            opened[entry[0]] -= 1
        del stack[depth:]

    at, begin, size = 0, 0, len(page)
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith(("<!", "<?"), at):
            if begin < at:
                say(page[begin:at])
            end = page.find("-->", at + 2) + 2 if page.startswith("<!--", at) else page.find(">", at)
            at = begin = end + 1 if end > at else size
            continue
        tag = reader.tag(at)
        if tag is None:
            at += 1
            continue
        if begin < at:
            say(page[begin:at])
        at, name, attributes = tag
        begin = at
        closing = name[0] == "/"
        name = name[closing:]
        if name in RAW and not closing:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = begin = end.end() if end else size
            flush()
            continue
        if name == "br":
            parts and parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            if opened.get(name):
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close(depth)
            continue
        if name in VOID:
            continue
        if name in ("p", "li") and stack:  # an open one of these ends where the next begins
            depth = stack[-1][6 if name == "p" else 7]
            if depth >= 0:
                close(depth)
        here, outside = len(stack), stack[-1] if stack else (None,) * 6 + (-1, -1)
        p = here if name == "p" else outside[6] if name in INLINE else -1
        li = here if name == "li" else outside[7] if name in INLINE or name == "p" else -1
        stack.append((name, *state, p, li))
        opened[name] = opened.get(name, 0) + 1
        article = state[2] or name in ("article", "main") or attributes.get("role", "").lower() in ("article", "main")
        state[0] = state[0] or name in FURNITURE or name == "header" and not article or _hidden(attributes)
        state[1] = state[1] or name in HEADINGS
        state[2] = article
        if name not in ("body", "html", "article", "main"):
            state[3] = state[3] or any(k in attributes and says_furniture(attributes[k]) for k in ("class", "id"))
        state[4] = state[4] or name == "a"
    if begin < size:
        say(page[begin:])
    flush()
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    return bool(attributes) and (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or attributes.get("role", "").lower() in ROLES
        or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    )


def main_text(page: str | None, tree: tuple) -> str:
    own = blocks(page or "")
    kept = []
    none = ("", 0, 0.0)
    for i, (text, n, density, furniture, heading, article, marked) in enumerate(own):
        before, after = own[i - 1] if i else none, own[i + 1] if i + 1 < len(own) else none
        if not furniture and judged(tree, (n, density, before[1], before[2], after[1], after[2], heading, article, marked)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)`` for every page."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"))
    tree = trained()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=batch.schema.names)

    return own.mapInArrow(scan, own.schema)


def digest(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
