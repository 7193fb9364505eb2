"""Character classes and token patterns, once for Python and once for the JVM."""

from __future__ import annotations

import ipaddress
from bisect import bisect_right
from collections.abc import Callable

import regex

#: Combining marks that belong to the letter before them.
MARKS = r"̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯‍️"
#: Java regular expressions of the token patterns that one can express.
JAVA = {
    "WORD": rf"(?<!\p{{IsAlphabetic}}[{MARKS}]{{0,32}})\p{{IsAlphabetic}}[\p{{IsAlphabetic}}{MARKS}]*+",
    "INT": r"(?<![0-9])[0-9]++",
    "FLOAT": r"(?<![0-9])(?<![0-9]\.)[0-9]++(?:\.[0-9]++)?+",
    "HEX": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]++(?![\p{IsAlphabetic}\p{N}])",
    "BIN": r"(?<![01])[01]++(?![\p{IsAlphabetic}\p{N}])",
    "IPV4": r"(?<![0-9.])(?:(?:0{0,2}[0-9]|0?[0-9]{2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?![0-9])(?:\.(?=[0-9])|(?!\.[0-9]))){4}(?<!\.)",
    "PUNCT": r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]",
    "ANY": r"(?s:.)",
    "DIGIT": r"[0-9]",
    "LETTER": rf"\p{{IsAlphabetic}}[{MARKS}]*+",
    "NL": r"(?>\r\n|\n|\r)",
    "TAB": r"\t",
    "LINE": r"(?:(?<=\A|\n)|(?<=\r)(?!\n))[^\r\n]*+(?=[\r\n]|\z)",
    "EOF": r"\z",
}
SPACE = regex.compile(r"\p{White_Space}")
_TRIM = regex.compile(r"\A\p{White_Space}+|\p{White_Space}+\Z")
_WORDS = regex.compile(rf"\p{{Alphabetic}}[\p{{Alphabetic}}{MARKS}]*+")
_NUMBERS = regex.compile(r"[0-9]++(?:\.[0-9]++)?+")
_BREAK = regex.compile(r"\r\n|\n|\r")
_HEX = regex.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]++(?![\p{Alphabetic}\p{N}])")
_BIN = regex.compile(r"(?<![01])[01]++(?![\p{Alphabetic}\p{N}])")
_INT = regex.compile(r"(?<![0-9])[0-9]++")
_IPV4 = regex.compile(r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?!\.?[0-9])")
_PUNCT = regex.compile(r"[^\p{Alphabetic}\p{N}\p{White_Space}]")
_LETTER = regex.compile(rf"\p{{Alphabetic}}[{MARKS}]*+")
_IPV6_AT = regex.compile(r"(?<![\p{Alphabetic}\p{N}:.])[0-9A-Fa-f:.]{2,45}")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")


def trim(text: str) -> str:
    return _TRIM.sub("", text)


class Text:
    """A text with what the token patterns need to know about it."""

    def __init__(self, text: str):
        self.text = text
        self._lines: list[int] | None = None
        self._words: dict[int, int] | None = None
        self._numbers: dict[int, int] | None = None

    @property
    def lines(self) -> list[int]:
        """Positions at which lines start."""
        if self._lines is None:
            self._lines = [0, *(m.end() for m in _BREAK.finditer(self.text))]
        return self._lines

    def row(self, i: int) -> int:
        return bisect_right(self.lines, i)

    def column(self, i: int) -> int:
        return i - self.lines[self.row(i) - 1] + 1

    def word_end(self, i: int) -> int | None:
        if self._words is None:
            self._words = {m.start(): m.end() for m in _WORDS.finditer(self.text)}
        return self._words.get(i)

    def number_end(self, i: int) -> int | None:
        if self._numbers is None:
            self._numbers = {m.start(): m.end() for m in _NUMBERS.finditer(self.text)}
        return self._numbers.get(i)


def _by(pattern) -> Callable[[Text, int], int | None]:
    def match(text: Text, i: int) -> int | None:
        m = pattern.match(text.text, i)
        return m.end() if m else None

    return match


def _ipv4(text: Text, i: int) -> int | None:
    m = _IPV4.match(text.text, i)
    return m.end() if m and all(int(p) <= 255 for p in m[0].split(".")) else None


def _is_ipv6(part: str) -> bool:
    head, dot, _ = part.partition(".")
    if dot:  # a dotted tail may have leading zeros
        head, _, tail = part.rpartition(":")
        quad = tail.split(".")
        if len(quad) != 4 or not all(q and len(q) <= 3 and int(q) <= 255 for q in quad if q.isdigit() or not q) or not all(q.isdigit() for q in quad):
            return False
        part = f"{head}:0:0"
    try:
        ipaddress.IPv6Address(part)
    except ValueError:
        return False
    return True


def _ipv6(text: Text, i: int) -> int | None:
    m = _IPV6_AT.match(text.text, i)
    if not m:
        return None
    for end in range(m.end(), i + 1, -1):
        after = text.text[end : end + 1]
        if _ALNUM.match(after) or "." in text.text[i:end] and regex.match(r"\.?[0-9]", text.text[end : end + 2]):
            continue
        if _is_ipv6(text.text[i:end]):
            return end
    return None


def _line(text: Text, i: int) -> int | None:
    lines = text.lines
    at = bisect_right(lines, i)
    if lines[at - 1] != i:
        return None
    m = regex.compile(r"[^\r\n]*+").match(text.text, i)
    return m.end()


#: What each token pattern matches: the end of the match at a position, or None.
MATCH: dict[str, Callable[[Text, int], int | None]] = {
    "WORD": lambda t, i: t.word_end(i),
    "FLOAT": lambda t, i: t.number_end(i),
    "INT": _by(_INT),
    "HEX": _by(_HEX),
    "BIN": _by(_BIN),
    "IPV4": _ipv4,
    "IPV6": _ipv6,
    "PUNCT": _by(_PUNCT),
    "ANY": lambda t, i: i + 1 if i < len(t.text) else None,
    "DIGIT": lambda t, i: i + 1 if t.text[i : i + 1] in tuple("0123456789") else None,
    "LETTER": _by(_LETTER),
    "LINE": _line,
    "NL": _by(_BREAK),
    "TAB": lambda t, i: i + 1 if t.text[i : i + 1] == "\t" else None,
    "ROW": lambda t, i: i,
    "COL": lambda t, i: i,
    "EOF": lambda t, i: i if i == len(t.text) else None,
}


#: Token patterns of one character each (with its marks), as regular expressions.
CHARACTERS = {"ANY": "(?s:.)", "DIGIT": "[0-9]", "LETTER": _LETTER.pattern, "PUNCT": _PUNCT.pattern, "TAB": r"\t"}


def repeated(kind: str, least: int, most: int | None) -> Callable[[Text, int], int | None]:
    """The end of as many such characters as there are from a position on."""
    return _by(regex.compile(f"(?:{CHARACTERS[kind]}){{{least},{'' if most is None else most}}}+"))


def literal(text: str, any_case: bool) -> Callable[[Text, int], int | None]:
    if not any_case:
        return lambda t, i: i + len(text) if t.text.startswith(text, i) else None
    lowered = [c.lower() for c in text]
    n = len(text)

    def match(t: Text, i: int) -> int | None:
        part = t.text[i : i + n]
        return i + n if len(part) == n and all(a.lower() == b for a, b in zip(part, lowered, strict=True)) else None

    return match


def java_literal(text: str, any_case: bool) -> str:
    """A Java regular expression for a literal; cases are spelled out as characters that lower-case alike."""
    if not any_case:
        return "".join(regex.escape(c, special_only=False) if c.isascii() and not c.isalnum() and c != "_" else c for c in text)
    out = []
    for c in text:
        alike = sorted({x for x in (c, c.lower(), c.upper(), c.title()) if len(x) == 1 and x.lower() == c.lower()} | _also(c.lower()))
        out.append("[" + "".join(f"\\x{{{ord(x):X}}}" for x in alike) + "]")
    return "".join(out)


def _also(lowered: str) -> set[str]:
    """Characters whose lower case is ``lowered`` though they are not its upper case."""
    return {chr(c) for c in (0x130, 0x1E9E, 0x2126, 0x212A, 0x212B) if chr(c).lower() == lowered}
