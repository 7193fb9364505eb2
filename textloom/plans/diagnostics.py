"""Problems of queries and runs: a stable code, a message, labelled places, and a hint."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Problem:
    code: str
    message: str
    start: int = 0
    end: int = 0
    help: str | None = None
    label: str = ""
    severity: str = "error"
    source: str = "query"
    related: tuple[tuple[str, int, int, str], ...] = ()  # (source, start, end, label)

    def render(self, name: str = "query", text: str | None = None) -> str:
        """Plain text: severity, code, place, the line, and the hint."""
        out = [f"{self.severity}[{self.code}]: {self.message}"]
        if text is not None:
            begin = max(text.rfind("\n", 0, self.start), text.rfind("\r", 0, self.start)) + 1
            row = len([1 for i, c in enumerate(text[: self.start]) if c == "\n" or c == "\r" and text[i + 1 : i + 2] != "\n"]) + 1
            line = text[begin:].split("\n", 1)[0].split("\r", 1)[0]
            width = max(1, min(self.end, begin + len(line)) - self.start)
            out += [f"  --> {name}:{row}:{self.start - begin + 1}", f"   | {line}", f"   | {' ' * (self.start - begin)}{'^' * width} {self.label}".rstrip()]
        if self.help:
            out.append(f"  help: {self.help}")
        return "\n".join(out)


class QueryError(Exception):
    """A query that does not parse or check; ``problems`` in order of position."""

    def __init__(self, problems: list[Problem]):
        self.problems = problems
        super().__init__("\n".join(p.render() for p in problems))


class RunError(Exception):
    """A run that failed; ``problems`` say why (several for strict ambiguities or repeated keys)."""

    def __init__(self, problems: list[Problem]):
        self.problems = problems
        super().__init__("\n".join(p.render() for p in problems))

    @property
    def code(self) -> str:
        return self.problems[0].code


def closest(name: str, names) -> str | None:
    """The most similar of ``names``, if it is within a third of the name's length (one edit at least)."""
    best = None
    for other in sorted(set(names)):
        a, b = name.lower(), other.lower()
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if row[-1] <= max(1, len(name) // 3) and (best is None or row[-1] < best[0]):
            best = (row[-1], other)
    return best and best[1]
