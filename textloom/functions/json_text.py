"""Exact JSON text: key order kept, numbers in their shortest form, nesting of any depth."""

from __future__ import annotations

import json
from decimal import Decimal


def number_text(value: int | float) -> str:
    """Integers as they are; other numbers in the shortest digits that read back, with ``.0`` or an exponent."""
    if isinstance(value, int):
        return str(value)
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    if not text:
        return "-0.0" if sign else "0.0"
    exponent += len(text) - len(text := text.rstrip("0"))
    point = len(text) + exponent  # digits before the point
    if 0 < point <= 16:
        out = text + "0" * exponent + ".0" if exponent >= 0 else text[:point] + "." + text[point:]
    elif -5 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1}"
    return "-" + out if sign else out


def to_json(value, indent: int | None = None) -> str:
    """JSON of a value of any depth (iterative)."""
    out: list[str] = []
    stack: list = [("value", value, 0)]
    line = (lambda level: "\n" + " " * (indent * level)) if indent else (lambda level: "")
    while stack:
        kind, item, level = stack.pop()
        if kind == "text":
            out.append(item)
        elif item is None:
            out.append("null")
        elif item is True or item is False:
            out.append("true" if item else "false")
        elif isinstance(item, str):
            out.append(json.dumps(item, ensure_ascii=False))
        elif isinstance(item, (int, float)):
            out.append(number_text(item))
        else:
            is_object = isinstance(item, dict)
            opened, closed = "{}" if is_object else "[]"
            if not item:
                out.append(opened + closed)
                continue
            out.append(opened)
            stack.append(("text", line(level) + closed, level))
            own: list = []
            for n, x in enumerate(item.items() if is_object else item):
                lead = ("," if n else "") + line(level + 1)
                if is_object:
                    own.append(("text", lead + json.dumps(x[0], ensure_ascii=False) + (": " if indent else ":"), level))
                    own.append(("value", x[1], level + 1))
                else:
                    own.append(("text", lead, level))
                    own.append(("value", x, level + 1))
            stack.extend(reversed(own))
    return "".join(out)


def same(a, b) -> bool:
    """Whether two values are equal with the same key order and number kinds, to any depth."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x is y:
            continue
        if type(x) is not type(y):
            return False
        if isinstance(x, dict):
            if list(x) != list(y):
                return False
            stack.extend(zip(x.values(), y.values(), strict=True))
        elif isinstance(x, list):
            if len(x) != len(y):
                return False
            stack.extend(zip(x, y, strict=True))
        elif x != y:
            return False
    return True
