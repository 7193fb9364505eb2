"""Result types: the statically known shape of every value, and the Spark type for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Shape:
    """``kind``: text, int, float, number, boolean, null, array, object, map, unknown; digits and decimal are text that is a number."""

    kind: str
    item: Shape | None = None  # of an array, or the values of a map
    fields: tuple[tuple[str, Shape], ...] = ()

    def field(self, name: str) -> Shape | None:
        return dict(self.fields).get(name)


TEXT, INT, FLOAT, NUMBER, BOOLEAN, NULL, UNKNOWN = (Shape(k) for k in "text int float number boolean null unknown".split())


DIGITS, DECIMAL = Shape("digits"), Shape("decimal")
TEXTS = ("text", "digits", "decimal")
#: What a captured primitive is worth, where it is not any text.
PRIMITIVES = {"ROW": INT, "COL": INT, "INT": DIGITS, "DIGIT": DIGITS, "BIN": DIGITS, "FLOAT": DECIMAL}


def array(item: Shape) -> Shape:
    return Shape("array", item)


def record(fields: dict[str, Shape]) -> Shape:
    return Shape("object", fields=tuple(fields.items()))


def unify(a: Shape, b: Shape) -> Shape:
    """The shape of a value that is one or the other; null goes with anything."""
    if a == b or b == NULL:
        return a
    if a == NULL:
        return b
    if {a.kind, b.kind} <= {"int", "float", "number"}:
        return NUMBER
    if a.kind in TEXTS and b.kind in TEXTS:
        return TEXT
    if a.kind == b.kind and a.kind in ("array", "map"):
        return Shape(a.kind, unify(a.item, b.item))
    return UNKNOWN


def spark_type(shape: Shape) -> T.DataType | None:
    """None if the value has no one type; it is then given as JSON text."""
    simple = {"text": T.StringType(), "digits": T.StringType(), "decimal": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "null": T.StringType()}
    if shape.kind in simple:
        return simple[shape.kind]
    if shape.kind in ("array", "map"):
        item = spark_type(shape.item)
        if item is None:
            return None
        return T.ArrayType(item) if shape.kind == "array" else T.MapType(T.StringType(), item)
    if shape.kind == "object":
        fields = [(n, spark_type(x)) for n, x in shape.fields]
        if not fields or any(t is None for _, t in fields) or len({n.lower() for n, _ in fields}) < len(fields):
            return None
        return T.StructType([T.StructField(n, t) for n, t in fields])
    return None
