"""Text sources and JSON sinks: whole documents, lines, standard input, and UTF-8 validation."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import to_json


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: one row a file; bytes that are no UTF-8 become replacement characters (see :func:`valid_documents`)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def valid_documents(spark: SparkSession, path: str, on_invalid: str = "fail") -> DataFrame:
    """``(path, text, invalid_at)``: one row a file; ``invalid_at`` is the offset of the first byte that is no UTF-8.

    ``on_invalid``: fail the job, or ``null`` for a null text.
    """

    @F.pandas_udf("long")
    def first_invalid(content: pd.Series) -> pd.Series:
        def offset(raw: bytes) -> int | None:
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError as error:
                return error.start
            return None

        return pd.Series([offset(bytes(c)) for c in content], dtype="Int64")

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.col("content").cast("string")
    valid = F.call_function("is_valid_utf8", text)
    checked = files.select("path", F.when(valid, text).alias("text"), F.when(~valid, first_invalid("content")).alias("invalid_at"))
    if on_invalid == "null":
        return checked
    failure = F.raise_error(F.concat(F.lit("loom::io::utf8: "), "path", F.lit(" is not UTF-8, at byte "), F.col("invalid_at").cast("string")))
    return checked.select("path", F.when(F.col("invalid_at").isNull(), F.col("text")).otherwise(failure).alias("text"), "invalid_at")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``: one row a line, however lines are broken; the scan splits large files."""
    return spark.read.text(path)


def standard_input(spark: SparkSession) -> DataFrame:
    """``(path, text)``: all of standard input as one document, read to its end."""
    return spark.createDataFrame([("<stdin>", sys.stdin.read())], "path string, text string")


def text_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with one row a line of ``column``: ``line`` (from 1) and ``value``."""
    return df.select("*", F.posexplode(F.split(column, r"\r\n|\n|\r", -1)).alias("line", "value")).withColumn("line", F.col("line") + 1)


def write_json(df: DataFrame, path: str, column: str = "value") -> None:
    """One compact JSON value a line; ``column`` holds JSON text."""
    df.select(F.col(column).alias("value")).write.text(path)


def pretty(value) -> str:
    """JSON over several lines, keys in their order."""
    return to_json(value, 2)
