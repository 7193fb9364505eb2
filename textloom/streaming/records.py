"""Structured Streaming: records of one line each, by the same native expressions as in batch.  Stateless, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import Query


def read_records(spark: SparkSession, path: str, query: Query, output: str = "record", on_error: str = "fail", **options) -> DataFrame:
    """A streaming frame with one row a record of the text files that arrive in ``path``."""
    return query.lines(spark.readStream.options(**options).text(path), "value", output, on_error)


def write_records(records: DataFrame, path: str, checkpoint: str, output: str = "record", available_now: bool = True) -> StreamingQuery:
    """Append the records' fields to Parquet files, each record once."""
    writer = records.select(f"{output}.*").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
