"""Helpers shared by the corpus operators: input projection, lineage cuts, held-out split."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch, where the session has Spark's own default: a Python worker then holds few long texts at a time.
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in one process (``local[...]``, as in tests) a temporary folder is made where the session names none; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation of its past.

    Its files go with :func:`discard`, or when the driver ends.
    """
    small_batches(df.sparkSession)
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def shared_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; what is written there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/textloom/{label}-{uuid.uuid4().hex}"
    _files(spark, path, "deleteOnExit")
    return path


def _files(spark: SparkSession, path: str, action: str, *how) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return getattr(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), action)(target, *how)


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path, "exists")


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a frame that :func:`cut` returned; other frames are left alone."""
    path = getattr(df, "_textloom_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    _files(spark, path, "delete", True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` alone, null texts as empty; other columns, whatever their names, are not carried."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, longer if ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; fold 0 is held out.  A null id is held out too, so it never trains."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def sha_hex(col: Column) -> Column:
    return F.sha2(col, 256)
