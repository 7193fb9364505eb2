"""Corpus preparation in five stages; each reads all that the stage before it kept, and its decisions take effect.

1. toxicity: documents that the classifier rejects go.
2. near_dedup: one document of each near-duplicate group stays.
3. decontamination: documents that hold a benchmark window go.
4. secrets: found secrets are replaced by a mark; the document stays.
5. byte_bpe: texts become token ids; the digest of the decoded bytes stands beside them.

Null and empty texts are kept as they are (copies of each other for stage 2; no ids in stage 5), rows with a null or reused id are documents of their own,
of repeated rows one stays, extra columns, whatever their names, reach the last stage, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontam, near_dedup, secrets, toxicity
from textloom.llm.common import cut, discard, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "_toxic")
    return toxicity.score(docs, model, out_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizer = bpe.Tokenizer(spark, frequent=1 << 16)  # a smaller literal, as the other stages share the driver's memory
    encoded = tokenizer.encode(docs)
    return encoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(tokenizer.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # SQL can express neither the classifier nor the tokenizer; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
