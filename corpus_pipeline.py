"""The corpus pipeline: STAGES over documents, each written as Parquet and read again.

quality       reject what importance resampling doesn't draw
duplicates    keep one document of each class of near-duplicates by SimHash signatures of
              five-word shingles, verified to a Jaccard similarity of 0.8 or more
benchmark     drop documents that hold a passage of a benchmark item
secrets       replace secrets by a mark
tokens        encode every whole text; the last stage returns ids instead of texts
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm import decontaminate, near_copies, pieces, quality, secrets
from gridspan.llm.common import new_path, remove_staged, staged_so_far


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(docs.columns)


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=decontaminate.SHORTEST)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the changed text."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("duplicates", drop_duplicates),
    ("benchmark", drop_benchmark),
    ("secrets", hide_secrets),
    ("tokens", encode),
]

#: SQL has neither the n-gram models nor the encoder; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is a table in the shared folder; when the next
    one is written, it and all that was staged on the way are deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_so_far()
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        remove_staged(spark, keep=(path,), since=before)
    return docs
