"""Contacts that keep arriving: lines of pairs tables, appended to the contact table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.operators import ingest
from gridspan.plans import files
from gridspan.sources import text
from gridspan.store import Store


def parsed(lines: DataFrame, dataset: str, dividend: int, layout: str | None = None) -> DataFrame:
    """Lines (value) to encoded point contacts; works on static and streaming frames alike."""
    rows = text.parse_table(lines, "pairs", layout)
    raw = rows.select(
        F.lit(dataset).alias("dataset"), F.col("readid").alias("read_id"), F.col("chr1").alias("chr_x"), F.col("chr2").alias("chr_y"),
        F.col("pos1").cast("long").alias("pos1_s"), F.col("pos1").cast("long").alias("pos1_e"), F.col("pos2").cast("long").alias("pos2_s"), F.col("pos2").cast("long").alias("pos2_e"),
        F.least(ingest.clean_mapq(F.col("mapq1")), ingest.clean_mapq(F.col("mapq2"))).alias("mapq"), ingest.clean_strand(F.col("strand1")).alias("strand1"), ingest.clean_strand(F.col("strand2")).alias("strand2"), ingest.clean_count(F.col("cnt")).alias("cnt"),
    )
    return ingest.encode_contacts(raw, dividend)


def follow(spark: SparkSession, folder: str, table: str, state: str, dataset: str, dividend: int, layout: str | None = None):
    """Start appending the folder's new files to the table, each exactly once (state holds
    the stream's progress); returns the running query, which stops when nothing is new."""
    stream = parsed(spark.readStream.text(folder), dataset, dividend, layout)
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", state).partitionBy("dataset").trigger(availableNow=True).start()


def follow_into(store: Store, folder: str, state: str, dataset: str, files_per_batch: int | None = None, **ingested):
    """Start adding the folder's new files to a dataset of a store, and return the running
    query, which stops when nothing is new. ingested goes on to contacts_of_files(), so
    layouts, groups of lines, alternative loci and categories are those of a batch ingest.

    The source never splits a file over batches, so no group of lines is open at the end of
    one. A batch's name follows from state and its number: if it runs again after a failure
    its tables are written anew, and if the manifest already has it nothing happens.
    """
    lines = store.spark.readStream.format("text")
    lines = (lines.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else lines).load(folder)

    def add(part: DataFrame, number: int) -> None:
        found = sorted(r["file"] for r in part.distinct().collect())  # the new files of a batch
        if found:
            name = hashlib.sha256(f"{state} {number}".encode()).hexdigest()[:32]
            store.add(dataset, files.contacts_of_files(store.spark, found, dataset, store.contigs, store.dividend, **ingested), name)

    return lines.select(F.col("_metadata.file_path").alias("file")).writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
