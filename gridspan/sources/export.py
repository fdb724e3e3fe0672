"""Sinks: heatmaps and tracks as tables of text, sessions as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_heatmap(rows: DataFrame, path: str) -> None:
    """Tab-parted chr_x, start_x, end_x, chr_y, start_y, end_y, score with a header."""
    rows.select("chr_x", "start_x", "end_x", "chr_y", "start_y", "end_y", "score").write.option("sep", "\t").option("header", True).csv(path)


def read_heatmap(spark, path: str) -> DataFrame:
    schema = "chr_x string, start_x long, end_x long, chr_y string, start_y long, end_y long, score double"
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def write_track(rows: DataFrame, path: str) -> None:
    """Tab-parted chr, start, end, v1, ..., vn with a header."""
    rows.drop("idx").write.option("sep", "\t").option("header", True).csv(path)


def write_contacts(rows: DataFrame, path: str) -> None:
    """Encoded contacts as a table by dataset, sorted so that contig pairs prune."""
    rows.repartition("dataset", "chr_x", "chr_y").sortWithinPartitions("chr_x", "chr_y", "x_s").write.partitionBy("dataset").mode("append").parquet(path)
