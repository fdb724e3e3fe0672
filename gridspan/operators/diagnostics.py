"""What is in a set of reads or annotations, in numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import MAX_CATEGORIES


def unique_interactions(reads: DataFrame, contigs: DataFrame, dividend: int, order: list[str]) -> DataFrame:
    """(dataset, interactions, unique_interactions, per_kb2): reads, those whose places differ
    from the read before of the same contig pair, in order of places and then of order's
    columns, and reads for each square kilobase of all contigs."""
    w = Window.partitionBy("dataset", "chr_x", "chr_y").orderBy("pos1_s", "pos2_s", *order)
    new = F.lag("pos1_s").over(w).isNull() | (F.lag("pos1_s").over(w) != F.col("pos1_s")) | (F.lag("pos2_s").over(w) != F.col("pos2_s"))
    length = contigs.agg((F.sum("len") * (dividend / 1000.0)).alias("kb"))
    rows = reads.withColumn("new", new).groupBy("dataset").agg(F.count(F.lit(1)).alias("interactions"), F.count_if("new").alias("unique_interactions"))
    return rows.crossJoin(F.broadcast(length)).select("dataset", "interactions", "unique_interactions", F.try_divide("interactions", F.col("kb") * F.col("kb")).alias("per_kb2"))  # a single row


def multimapper_histogram(loci: DataFrame, read: list[str], chr_col: str = "chr_x") -> DataFrame:
    """(n_maps, n_contigs, n_reads): how many reads have so many loci on so many contigs."""
    each = loci.groupBy(*read).agg(F.count(F.lit(1)).alias("n_maps"), F.countDistinct(chr_col).alias("n_contigs"))
    return each.groupBy("n_maps", "n_contigs").agg(F.count(F.lit(1)).alias("n_reads"))


def pair_sizes(contacts: DataFrame) -> DataFrame:
    """(dataset, chr_x, chr_y, n_reads, n_boxes): reads, and those among them of several loci."""
    return contacts.groupBy("dataset", "chr_x", "chr_y").agg(F.count(F.lit(1)).alias("n_reads"), F.count_if(F.expr("x_s < x_e or y_s < y_e")).alias("n_boxes"))


def annotation_totals(sweep: DataFrame) -> DataFrame:
    """(type, chr, total_size, intervals) of line_sweep() rows: annotated units, and sub-intervals."""
    return sweep.groupBy("type", "chr").agg((F.max("coord_e") - F.min("coord_s")).alias("total_size"), (F.max("interval_id") + 1).cast("int").alias("intervals"))


def filterable(annotations: DataFrame, asked: list[str]) -> list[str]:
    """The annotations asked for that occur, in the order asked; the first is the coordinate
    annotation. More than a read's codes can hold are an error."""
    found = {r["type"] for r in annotations.filter(F.col("type").isin(*asked)).select("type").distinct().collect()} if asked else set()
    kept = [a for a in dict.fromkeys(asked) if a in found]
    if len(kept) > MAX_CATEGORIES:
        raise ValueError(f"at most {MAX_CATEGORIES} annotations can be filtered: {', '.join(kept)}")
    return kept


def coverage_scaled(value: Column, how: str, total: Column, area: Column) -> Column:
    """A coverage as it is (dont), by a million or a thousand of all reads (rpm, rpk), or by as
    many units of area (rpmb, rpkb); 0 of nothing."""
    by = {"rpm": (1e6, total), "rpk": (1e3, total), "rpmb": (1e6, area), "rpkb": (1e3, area)}
    if how == "dont":
        return value.cast("double")
    unit, over = by[how]
    return F.when(over == 0, 0.0).otherwise(F.try_divide(unit * value, over))
