"""Axes of annotations: the genome with everything between annotations left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspan.operators.sampling import two_power

BIN_RULES = ("separate", "stretch", "squeeze")
MULTI_RULES = ("combine", "first", "max_fac_pow_two", "force_separate")


def annotation_axis(intervals: DataFrame, size: int, across: str = "stretch", several: str = "combine") -> DataFrame:
    """Bins (chr, coord, index_pos, index_size, screen_size, idx) over line-sweep intervals.

    across tells what an annotation longer than a bin does: separate cuts it into bins,
    stretch makes the bin as long as it, squeeze gives every interval the same room.
    several tells what a bin with several intervals shows: combine spans all of them,
    first and max_fac_pow_two show one, force_separate gives each a bin of its own.
    Bins may overlap on the genome; count with region_counts().
    """
    if across not in BIN_RULES or several not in MULTI_RULES:
        raise ValueError(f"rules are {BIN_RULES} and {MULTI_RULES}")
    rows = intervals.select("chr", "interval_id", "i_s", "i_e", "coord_s", "coord_e").distinct()
    place = F.col("interval_id").cast("long") if across == "squeeze" else F.col("coord_s")
    extent = F.lit(1).cast("long") if across == "squeeze" else F.col("i_e") - F.col("i_s")
    if several == "force_separate":
        bins = rows.select("chr", place.alias("coord"), F.col("i_s").alias("index_pos"), (F.col("i_e") - F.col("i_s")).alias("index_size"), extent.alias("screen_size"))
    else:
        grouped = rows.withColumn("k", F.floor(place / size).cast("long") * size).groupBy("chr", F.col("k").alias("coord"))
        one = F.struct("i_s", "i_e")
        if several == "combine":
            bins = grouped.agg(F.min("i_s").alias("index_pos"), (F.max("i_e") - F.min("i_s")).alias("index_size"), F.sum(extent).alias("screen_size"))
        else:
            picked = F.min_by(one, F.col("coord_s")) if several == "first" else F.max_by(one, F.struct(two_power(F.col("interval_id")), -F.col("interval_id")))
            bins = grouped.agg(picked.alias("one")).select("chr", "coord", F.col("one.i_s").alias("index_pos"), (F.col("one.i_e") - F.col("one.i_s")).alias("index_size"))
            bins = bins.withColumn("screen_size", F.lit(1).cast("long") if across == "squeeze" else F.col("index_size"))
    if across == "separate":
        cut = bins.withColumn("p", F.explode(F.expr(f"sequence(0L, index_size - 1, {size}L)")))
        length = F.least(F.lit(size).cast("long"), F.col("index_size") - F.col("p"))
        bins = cut.select("chr", (F.col("coord") + F.col("p")).alias("coord"), (F.col("index_pos") + F.col("p")).alias("index_pos"), length.alias("index_size"), length.alias("screen_size"))
    return bins.withColumn("idx", F.row_number().over(Window.orderBy("chr", "coord", "index_pos")) - 1)
