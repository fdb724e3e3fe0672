"""Viewpoints: a part of the concatenated contigs as one bin for each contig that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.plans.annotation_window import AnnotationAxis
from gridspan.plans.axis import Axis, offsets


def _clipped(contigs: DataFrame, low: int, high: int) -> DataFrame:
    if "actual" not in contigs.columns:
        contigs = contigs.withColumn("actual", F.col("chr"))
    rows = offsets(contigs).filter((F.col("offset") + F.col("len") >= low) & (F.col("offset") <= high))
    begin, end = F.greatest(F.lit(low).cast("long"), F.col("offset")), F.least(F.lit(high).cast("long"), F.col("offset") + F.col("len"))
    return rows.withColumns({"from": begin - F.col("offset"), "to": end - F.col("offset")})


def viewpoint_axis(contigs: DataFrame, low: int, high: int) -> Axis:
    """Bins of the viewpoint low..high, in display order. A contig that it only borders on has an empty one."""
    first = F.row_number().over(Window.orderBy("ord")) - 1  # contigs are few
    rows = _clipped(contigs, low, high).withColumn("first", first.cast("long"))
    step = F.greatest(F.lit(1).cast("long"), F.col("to") - F.col("from"))
    return Axis(rows.select("chr", "actual", "ord", step.alias("step"), F.col("from").alias("origin"), F.lit(1).cast("long").alias("n"), "first", F.col("to").alias("stop"), "offset"))


def viewpoint_places(contigs: DataFrame, low: int, high: int, axis: Axis | AnnotationAxis) -> DataFrame:
    """chr, index_pos, index_size, screen_pos, screen_size of a viewpoint's bins: where each lies
    on the screen of an axis, whose bins on the contig it is mapped through. Ends between
    bins go to the end of the bin before, ends beyond all bins to the contig's own."""
    bins = axis.bins().select("chr", "idx", "index_pos", (F.col("index_pos") + F.col("index_size")).alias("stop"), "screen_pos", (F.col("screen_pos") + F.col("index_size" if isinstance(axis, Axis) else "screen_size")).alias("screen_end"))
    extents = axis.extents if isinstance(axis, AnnotationAxis) else offsets(contigs).select("chr", F.col("offset").alias("base"), F.col("len").alias("total"))
    # contigs without a place on the axis begin where those before end
    rows = _clipped(contigs, low, high).select("chr", "ord", "from", "to").join(extents, "chr", "left")
    met = rows.join(bins, "chr", "left")

    def seen(end: str) -> list[Column]:
        at = F.col(end)
        inside = (F.col("index_pos") <= at) & (at <= F.col("stop"))
        return [
            F.max_by(F.when(inside, F.least(at - F.col("index_pos") + F.col("screen_pos"), F.col("screen_end"))), F.when(inside, F.col("idx"))).alias(f"in_{end}"),
            F.max(F.when(at > F.col("stop"), F.col("screen_end"))).alias(f"before_{end}"),
            F.min(F.when(at < F.col("index_pos"), F.col("screen_pos"))).alias(f"after_{end}"),
        ]

    found = met.groupBy("chr", "ord", "from", "to", "base", "total").agg(*seen("from"), *seen("to"))

    def place(end: str, edge: Column) -> Column:
        return F.coalesce(f"in_{end}", F.least(F.greatest(edge, f"before_{end}"), f"after_{end}"))  # nulls don't count

    begin, stop = place("from", F.col("base")), place("to", F.col("base") + F.col("total"))
    return found.select("chr", F.col("from").alias("index_pos"), (F.col("to") - F.col("from")).alias("index_size"), begin.alias("screen_pos"), (stop - begin).alias("screen_size"))
