"""Deterministic samples: an order of whole numbers that begins with a coarse grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.staging import staged

from . import intervals


def two_power(x: Column) -> Column:
    """The largest power of two that divides x; of 0 a value below all."""
    return F.when(x == 0, F.lit(0)).otherwise(x.bitwiseAND(-x)).cast("long")


def coarse_first(x: str = "x") -> list[Column]:
    """Order by dividing power of two, largest first; then by value; 0 comes last."""
    return [two_power(F.col(x)).desc(), F.col(x).asc()]


def numbered(rows: DataFrame, order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """rows with name, their place from 1 in this order. Rows are dealt to ranges of the order,
    each range is numbered by itself, and the counts of those before are added: no task
    sees more than its range. The ranges are a staged table, as a second draw of their
    bounds could differ."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = staged(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = ranges.groupBy("_range").count().select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + own).cast("long")).drop("_range", "_start")


def take(rows: DataFrame, n: int, x: str = "x", key: str | None = None) -> DataFrame:
    """The first n rows in coarse order; of rows with one key the first counts."""
    if key is not None:
        rows = first_of(rows, x, key)
    return rows.orderBy(*coarse_first(x)).limit(n)


def first_of(rows: DataFrame, x: str, key: str) -> DataFrame:
    """Of rows with one key the first in coarse order."""
    w = Window.partitionBy(key).orderBy(*coarse_first(x))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def representative(rows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Of each group the value that comes first in coarse order."""
    best = F.max_by(F.col(x), F.struct(two_power(F.col(x)), -F.col(x)))
    return rows.groupBy(*keys).agg(best.alias(x))


def spaced_bins(contigs: DataFrame, size: int, n: int) -> DataFrame:
    """Bins of one size at even distances over all contigs, n of them at most: chr, ord, pos."""
    total = contigs.agg(F.sum("len").alias("total"))
    step = contigs.crossJoin(F.broadcast(total)).withColumn("step", F.greatest(F.lit(size).cast("long"), F.floor(F.col("total") / n).cast("long")))
    bins = step.filter(F.col("len") >= size).withColumn("pos", F.explode(F.expr(f"sequence(0L, len - {size}, step)")))
    return bins.select("chr", "ord", "pos").orderBy("ord", "pos").limit(n)


def without_overlap(samples: DataFrame, bins: DataFrame) -> DataFrame:
    """Samples (chr, pos, size) that touch none of the bins (chr, pos, size), then the bins."""
    span = lambda d: d.select("chr", "pos", "size", F.col("pos").alias("low"), (F.col("pos") + F.col("size")).alias("high"))
    touching = intervals.overlaps(span(samples.distinct()), span(bins).select("chr", "low", "high"), []).select("chr", "pos", "size")
    apart = samples.join(touching, ["chr", "pos", "size"], "left_anti")
    return apart.withColumn("is_sample", F.lit(True)).unionByName(bins.select("chr", "pos", "size").withColumn("is_sample", F.lit(False)))
