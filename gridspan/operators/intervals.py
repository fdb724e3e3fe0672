"""Joins of positions and intervals with intervals, by equality on cells of their own size.

The level of an interval is the least power of two that is as long as it. Cells of that size
part the contig, and an interval touches two of its level at most, however long it is. So an
index has at most two rows for each interval, a position looks once at each level that
occurs, and what is met without a match is in proportion to what matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(length: Column) -> Column:
    """The number of the smallest power of two that isn't below length."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")


def _cells(low: str, last: str, at: str) -> Column:
    return F.sequence(F.expr(f"shiftright({low}, {at})"), F.expr(f"shiftright({last}, {at})"))


def indexed(intervals: DataFrame, low: str, high: str) -> DataFrame:
    """intervals with _level and _cell, once for each of the one or two cells that low..high - 1
    touches; empty intervals have none."""
    rows = intervals.filter(F.col(high) > F.col(low)).withColumn("_level", level(F.col(high) - F.col(low)))
    return rows.withColumn("_last", F.col(high) - 1).withColumn("_cell", F.explode(_cells(low, "_last", "_level"))).drop("_last")


def levels_of(intervals: DataFrame, low: str, high: str) -> DataFrame:
    """One row: the levels that occur, 64 at most."""
    return intervals.filter(F.col(high) > F.col(low)).agg(F.array_sort(F.collect_set(level(F.col(high) - F.col(low)))).alias("_levels"))


def _looking(rows: DataFrame, levels: DataFrame, low: str, last: str, least: Column) -> DataFrame:
    """rows with _level and _cell for each of the levels from least on."""
    each = rows.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode(F.filter("_levels", lambda k: k >= least))).drop("_levels")  # a single row
    return each.withColumn("_cell", F.explode(_cells(low, last, "_level")))


def inside(rows: DataFrame, on: str, start: str, end: str, intervals: DataFrame, keep: dict[str, str], chr_col: str = "chr", low: str = "low", high: str = "high") -> DataFrame:
    """rows, once for every interval low <= start and end < high on their contig (column on),
    with the columns of intervals that keep renames. Ends are inclusive in rows."""
    found = indexed(intervals, low, high).select(F.col(chr_col).alias("_c"), F.col(low).alias("_l"), F.col(high).alias("_h"), "_level", "_cell", *[F.col(c).alias(name) for c, name in keep.items()])
    asked = _looking(rows, levels_of(intervals, low, high), start, start, level(F.col(end) - F.col(start) + 1))
    within = (F.col(start) >= F.col("_l")) & (F.col(end) < F.col("_h"))
    met = asked.join(found.withColumnsRenamed({"_level": "_lv", "_cell": "_ce"}), (F.col(on) == F.col("_c")) & (F.col("_level") == F.col("_lv")) & (F.col("_cell") == F.col("_ce")) & within)
    return met.drop("_c", "_l", "_h", "_level", "_cell", "_lv", "_ce")


def overlaps(left: DataFrame, right: DataFrame, keep: list[str]) -> DataFrame:
    """Every pair of intervals (chr, low, high, half open) of left and right that share a unit,
    with all of left's columns and those of right in keep (none of which left has).

    A pair meets at the level of its longer interval, in the cell where it begins to overlap.
    """
    r = right.select(F.col("chr").alias("_c"), F.col("low").alias("_l"), F.col("high").alias("_h"), *keep)
    out = None
    for longer_left in (True, False):
        own = indexed(left, "low", "high") if longer_left else indexed(r, "_l", "_h")
        other, low, high = (r, "_l", "_h") if longer_left else (left, "low", "high")
        levels = levels_of(left, "low", "high") if longer_left else levels_of(r, "_l", "_h")
        mine = level(F.col(high) - F.col(low))
        asked = other.filter(F.col(high) > F.col(low)).withColumn("_last", F.col(high) - 1)
        asked = _looking(asked, levels, low, "_last", mine if longer_left else mine + 1).drop("_last")
        asked = asked.withColumnsRenamed({"_level": "_lv", "_cell": "_ce"})
        begin = F.expr("shiftright(greatest(low, _l), _level)") == F.col("_cell")
        met = own.join(asked, (F.col("chr") == F.col("_c")) & (F.col("_level") == F.col("_lv")) & (F.col("_cell") == F.col("_ce")) & (F.col("low") < F.col("_h")) & (F.col("_l") < F.col("high")) & begin)
        met = met.select(*left.columns, *keep)
        out = met if out is None else out.union(met)
    return out
