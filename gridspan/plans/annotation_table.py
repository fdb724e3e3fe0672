"""The annotations beside an axis as a table: one row for each, or how many a bin has."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspan.functions import text
from gridspan.operators import intervals
from gridspan.plans.annotation_window import AnnotationAxis
from gridspan.plans.axis import Axis
from gridspan.staging import staged

#: With so many sub-intervals in view, bins are counted instead of showing each annotation.
MOST_DETAILED = 1000
#: The order of annotations within a region.
PLACE = ("first", "start_bp", "end_bp", "desc_id")
#: Units that annotations of one row are apart.
APART = 2
#: The part of a row's height that stays empty.
MARGIN = 0.05


def regions(axis: Axis | AnnotationAxis, squeeze: bool = False) -> DataFrame:
    """region, chr, actual, index_pos, index_size, screen_pos, screen_size: runs of bins that lie
    side by side on one contig. Under squeeze every bin is one, as places aren't units then.
    The window is over a planned axis, whose bins the interface bounds."""
    bins = axis.bins().join(axis.copies(), "chr")
    if "screen_size" not in bins.columns:
        bins = bins.withColumn("screen_size", F.col("index_size"))
    w = Window.orderBy("idx")
    goes_on = (F.lag("chr").over(w) == F.col("chr")) & (F.lag(F.col("index_pos") + F.col("index_size")).over(w) == F.col("index_pos"))
    new = F.lit(1) if squeeze else F.when(goes_on, 0).otherwise(1)
    runs = bins.withColumn("_new", new).withColumn("region", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy("region", "chr", "actual").agg(F.min_by("index_pos", "idx").alias("index_pos"), F.sum("index_size").alias("index_size"), F.min("screen_pos").alias("screen_pos"), F.sum("screen_size").alias("screen_size"))


def _spans(sweep: DataFrame, types: list[str]) -> DataFrame:
    return sweep.filter(F.col("type").isin(*types)).select("type", "chr", F.col("i_s").alias("low"), F.col("i_e").alias("high"), "interval_id", "desc_id", "forw")


def _places(bins: DataFrame) -> DataFrame:
    """bins or regions as intervals on the actual contig, for a join."""
    return bins.select(*[F.col(c).alias(f"b_{c}") for c in bins.columns], F.col("actual").alias("chr"), F.col("index_pos").alias("low"), (F.col("index_pos") + F.col("index_size")).alias("high"))


def packed(shown: DataFrame) -> DataFrame:
    """shown (type, region, place, start, end, ...) with row: the first whose last annotation
    ends APART before, in order of regions and PLACE. Spark sorts; the task of a type then streams through it and holds no more than where each row ends."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind, ends = None, FirstFit()
        for part in parts:
            rows = []
            for each, start, end in zip(part["type"], part["screen_start"], part["screen_end"], strict=True):
                if each != kind:
                    kind, ends = each, FirstFit()
                rows.append(ends.place(start, end + APART))
            yield part.assign(row=rows)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema)
    return shown.repartition("type").sortWithinPartitions("type", "region", *PLACE).mapInPandas(pack, f"{kinds}, row int")


class FirstFit:
    """The ends of rows as a tree of minima: the first row that ends early enough is found in
    steps as many as the logarithm of the rows."""

    def __init__(self) -> None:
        self.size, self.least, self.rows = 1, [math.inf, math.inf], 0

    def place(self, start: float, end: float) -> int:
        """The first row that ends at start or before, or a new one; it ends at end from now on."""
        least, at = self.least, 1
        if least[1] <= start:
            while at < self.size:
                at *= 2
                if least[at] > start:
                    at += 1
            row = at - self.size
        else:
            row = self.rows
            self.rows += 1
            if row == self.size:
                held = least[self.size :] + [math.inf] * self.size
                self.size *= 2
                self.least = least = [math.inf] * self.size + held
                for n in range(self.size - 1, 0, -1):
                    least[n] = min(least[2 * n], least[2 * n + 1])
        at = row + self.size
        least[at] = end
        while at > 1:
            at //= 2
            least[at] = min(least[2 * at], least[2 * at + 1])
        return row


def annotation_table(sweep: DataFrame, annotations: DataFrame, axis: Axis | AnnotationAxis, types: list[str], dividend: int, most: int | None = MOST_DETAILED, squeeze: bool = False, margin: float = MARGIN) -> DataFrame:
    """type, chr, index_start, index_end (readable), screen_start, screen_end, num_anno, row,
    offset, height, strand, id, desc, info.

    With fewer than most sub-intervals (line_sweep() rows) in view, a row is an annotation in
    a region of the axis (once in each), packed so that none covers another; offset and
    height place it around the middle of its type's strip. Otherwise a row is a bin with the
    number of sub-intervals that touch it, and what belongs to one annotation is null. The
    choice takes one job that counts up to most; None shows each annotation, however many.
    """
    runs = regions(axis, squeeze)
    keep = [f"b_{c}" for c in runs.columns]
    met = intervals.overlaps(_spans(sweep, types), _places(runs), keep)
    at = lambda c: text.readable_bp(F.col(c) * dividend)
    if most is not None and met.limit(most).count() >= most:
        bins = axis.bins().join(axis.copies(), "chr")
        if "screen_size" not in bins.columns:
            bins = bins.withColumn("screen_size", F.col("index_size"))
        hits = intervals.overlaps(_spans(sweep, types), _places(bins), [f"b_{c}" for c in bins.columns])
        rows = hits.groupBy("type", "b_idx", "b_chr", "b_index_pos", "b_index_size", "b_screen_pos", "b_screen_size").agg(F.count(F.lit(1)).alias("num_anno"))
        rows = rows.withColumn("b_end", F.col("b_index_pos") + F.col("b_index_size"))
        none = lambda name, kind: F.lit(None).cast(kind).alias(name)
        return rows.select(
            "type", F.col("b_chr").alias("chr"), at("b_index_pos").alias("index_start"), at("b_end").alias("index_end"), F.col("b_screen_pos").cast("double").alias("screen_start"), (F.col("b_screen_pos") + F.col("b_screen_size")).cast("double").alias("screen_end"), "num_anno",
            none("row", "int"), F.lit(0.0).alias("offset"), F.lit((1 - margin) ** 2).alias("height"), none("strand", "string"), none("id", "string"), none("desc", "string"), none("info", "string"),
        )
    once = met.groupBy("type", "desc_id", *keep).agg(F.min("interval_id").alias("first"), F.first("forw").alias("forw"))
    once = once.join(annotations.select("type", "desc_id", "start_bp", "end_bp", "info"), ["type", "desc_id"])
    low, top = F.col("b_screen_pos").cast("double"), (F.col("b_screen_pos") + F.col("b_screen_size")).cast("double")
    if squeeze and isinstance(axis, AnnotationAxis):
        start, end = low, top
    else:
        moved = lambda c: F.greatest(F.lit(0.0), F.col(c) / dividend - F.col("b_index_pos")) + low
        start, end = moved("start_bp"), F.least(moved("end_bp"), top)
    shown = once.withColumns({"screen_start": start, "screen_end": end}).filter("screen_end >= screen_start")
    shown = shown.select("type", F.col("b_region").alias("region"), F.col("b_chr").alias("chr"), *PLACE, "screen_start", "screen_end", "forw", "info")
    rows = packed(shown)
    rows = staged(rows, "packed")  # packed once, though its depth is asked for beside
    depths = rows.groupBy("type").agg((F.max("row") + 1).alias("_rows"))  # a row for each type
    deepest = rows.agg(F.max("row").alias("_deepest"))
    height = (1 - margin) / (F.col("_deepest") + 1)
    sign = F.when(F.col("row") % 2 == 0, 1.0).otherwise(-1.0)
    offset = sign * height * F.expr("(row + 1) div 2") + F.when(F.col("_rows") % 2 == 0, height / 2).otherwise(0.0)
    lines = F.split("info", "\n", -1)
    other = F.filter(lines, lambda x: ~x.startswith("ID=") & ~x.startswith("description="))
    named = lambda key: F.when(F.exists(lines, lambda x: x.startswith(f"{key}=")), text.gff_attribute(F.col("info"), key))
    rows = rows.join(F.broadcast(depths), "type").crossJoin(F.broadcast(deepest))  # a single row
    return rows.select(
        "type", "chr", text.readable_bp(F.col("start_bp")).alias("index_start"), text.readable_bp(F.col("end_bp")).alias("index_end"), "screen_start", "screen_end", F.lit(1).cast("long").alias("num_anno"),
        "row", offset.alias("offset"), (height * (1 - margin)).alias("height"), F.when(F.col("forw"), "+").otherwise("-").alias("strand"), named("ID").alias("id"), named("description").alias("desc"), F.array_join(other, "\n").alias("info"),
    )
