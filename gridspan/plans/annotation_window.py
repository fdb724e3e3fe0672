"""Annotations as an axis of a heatmap: their sub-intervals side by side, cut into bins.

Places on such an axis are units of annotated genome (separate, stretch) or numbers of
sub-intervals (squeeze), over the contigs in display order. Bins are walked one after the
other, as each begins where the one before ends on the screen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspan.plans.annotation_axis import BIN_RULES, MULTI_RULES

_BINS = "idx long, chr string, actual string, ord int, index_pos long, index_size long, screen_pos long, screen_size long"


def _most_even(low: int, high: int) -> int:
    """Of the numbers low to high - 1 that which the largest power of two divides; 0 counts least, and of equals the first."""
    for k in range(high.bit_length(), -1, -1):
        at = max(1, -(-low >> k)) << k
        if at < high:
            return at
    return low


def walk(spans: pd.DataFrame, at: int, end: int, total: int, size: int, across: str, several: str) -> Iterator[tuple[int, int, int, int]]:
    """(index_pos, index_size, screen_pos, screen_size) of the bins of one contig from place at
    to end, and last how far the walk came, as (-1, 0, place, 0).

    spans are its sub-intervals in order: i_s, i_e, coord_s, coord_e, interval_id, row_from (how
    many annotations are active in those before) and rows (in this one).
    """
    start, stop, low, high, number, row, rows = (spans[c].to_numpy() for c in ("i_s", "i_e", "coord_s", "coord_e", "interval_id", "row_from", "rows"))
    squeeze = across == "squeeze"
    begin = number if squeeze else low
    while at < end:
        i = int(np.searchsorted(number, at)) if squeeze else int(np.searchsorted(high, at, side="right"))
        j = int(np.searchsorted(begin, at + size))
        if i >= j:
            at = total
            break
        while i < j:
            last = j - 1
            pos = int(start[i] + at - begin[i])
            shown = int(high[last] - low[i])
            if several == "combine":
                length = int(stop[last]) - pos
            elif several == "max_fac_pow_two":
                pick = i if i == last else int(np.searchsorted(row, _most_even(int(row[i]), int(row[last] + rows[last])), side="right")) - 1
                pos = max(0, int(start[pick] + at - low[pick])) if across == "separate" else int(start[pick])
                length = int(stop[pick]) - pos
            else:
                length = int(stop[i]) - pos
                shown = length if several == "force_separate" else shown
            if across == "separate":
                gap = int((start[last] - stop[i]) - (low[last] - high[i]))
                length, shown = min(size + gap, length), min(size, shown)
            elif squeeze:
                shown = 1 if several == "force_separate" else int(row[last] + rows[last] - row[i])
            yield pos, length, at, shown
            at += shown
            i = i + 1 if several == "force_separate" else j
    yield -1, 0, at, 0


@dataclass(frozen=True)
class AnnotationAxis:
    """table: idx, chr, actual, ord, index_pos, index_size, screen_pos, screen_size. Bins may
    overlap on the genome. extents: chr, base, total of the contigs' places."""

    table: DataFrame
    extents: DataFrame

    def bins(self) -> DataFrame:
        return self.table.drop("actual")

    def copies(self) -> DataFrame:
        """chr and actual of the displayed contigs."""
        return self.table.select("chr", "actual").distinct()

    def side(self, s: str) -> DataFrame:
        """Bins with their columns named for one side of a heatmap."""
        return self.table.select(F.col("idx").alias(f"{s}i"), F.col("chr").alias(f"chr_{s}"), F.col("index_pos").alias(f"{s}_pos"), F.col("index_size").alias(f"{s}_size"), F.col("actual").alias(f"actual_{s}"))

    def size(self) -> DataFrame:
        """One row: the number of bins."""
        return self.table.agg(F.count(F.lit(1)).alias("bins"))

    def spans(self) -> DataFrame:
        """idx, chr (the actual contig), low, high of the bins, for interval joins."""
        return self.table.filter("index_size > 0").select("idx", F.col("actual").alias("chr"), F.col("index_pos").alias("low"), (F.col("index_pos") + F.col("index_size")).alias("high"))


def annotation_bins(sweep: DataFrame, contigs: DataFrame, size: int, across: str = "stretch", several: str = "combine", window: tuple[int, int] | None = None) -> AnnotationAxis:
    """The axis of one annotation: sweep are its line_sweep() rows, contigs (chr, ord, len) are
    in display order and may have actual; window is in places of the axis.

    across tells what an annotation that is longer than a bin does: separate cuts it into
    bins, stretch makes the bin as long as it is, squeeze gives every sub-interval one place.
    several tells what a bin with several sub-intervals shows: combine spans all of them,
    first and max_fac_pow_two show one, force_separate gives each its own bin.

    The sub-intervals of the window are walked in one task: they are disjoint, so they are
    no more than the window has units, or places under squeeze.
    """
    if across not in BIN_RULES or several not in MULTI_RULES:
        raise ValueError(f"rules are {BIN_RULES} and {MULTI_RULES}")
    size = max(1, size)
    if "actual" not in contigs.columns:
        contigs = contigs.withColumn("actual", F.col("chr"))
    order = Window.partitionBy("chr").orderBy("interval_id").rowsBetween(Window.unboundedPreceding, -1)
    spans = sweep.groupBy("chr", "interval_id", "i_s", "i_e", "coord_s", "coord_e").agg(F.count(F.lit(1)).alias("rows"))
    spans = spans.withColumn("row_from", F.coalesce(F.sum("rows").over(order), F.lit(0)))
    begin, end = ("interval_id", F.col("interval_id") + 1) if across == "squeeze" else ("coord_s", F.col("coord_e"))
    totals = spans.groupBy(F.col("chr").alias("actual")).agg(F.max(end).cast("long").alias("total"))
    shown = contigs.select("chr", "actual", "ord").join(totals, "actual")
    before = F.sum("total").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    shown = shown.withColumn("base", F.coalesce(before, F.lit(0)).cast("long"))
    low, high = (max(0, window[0]), max(0, window[1])) if window else (0, 1 << 62)
    rows = spans.withColumnRenamed("chr", "actual").join(shown, "actual").filter((F.col("base") + end > low) & (F.col("base") + F.col(begin) < high + size))

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        out, at = [], low
        for (number, base), one in part.sort_values(["ord", "interval_id"]).groupby(["ord", "base"]):
            name, actual, total = one["chr"].iloc[0], one["actual"].iloc[0], int(one["total"].iloc[0])
            if at < base:  # nothing between is annotated
                continue
            for pos, length, place, shown in walk(one, at - base, min(high - base, total), total, size, across, several):
                if pos >= 0:
                    out.append((len(out), name, actual, number, pos, length, place + base, shown))
                else:
                    at = max(at, place + base)
        return pd.DataFrame(out, columns=["idx", "chr", "actual", "ord", "index_pos", "index_size", "screen_pos", "screen_size"])

    return AnnotationAxis(rows.withColumn("axis", F.lit(0)).groupBy("axis").applyInPandas(cut, _BINS), shown.select("chr", "base", "total"))
