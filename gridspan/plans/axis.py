"""Axes: how a window over the contigs is cut into bins.

An axis is planned as a small table, one row per contig, from which both the bins and
the bin of any position follow by integer arithmetic. Contigs are few, so these tables
are local relations that Spark knows the size of.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How the end of a contig that a bin would cross is treated.
CUT_OFF = ("smaller", "larger", "skip", "fit_chrom_smaller", "fit_chrom_larger", "cover_multiple")


def snap_up(x: float, factors: tuple[float, ...] | None) -> int:
    """The next whole number, or the next of the round numbers factor * 10 ** n above x."""
    if not factors:
        return math.ceil(x)
    scale = 1
    while True:
        for f in factors:
            if f * scale > x:
                return int(f * scale)
        scale *= 10


def least_bin(setting: int, dividend: int) -> int:
    """The slider's position as a bin size: 1 to 9 times a power of ten, in dividend units."""
    return max(1, (1 + setting % 9) * 10 ** (setting // 9) // dividend)


def bin_size(area: tuple[int, int, int, int], s: dict, dividend: int) -> tuple[int, int]:
    """(width, height) for the area (x start, x end, y start, y end) under the interface
    settings s; a fixed number of bins goes before a fixed size, that before the budget of
    bins, for which bins are squares unless squared_bins is off."""
    w, h = area[1] - area[0], area[3] - area[2]
    least, most = least_bin(s["min_bin_size"], dividend), s["max_num_bins"] * s["max_num_bins_factor"]
    factors = tuple(s["snap_factors"]) if s["snap_bin_size"] else None
    if s["fixed_number_of_bins"]:
        return max(1, int(w / s["fixed_num_bins_x"])), max(1, int(h / s["fixed_num_bins_y"]))
    if s["fixed_bin_size"]:
        return max(1, s["fixed_bin_size_x"]), max(1, s["fixed_bin_size_y"])
    if s["squared_bins"]:
        both = max(least, snap_up(math.sqrt(w * h // most), factors))
        return both, both
    return max(least, snap_up(w / math.sqrt(most), factors)), max(least, snap_up(h / math.sqrt(most), factors))


def render_area(area: tuple[int, int, int, int], size: tuple[int, int], margin: float, genome: int, full: bool = False) -> tuple[int, int, int, int]:
    """The drawn window: the area with a margin (percent of its extent) on every side, cut
    down to whole bins; all contigs if full."""
    if full:
        return 0, genome, 0, genome
    out = []
    for low, high, b in ((area[0], area[1], size[0]), (area[2], area[3], size[1])):
        extra = int((high - low) * margin / 100)
        out += [(x // b) * b for x in (low - extra, high + extra)]
    return tuple(out)


@dataclass(frozen=True)
class Axis:
    """grid: chr, actual (the contig that a displayed copy shows), ord, step, origin (position
    of the first bin in its contig), n (bins), first (number of the first bin), stop (end of
    the last bin), offset (of the contig)."""

    grid: DataFrame

    def bins(self) -> DataFrame:
        """idx, chr, ord, index_pos, index_size, screen_pos, of each bin in order."""
        k = self.grid.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        start = F.col("origin") + F.col("k") * F.col("step")
        return k.select(
            (F.col("first") + F.col("k")).alias("idx"),
            "chr",
            "ord",
            start.alias("index_pos"),
            F.when(F.col("k") == F.col("n") - 1, F.col("stop") - start).otherwise(F.col("step")).alias("index_size"),
            (F.col("offset") + start).alias("screen_pos"),
        )

    def place(self, side: str) -> DataFrame:
        """The grid with its columns named for one side of a join, by the contigs that reads
        lie on: copies of a contig all get its reads."""
        return self.grid.select(F.col("actual").alias(f"{side}_chr"), *[F.col(c).alias(f"{side}_{c}") for c in ("step", "origin", "n", "first", "stop")])

    def copies(self) -> DataFrame:
        """chr and actual of the displayed contigs."""
        return self.grid.select("chr", "actual")

    def side(self, s: str) -> DataFrame:
        """Bins with their columns named for one side of a heatmap."""
        copies = self.copies().withColumnsRenamed({"chr": "_c", "actual": f"actual_{s}"})
        bins = self.bins().select(F.col("idx").alias(f"{s}i"), F.col("chr").alias(f"chr_{s}"), F.col("index_pos").alias(f"{s}_pos"), F.col("index_size").alias(f"{s}_size"))
        return bins.join(copies, F.col(f"chr_{s}") == F.col("_c")).drop("_c")

    def size(self) -> DataFrame:
        """One row: the number of bins."""
        return self.grid.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bins"))


def offsets(contigs: DataFrame) -> DataFrame:
    """contigs with offset: the lengths of those before, in display order."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("offset", F.coalesce(F.sum("len").over(w), F.lit(0)).cast("long"))


def genome_axis(contigs: DataFrame, size: int, cut_off: str = "larger", window: tuple[int, int] | None = None, show_small: bool = False) -> Axis:
    """Bins of one size over (chr, ord, len), in display order, within a window of the
    concatenated contigs.

    The first contig in the window is binned from the window's start on, later ones from
    their own. At a contig's end: smaller keeps a shorter last bin, larger adds the rest to
    the bin before, skip drops it, fit_chrom_smaller and fit_chrom_larger change the contig
    to whole bins, cover_multiple lets the last bin run on and starts the next contig after
    it. Contigs shorter than a bin vanish under smaller and larger unless show_small. A
    column actual says which contig a displayed copy shows.
    """
    if cut_off not in CUT_OFF:
        raise ValueError(f"cut_off is none of {CUT_OFF}")
    if "actual" not in contigs.columns:
        contigs = contigs.withColumn("actual", F.col("chr"))
    b = F.lit(size).cast("long")
    whole = {"fit_chrom_smaller": F.expr(f"len div {size} * {size}"), "fit_chrom_larger": F.expr(f"(len + {size - 1}) div {size} * {size}")}
    placed = offsets(contigs.withColumn("len", whole.get(cut_off, F.col("len")))).withColumn("end", F.col("offset") + F.col("len"))
    low = F.lit(max(0, window[0]) if window else 0).cast("long")
    high = F.least(F.lit(max(0, window[1])).cast("long"), F.col("end")) if window else F.col("end")
    origin = F.greatest(low - F.col("offset"), F.lit(0).cast("long"))
    if cut_off == "cover_multiple":
        origin = F.when(F.col("offset") > low, F.pmod(low - F.col("offset"), b)).otherwise(origin)
    rows = placed.withColumn("origin", origin).withColumn("seen", high - F.col("offset") - F.col("origin")).filter("seen > 0")
    rest = F.col("len") - F.col("origin")
    up = lambda x: F.ceil(x / b).cast("long")
    down = lambda x: F.floor(x / b).cast("long")
    held = {"smaller": up(rest), "larger": F.greatest(F.lit(1).cast("long"), down(rest)), "skip": down(rest), "fit_chrom_smaller": down(rest)}.get(cut_off, up(rest))
    rows = rows.withColumn("all", held).withColumn("n", F.least(F.col("all"), up(F.col("seen"))))
    if cut_off in ("smaller", "larger") and not show_small:
        rows = rows.filter((F.col("origin") > 0) | (rest >= b))
    full = F.col("origin") + F.col("n") * b
    ends = {"smaller": F.least(full, F.col("len")), "larger": F.when(F.col("n") == F.col("all"), F.col("len")).otherwise(full)}
    rows = rows.filter("n > 0").withColumn("stop", ends.get(cut_off, full))
    first = F.coalesce(F.sum("n").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return Axis(rows.select("chr", "actual", "ord", b.alias("step"), "origin", "n", first.alias("first"), "stop", "offset"))


def canvas(contigs: DataFrame, size: int = 1, cut_off: str = "larger") -> DataFrame:
    """One row: the length of all contigs on the screen, under a rule that changes them to whole bins or none."""
    whole = {"fit_chrom_smaller": F.expr(f"len div {size} * {size}"), "fit_chrom_larger": F.expr(f"(len + {size - 1}) div {size} * {size}")}
    return contigs.agg(F.coalesce(F.sum(whole.get(cut_off, F.col("len"))), F.lit(0)).alias("canvas"))


def shown_on_both(x: DataFrame, y: DataFrame) -> DataFrame:
    """Contigs of x that y displays too, whatever their copies are called."""
    name = lambda d: d.withColumn("actual", F.col("actual") if "actual" in d.columns else F.col("chr"))
    return name(x).join(name(y).select("actual").distinct(), "actual", "left_semi")


def region_axis(regions: DataFrame) -> DataFrame:
    """Irregular bins (chr, index_pos, index_size), which may overlap, numbered in order."""
    return regions.withColumn("idx", F.row_number().over(Window.orderBy("chr", "index_pos", "index_size")) - 1)


def regions_of(axis: DataFrame) -> DataFrame:
    """Runs of bins on one contig: chr, index_pos, index_size, screen_pos, num_bins."""
    return axis.groupBy("chr", "ord").agg(
        F.min("index_pos").alias("index_pos"),
        (F.max(F.col("index_pos") + F.col("index_size")) - F.min("index_pos")).alias("index_size"),
        F.min("screen_pos").alias("screen_pos"),
        F.count(F.lit(1)).alias("num_bins"),
    )


def ticks(contigs: DataFrame) -> DataFrame:
    """Where contigs start and where their labels go (the middle), on the screen."""
    return offsets(contigs).select("chr", "offset", (F.col("offset") + F.col("len") / 2).alias("label_at"), (F.col("offset") + F.col("len")).alias("end"))


def longest_common_suffix(names: list[str]) -> str:
    """What all names end in; it is left out of labels."""
    if not names:
        return ""
    turned = [n[::-1] for n in names]
    low, high = min(turned), max(turned)
    n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    return low[:n][::-1]
