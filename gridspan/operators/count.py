"""Counting contacts in bins: filters, box tests, and both orientations in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.operators import intervals
from gridspan.plans.axis import Axis

#: How a box of several loci has to lie to a bin.
MODES = ("enclosed", "enclosed_only", "encloses", "overlaps", "overlaps_only", "first", "last", "points_only")
DIRECTIONS = ("all", "same", "oppo", "forw", "rev")


def map_quality(low: int = 0, high: int = 254, incomplete: bool = True) -> Column:
    """Buckets above low up to high; bucket 0 too if low is 0 and incomplete alignments count."""
    return F.col("bucket").between(low if low == 0 and incomplete else low + 1, high)


def directionality(which: str = "all") -> Column:
    """Strand codes that a direction lets through, for contacts."""
    same, y = F.col("same_strand"), F.col("y_strand")
    return {"all": F.lit(True), "same": same == 0, "oppo": same == 1, "forw": (same == 0) & (y == 0), "rev": (same == 0) & (y == 1)}[which]


def track_directionality(which: str = "all") -> Column:
    return {"forw": F.col("strand") == 0, "rev": F.col("strand") == 1}.get(which, F.lit(True))


def categories(kinds: tuple[str, ...], present: tuple = ((), ()), absent: tuple = ((), ())) -> Column:
    """Annotation filters of the x and the y mate. A kind under present keeps reads outside
    of it, one under absent reads inside of it; one under both keeps none."""
    out = F.lit(True)
    for side, column in enumerate(("cat_x", "cat_y")):
        for n, kind in enumerate(kinds):
            if kind in present[side]:
                out &= F.get(F.col(column), F.lit(n)) == 1
            if kind in absent[side]:
                out &= F.get(F.col(column), F.lit(n)) == 0
    return out


def transposed(contacts: DataFrame) -> DataFrame:
    """Mates in exchanged roles. Strand codes stay with the read."""
    names = {"chr_x": "chr_y", "x_s": "y_s", "x_e": "y_e", "cat_x": "cat_y"}
    names |= {b: a for a, b in names.items()}
    return contacts.select(*[F.col(names.get(c, c)).alias(c) for c in contacts.columns])


def _bin(position: Column, side: str) -> Column:
    """The number of the bin of a contig that holds a position; the last bin takes what is left."""
    g = lambda name: F.col(f"{side}_{name}")
    return F.least(F.floor((position - g("origin")) / g("step")).cast("long"), g("n") - 1)


def _ranges(side: str, start: str, end: str, mode: str) -> tuple[Column, Column]:
    """First and last bin of one side that a box counts for; first > last: none."""
    s, e = F.col(start), F.col(end)
    origin, stop, first = F.col(f"{side}_origin"), F.col(f"{side}_stop"), F.col(f"{side}_first")
    inside = lambda p: (p >= origin) & (p < stop)
    if mode in ("first", "last", "points_only"):
        at = e if mode == "last" else s
        low = high = _bin(at, side)
        fits = inside(at)
    elif mode in ("enclosed", "enclosed_only"):
        low, high = _bin(s, side), _bin(e, side)
        fits = inside(s) & inside(e) & (low == high)
    else:
        low, high = _bin(F.greatest(s, origin), side), _bin(F.least(e, stop - 1), side)
        fits = (e >= origin) & (s < stop)
        if mode == "encloses":  # bins whose first and last unit the box holds
            step, n = F.col(f"{side}_step"), F.col(f"{side}_n")
            ends = F.when(high == n - 1, stop).otherwise(origin + (high + 1) * step)
            high = F.when(e < ends - 1, high - 1).otherwise(high)
            low = F.when(s > origin + low * step, low + 1).otherwise(low)
    return F.when(fits, first + low).otherwise(F.lit(1)).cast("long"), F.when(fits, first + high).otherwise(F.lit(0)).cast("long")


def _in_spans(rows: DataFrame, side: str, spans: DataFrame, mode: str) -> DataFrame:
    """rows with the number of a bin of one side (xi or yi), once for every irregular bin
    (idx, chr, low, high) that they count for."""
    chrom, start, end, idx = f"chr_{side}", f"{side}_s", f"{side}_e", f"{side}i"
    if mode in ("overlaps", "overlaps_only", "encloses"):
        boxes = rows.withColumns({"chr": F.col(chrom), "low": F.col(start), "high": F.col(end) + 1})
        met = intervals.overlaps(boxes, spans.withColumns({idx: F.col("idx"), "_from": F.col("low"), "_to": F.col("high")}), [idx, "_from", "_to"])
        if mode == "encloses":
            met = met.filter((F.col(start) <= F.col("_from")) & (F.col(end) >= F.col("_to") - 1))
        return met.drop("chr", "low", "high", "_from", "_to")
    at = {"last": (end, end), "enclosed": (start, end), "enclosed_only": (start, end)}.get(mode, (start, start))
    return intervals.inside(rows, chrom, *at, spans, {"idx": idx})


def in_bins(contacts: DataFrame, x: Axis, y: Axis, mode: str = "enclosed") -> DataFrame:
    """contacts with xi and yi, once for every bin they count for.

    Bins of an Axis are found by division within a contig's grid, so the join is an equi-join
    with a broadcast row per contig; those of an annotation axis by interval joins.
    """
    if mode not in MODES:
        raise ValueError(f"mode is none of {MODES}")
    rows = contacts
    if mode in ("enclosed_only", "overlaps_only"):
        rows = rows.filter("x_s < x_e or y_s < y_e")
    elif mode == "points_only":
        rows = rows.filter("x_s = x_e and y_s = y_e")
    sides = {"x": x, "y": y}
    planned = [s for s, axis in sides.items() if isinstance(axis, Axis)]
    keep = rows.columns
    for s in planned:
        rows = rows.join(F.broadcast(sides[s].place(f"g{s}")), F.col(f"chr_{s}") == F.col(f"g{s}_chr"))
    ranges = {s: _ranges(f"g{s}", f"{s}_s", f"{s}_e", mode) for s in planned}
    rows = rows.select(*keep, *[c.alias(f"{s}{n}") for s, r in ranges.items() for c, n in zip(r, "ih", strict=True)])
    for s in planned:
        rows = rows.filter(F.col(f"{s}i") <= F.col(f"{s}h"))
        if mode in ("overlaps", "overlaps_only", "encloses"):
            rows = rows.withColumn(f"{s}i", F.explode(F.sequence(f"{s}i", f"{s}h")))
    for s, axis in sides.items():
        if s not in planned:
            rows = _in_spans(rows, s, F.broadcast(axis.spans()), mode)  # the interface bounds the number of bins
    return rows.drop("xh", "yh")


def bin_counts(contacts: DataFrame, x: Axis, y: Axis, mode: str = "enclosed") -> DataFrame:
    """(dataset, xi, yi, n): summed counts of the non-empty bins."""
    return in_bins(contacts, x, y, mode).groupBy("dataset", "xi", "yi").agg(F.sum("cnt").alias("n"))


def both_orientations(contacts: DataFrame, x: Axis, y: Axis, mode: str = "enclosed", flipped: DataFrame | None = None) -> DataFrame:
    """(dataset, xi, yi, a, b): counts of a bin and of the bin mirrored at the diagonal, from
    one shuffle. flipped replaces the contacts that the mirrored bin counts (its annotation
    filters are exchanged)."""
    zero = F.lit(0).cast("long")
    straight = in_bins(contacts, x, y, mode).select("dataset", "xi", "yi", F.col("cnt").alias("a"), zero.alias("b"))
    mirrored = in_bins(transposed(contacts if flipped is None else flipped), x, y, mode).select("dataset", "xi", "yi", zero.alias("a"), F.col("cnt").alias("b"))
    return straight.union(mirrored).groupBy("dataset", "xi", "yi").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def in_systems(contacts: DataFrame, systems: dict[str, tuple[Axis, Axis]], mode: str = "enclosed") -> DataFrame:
    """contacts with system, xi and yi, once for every bin of each of several pairs of planned
    axes that they count for. All pairs are met in one pass over the contacts: an axis is a
    row for each contig, and those of all systems are one table for each side."""
    rows = contacts.withColumn("system", F.explode(F.array(*[F.lit(s) for s in systems])))
    if mode in ("enclosed_only", "overlaps_only"):
        rows = rows.filter("x_s < x_e or y_s < y_e")
    elif mode == "points_only":
        rows = rows.filter("x_s = x_e and y_s = y_e")
    keep, ranges = rows.columns, []
    for n, s in enumerate("xy"):
        place = None
        for name, axes in systems.items():
            part = axes[n].place(f"g{s}").withColumn(f"g{s}_of", F.lit(name))
            place = part if place is None else place.unionByName(part)
        rows = rows.join(F.broadcast(place), (F.col(f"chr_{s}") == F.col(f"g{s}_chr")) & (F.col("system") == F.col(f"g{s}_of")))  # a row for each contig and system
        ranges += [c.alias(f"{s}{end}") for c, end in zip(_ranges(f"g{s}", f"{s}_s", f"{s}_e", mode), "ih", strict=True)]
    rows = rows.select(*keep, *ranges).filter("xi <= xh and yi <= yh")
    if mode in ("overlaps", "overlaps_only", "encloses"):
        rows = rows.withColumn("xi", F.explode(F.sequence("xi", "xh"))).withColumn("yi", F.explode(F.sequence("yi", "yh")))
    return rows.drop("xh", "yh")


def fold(a: Column, b: Column, symmetry: str, least: int = 0) -> Column:
    """A bin and its mirror image as one value, after least interactions are taken off each."""
    a, b = (F.greatest(v - least, F.lit(0)) for v in (a, b))
    return {"all": a, "sym": F.least(a, b), "asym": F.greatest(a - b, F.lit(0)), "mirror": a + b}[symmetry]


def near_diagonal(distance: int) -> Column:
    """Bins on one contig whose starts are closer than distance; columns chr_x, x_pos, chr_y, y_pos."""
    return (F.col("chr_x") == F.col("chr_y")) & (F.abs(F.col("x_pos") - F.col("y_pos")) < distance)


def dense_grid(x: DataFrame, y: DataFrame) -> DataFrame:
    """Every bin of a window, empty ones too: axes are bounded by the interface's number of bins."""
    side = lambda d, s: d.select(F.col("idx").alias(f"{s}i"), F.col("chr").alias(f"chr_{s}"), F.col("index_pos").alias(f"{s}_pos"), F.col("index_size").alias(f"{s}_size"))
    return side(x, "x").crossJoin(side(y, "y"))


def region_counts(contacts: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """(dataset, xi, yi, n) for irregular bins that may overlap (idx, chr, index_pos,
    index_size): contacts enclosed by both."""
    rows = contacts
    for s, bins in (("x", x), ("y", y)):
        spans = bins.withColumn("_end", F.col("index_pos") + F.col("index_size"))
        rows = intervals.inside(rows, f"chr_{s}", f"{s}_s", f"{s}_e", spans, {"idx": f"{s}i"}, low="index_pos", high="_end")
    return rows.groupBy("dataset", "xi", "yi").agg(F.sum("cnt").alias("n"))


def track_counts(reads: DataFrame, axis: Axis) -> DataFrame:
    """(dataset, idx, n): reads of 1-D datasets in bins that hold all of them."""
    low, high = _ranges("g", "x_s", "x_e", "enclosed")
    rows = reads.join(F.broadcast(axis.place("g")), F.col("chr") == F.col("g_chr")).select("dataset", "cnt", low.alias("idx"), high.alias("h")).filter("idx <= h")
    return rows.groupBy("dataset", "idx").agg(F.sum("cnt").alias("n"))
