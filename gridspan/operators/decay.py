"""Distance-dependent decay: what a bin of some distance to the diagonal holds on average."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .combine import group_values
from .count import fold, transposed
from .normalize import trimmed_mean


def bands(grid: DataFrame) -> DataFrame:
    """grid (chr_x, chr_y, x_pos, x_size, y_pos, y_size, ...) with lo and hi: the diagonals
    that the far corners of a bin lie on."""
    a, b = F.col("x_pos") + F.col("x_size") - F.col("y_pos"), F.col("x_pos") - F.col("y_pos") - F.col("y_size")
    return grid.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(F.greatest(a, b), F.col("lo") + 1))


def sampled_bands(grid: DataFrame, contigs: DataFrame, most: int | None) -> DataFrame:
    """The distinct bands of grid and how boxes stand along their diagonals, most of them (None:
    all) at even steps: chr_x, chr_y, lo, hi, mid, height, bottom (where the first box
    stands), step, boxes, room."""
    side = lambda s: contigs.select(F.col("chr").alias(f"chr_{s}"), F.col("len").alias(f"len_{s}"))
    rows = grid.select("chr_x", "chr_y", "lo", "hi").distinct().join(side("x"), "chr_x").join(side("y"), "chr_y")
    rows = rows.withColumn("mid", F.expr("(lo + hi) div 2")).filter("mid between -len_y and len_x")
    rows = rows.withColumns({"bottom": F.abs("mid"), "height": F.greatest(F.lit(1).cast("long"), F.col("hi") - F.col("lo")), "top": F.expr("len_x + len_y - abs(len_x - len_y - mid)")})
    step = F.lit(1).cast("long") if most is None else F.greatest(F.lit(1).cast("long"), F.expr(f"floor((top - height - bottom) / {most})"))
    rows = rows.withColumn("step", step).filter("top > bottom").withColumn("boxes", F.expr("(top - 1 - bottom) div step + 1"))
    return rows.select("chr_x", "chr_y", "lo", "hi", "mid", "height", "bottom", "step", "boxes", (F.col("top") - F.col("bottom")).alias("room"))


def sample_boxes(bands_of: DataFrame) -> DataFrame:
    """The boxes of sampled_bands(): chr_x, chr_y, lo, hi, at, nth, x0, x1, y0, y1 (half open), room, height."""
    rows = bands_of.withColumn("nth", F.explode(F.expr("sequence(0L, boxes - 1)"))).withColumn("at", F.expr("bottom + nth * step"))
    half = lambda e: F.floor(F.expr(e) / 2).cast("long")
    rows = rows.withColumns({"x0": half("at + mid"), "y0": half("at - mid")})
    rows = rows.withColumns({"x1": F.greatest(F.col("x0") + 1, half("at + height + mid")), "y1": F.greatest(F.col("y0") + 1, half("at + height - mid"))})
    return rows.select("chr_x", "chr_y", "lo", "hi", "at", "nth", "x0", "x1", "y0", "y1", "room", "height")


def sample_counts(bands_of: DataFrame, contacts: DataFrame, least: int = 0) -> DataFrame:
    """(chr_x, chr_y, lo, hi, [dataset,] at, n, room, height): for each box of sampled_bands()
    the contacts that it encloses (0: none), of the band's dataset if it names one.

    On rotated coordinates d = x - y and s = x + y, a contact lies in the boxes of a band
    that stand between two values of s, which follow from how far its d is from the
    middle. So contacts that agree in both are summed once, each adds to a range of boxes
    by a turn at either end of it, and a running sum along the diagonal counts all boxes.
    """
    each = ["dataset"] if "dataset" in bands_of.columns else []
    keys = ["chr_x", "chr_y", "lo", "hi", *each]
    turned = contacts.select(*each, "chr_x", "chr_y", *[F.expr(e).alias(n) for n, e in (("d0", "x_s - y_e"), ("d1", "x_e - y_s"), ("ds", "x_s - y_s"), ("ss", "x_s + y_s"), ("de", "x_e - y_e"), ("se", "x_e + y_e"))], "cnt")
    summed = turned.groupBy(*[c for c in turned.columns if c != "cnt"]).agg(F.sum("cnt").alias("cnt"))
    # a box reaches so far from the middle of its band, and one unit counts as enclosed in any
    spans = bands_of.withColumn("reach", F.greatest(F.lit(0).cast("long"), F.col("height") - 2))
    spans = spans.withColumns({"low": F.expr("mid - (reach + 1) div 2"), "high": F.expr("mid + (reach + 1) div 2 + 1"), "pair": F.struct("chr_x", "chr_y", *each)})
    summed = summed.withColumn("of", F.struct("chr_x", "chr_y", *each)).drop("chr_x", "chr_y", *each)
    met = intervals.inside(summed, "of", "d0", "d1", spans, {c: c for c in (*keys, "mid", "reach", "bottom", "step", "boxes")}, chr_col="pair")
    first = F.expr("greatest(0L, cast(ceil((se + abs(de - mid) - reach - bottom) / step) as long))")
    last = F.expr("least(boxes - 1, cast(floor((ss - abs(ds - mid) + 1 - bottom) / step) as long))")
    met = met.withColumns({"first": first, "last": last}).filter("first <= last")
    turns = met.select(*keys, F.inline(F.expr("array(struct(first as nth, cnt as turn), struct(last + 1 as nth, -cnt as turn))")))
    turns = turns.groupBy(*keys, "nth").agg(F.sum("turn").alias("turn"))
    boxes = bands_of.select(*keys, "room", "height", "bottom", "step", F.explode(F.expr("sequence(0L, boxes - 1)")).alias("nth"))
    running = F.sum(F.coalesce("turn", F.lit(0))).over(Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    rows = boxes.join(turns, [*keys, "nth"], "left").withColumn("n", F.greatest(running - least, F.lit(0)).cast("long"))
    return rows.select(*keys, F.expr("bottom + nth * step").alias("at"), "n", "room", "height")


def _trimmed(counted: DataFrame, keys: list[str], least: int, quantile: float) -> DataFrame:
    bands_of = counted.groupBy(*keys).agg(F.collect_list(F.col("n").cast("double")).alias("v"), F.first("room").alias("room"), F.first("height").alias("height"))
    short = F.col("room") < (least - 1) * F.col("height")
    return bands_of.select(*keys, F.when(short, 0.0).otherwise(trimmed_mean(F.col("v"), quantile)).alias("decay"))


def decay(grid: DataFrame, contigs: DataFrame, contacts: DataFrame, least: int = 1, most: int | None = 200, quantile: float = 80.0) -> DataFrame:
    """(chr_x, chr_y, lo, hi, decay) of one dataset: the trimmed mean of the boxes of a band,
    0 where fewer than least boxes fit side by side."""
    counted = sample_counts(sampled_bands(grid, contigs, most), contacts)
    return _trimmed(counted, ["chr_x", "chr_y", "lo", "hi"], least, quantile)


def group_decay(
    grid: DataFrame, contigs: DataFrame, contacts: DataFrame, flipped: DataFrame, group_a: list[str], group_b: list[str], in_group: str = "sum", symmetry: str = "all", minus: int = 0, least: int = 1, most: int | None = 200, quantile: float = 80.0
) -> DataFrame:
    """(chr_x, chr_y, lo, hi, va, vb): the decay of each dataset in both orientations, folded
    like counts, and the datasets of a group combined like counts.

    A band has most boxes, so the lists that the trimmed means sort are bounded unless all boxes are asked for (None).
    """
    keys = ["chr_x", "chr_y", "lo", "hi"]
    names = sorted({*group_a, *group_b})
    bands_of = sampled_bands(grid, contigs, most).withColumn("dataset", F.explode(F.array(*[F.lit(n) for n in names])))
    sides = {"a": contacts} if symmetry == "all" else {"a": contacts, "b": transposed(flipped)}
    found = None
    for side, rows in sides.items():
        part = _trimmed(sample_counts(bands_of, rows, minus), [*keys, "dataset"], least, quantile)
        part = part.select(*keys, "dataset", *[(F.col("decay") if s == side else F.lit(0.0)).alias(s) for s in ("a", "b")])
        found = part if found is None else found.unionByName(part)
    both = found.groupBy(*keys, "dataset").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    value = fold(F.col("a"), F.col("b"), symmetry)
    return group_values(both, value, group_a, group_b, in_group, tuple(keys))


def exported(bands_of: DataFrame, dividend: int) -> DataFrame:
    """(chr_x, chr_y, from_bp, to_bp, a, b): decays (lo, hi, va, vb) per square megabase."""
    width = (F.col("hi") - F.col("lo")) * F.lit(float(dividend))
    per = lambda v: F.try_divide(1e6 * F.col(v), width * width)
    return bands_of.select("chr_x", "chr_y", (F.col("lo") * dividend).alias("from_bp"), (F.col("hi") * dividend).alias("to_bp"), per("va").alias("a"), per("vb").alias("b"))
