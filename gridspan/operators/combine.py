"""Values of bins from counts of datasets: groups, ploidy, scaling, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The smallest positive normal double; a maximum never falls below it.
TINY = 2.2250738585072014e-308
IN_GROUP = ("sum", "min", "max", "dif", "mean")
BETWEEN = ("1st", "2nd", "sub", "min", "max", "dif", "sum", "div", "div+")


def in_group(values: list[Column], how: str) -> Column:
    """One value of a group's datasets; mean is the upper median, dif sums |a - b| over
    all ordered pairs, and an empty group is 0."""
    if not values:
        return F.lit(0.0)
    values = [v.cast("double") for v in values]
    if how == "sum":
        return sum(values[1:], values[0])
    if how in ("min", "max"):
        return values[0] if len(values) == 1 else (F.least if how == "min" else F.greatest)(*values)
    if how == "mean":
        return F.get(F.array_sort(F.array(*values)), F.lit(len(values) // 2))
    pairs = [F.abs(a - b) for n, a in enumerate(values) for b in values[n + 1 :]]
    return 2 * sum(pairs[1:], pairs[0]) if pairs else F.lit(0.0)


def group_values(counts: DataFrame, value: Column, group_a: list[str], group_b: list[str], how: str, keys: tuple[str, ...] = ("xi", "yi")) -> DataFrame:
    """keys, va, vb: the datasets of a bin side by side (absent: 0), combined by group."""
    names = sorted({*group_a, *group_b})
    wide = counts.filter(F.col("dataset").isin(names)).withColumn("_v", value).groupBy(*keys).agg(*[F.sum(F.when(F.col("dataset") == d, F.col("_v")).otherwise(0)).alias(f"_d{n}") for n, d in enumerate(names)])
    of = lambda group: [F.col(f"_d{names.index(d)}") for d in group]
    return wide.select(*keys, in_group(of(group_a), how).alias("va"), in_group(of(group_b), how).alias("vb"))


def between(a: Column, b: Column, how: str) -> Column:
    return {
        "1st": a, "2nd": b, "sub": a - b, "min": F.least(a, b), "max": F.greatest(a, b), "dif": F.abs(a - b), "sum": a + b,
        "div": F.when(b > 0, F.try_divide(a, b)).otherwise(0.0), "div+": F.try_divide(a + 1e-6, b + 1e-6),
    }[how]


def per(value: Column, total: Column, unit: float) -> Column:
    """value per unit (1e6 or 1e3) of the total; 0 of nothing."""
    return F.when(total > 0, F.try_divide(F.lit(unit) * value, total)).otherwise(0.0)


def ploidy_pairs(contigs_x: DataFrame, contigs_y: DataFrame, keep_distinct_group: bool = True, keep_inter_group: bool = True, remove_others: bool = True, remove_intra: bool = True) -> DataFrame:
    """(chr_x, chr_y, actual_x, actual_y, valid) of all pairs of displayed copies. Contigs:
    chr, actual, ploidy_group.

    Two copies of one contig aren't a pair if remove_intra; copies in one group are, if
    keep_inter_group; contigs of which no two copies share a group are, if
    keep_distinct_group; all others are unless remove_others.
    """
    side = lambda d, s: d.select(F.col("chr").alias(f"chr_{s}"), F.col("actual").alias(f"actual_{s}"), F.col("ploidy_group").alias(f"g{s}"))
    pairs = side(contigs_x, "x").crossJoin(side(contigs_y, "y"))  # of contigs, not of data
    same = F.col("gx") == F.col("gy")
    shared = F.max(same.cast("int")).over(Window.partitionBy("actual_x", "actual_y")) == 1
    intra = (F.col("actual_x") == F.col("actual_y")) & (F.col("chr_x") != F.col("chr_y"))
    valid = F.when(intra & F.lit(remove_intra), False).when(same & F.lit(keep_inter_group), True).when(~shared & F.lit(keep_distinct_group), True).otherwise(not remove_others)
    return pairs.select("chr_x", "chr_y", "actual_x", "actual_y", valid.alias("valid"))


def ploidy_spots(contigs_x: DataFrame, contigs_y: DataFrame, keep_distinct_group: bool = True, keep_inter_group: bool = True, remove_others: bool = True, remove_intra: bool = True) -> DataFrame:
    """(actual_x, actual_y, spots): how many pairs of displayed copies of two contigs are
    taken to be real."""
    pairs = ploidy_pairs(contigs_x, contigs_y, keep_distinct_group, keep_inter_group, remove_others, remove_intra)
    return pairs.groupBy("actual_x", "actual_y").agg(F.sum(F.col("valid").cast("int")).alias("spots"))


def ploidy_divisors(contigs: DataFrame, correct: bool = True, **rules: bool) -> DataFrame:
    """(chr_x, chr_y, spots) of displayed copies: what a bin's value is divided by; 0 for
    pairs that aren't real. Without correct every pair counts as it is."""
    pairs = ploidy_pairs(contigs, contigs, **rules)
    if not correct:
        return pairs.select("chr_x", "chr_y", F.lit(1).cast("long").alias("spots"))
    spots = F.sum(F.col("valid").cast("int")).over(Window.partitionBy("actual_x", "actual_y"))
    return pairs.select("chr_x", "chr_y", F.when(F.col("valid"), spots).otherwise(0).alias("spots"))


def value_range(values: DataFrame, column: str = "v", bins: DataFrame | None = None, empty: float = 0.0) -> DataFrame:
    """One row (low, high) of what isn't NaN; high is at least TINY. bins is one row with the
    number of bins of the window: if values has fewer rows, the others hold empty."""
    seen = F.when(~F.isnan(column), F.col(column))
    found = values.agg(F.min(seen).alias("low"), F.greatest(F.lit(TINY), F.max(seen)).alias("high"), F.count(F.lit(1)).alias("_n"))
    if bins is None:
        return found.drop("_n")
    absent = F.col("_n") < F.col("bins")
    other = lambda f, c: F.when(absent, f(F.col(c), F.lit(empty))).otherwise(F.col(c)).alias(c)
    return found.crossJoin(F.broadcast(bins)).select(other(F.least, "low"), other(F.greatest, "high"))  # single rows


def scaled(values: DataFrame, how: str, column: str = "v", bins: DataFrame | None = None, empty: float = 0.0) -> DataFrame:
    """values with scaled: max divides by the greatest, abs by the greatest magnitude, and
    minmax is (v + least) / (greatest - least), as documented numbers depend on that sign.
    bins and empty account for bins that values has no row of."""
    v = F.col(column)
    if how == "dont":
        return values.withColumn("scaled", v)
    joined = values.crossJoin(F.broadcast(value_range(values, column, bins, empty)))  # a single row
    by = {"max": F.try_divide(v, F.col("high")), "abs": F.try_divide(v, F.greatest(F.abs("high"), F.abs("low"))), "minmax": F.try_divide(v + F.col("low"), F.col("high") - F.col("low"))}[how]
    return joined.withColumn("scaled", by).drop("low", "high")


def log_scale(x: Column, base: float, around_middle: bool = False) -> Column:
    """0..1 to 0..1 on a logarithmic scale of this base's strength; linear for 0. Around the
    middle, distances from 0.5 are scaled, for values with a sign."""
    part = F.abs(x - 0.5) if around_middle else x
    if base:
        least = 1 / 2**base
        part = F.log(2**base * (F.least(F.lit(1.0), part) * (1 - least) + least)) / F.log(F.lit(2.0**base))
    return part * F.when(x > 0.5, 0.5).otherwise(-0.5) + 0.5 if around_middle else part


def color_index(x: Column, low: float, high: float, base: float, colors: int = 256, around_middle: bool = False) -> Column:
    """The palette's entry for a scaled value, within the colour range low..high; NaN takes
    the background's, which is the first or, around the middle, that of 0.5."""
    within = (x - low) / (high - low) if high != low else F.lit(0.0)
    shade = F.when(F.isnan(x), log_scale(F.lit(0.5), base, True) if around_middle else F.lit(0.0)).otherwise(log_scale(within, base, around_middle))
    return F.least(F.lit(colors - 1), F.floor(F.greatest(F.lit(0.0), F.round(F.coalesce(F.nanvl(shade, F.lit(0.0)), F.lit(0.0)) * (colors - 1), 9)))).cast("int")


def palette(colors: int, low: float, high: float, base: float, around_middle: bool, spark: SparkSession) -> DataFrame:
    """(place, color): the legend's entries, from low to high in 255 steps (of 1 at most)."""
    step = max(1.0, high - low) / 255
    at = F.lit(low) + F.col("id") * step
    entries = spark.range(int((high - low) / step + 1e-9) + 1)
    return entries.select(F.col("id").alias("place"), color_index(at, low, high, base, colors, around_middle).alias("color"))


def palette_ticks(scaled_values: DataFrame, low: float, high: float, column: str = "scaled") -> DataFrame:
    """One row (data_low, data_high, range_low, range_high): where the data and the colour
    range begin and end on a legend that holds both, from 0 to 1."""
    r = value_range(scaled_values, column)
    left, right = F.least("low", F.lit(low)), F.greatest("high", F.lit(high))
    at = lambda c, name: F.try_divide(c - left, right - left).alias(name)
    return r.select(at(F.col("low"), "data_low"), at(F.col("high"), "data_high"), at(F.lit(low), "range_low"), at(F.lit(high), "range_high"))


def mixed_color(x: Column, low: str, high: str) -> Column:
    """#rrggbb between two colours, x from 0 to 1."""
    part = lambda c, k: int(c[1 + 2 * k : 3 + 2 * k], 16)
    channel = lambda k: F.lpad(F.lower(F.hex(F.floor(F.lit(part(low, k)) * (1 - x) + F.lit(part(high, k)) * x).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), channel(0), channel(1), channel(2))
