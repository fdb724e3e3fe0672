"""Normalisations of a grid of bins (xi, yi, v)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.staging import staged

ROUNDS, TOLERANCE = 200, 1e-5


def slice_coverage(grid: DataFrame, axis: str = "xi") -> DataFrame:
    """(axis, coverage, filled): whole sums and numbers of non-empty bins of each slice."""
    return grid.groupBy(axis).agg(F.sum(F.floor("v").cast("long")).alias("coverage"), F.count_if(F.col("v") > 0).alias("filled"))


def _upper_tail(x: float, n: int, p: float) -> float:
    """P[X >= x] for X of n trials with chance p, by the shorter of both tails in logarithms."""
    from math import exp, lgamma, log, log1p

    x = int(np.ceil(x))
    if x <= 0 or p >= 1:
        return 1.0 if x <= n else 0.0
    if x > n or p <= 0:
        return 0.0
    term = lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p))
    step = p / (1 - p)
    if x > n * p:  # terms fall from x on
        t = total = term(x)
        for k in range(x, n):
            t *= (n - k) / (k + 1) * step
            total += t
            if t < total * 1e-17:
                break
        return min(1.0, total)
    t = total = term(x - 1)
    for k in range(x - 1, 0, -1):
        t *= k / (n - k + 1) / step
        total += t
        if t < total * 1e-17:
            break
    return max(0.0, 1.0 - total)


def binomial_tail(x: str, n: str, p: Column) -> Column:
    """P[X >= x] by row, for n trials with chance p."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([_upper_tail(a, int(b), c) for a, b, c in zip(x, n, p, strict=True)], dtype="float64")

    return tail(x, n, p)


def false_discovery(values: DataFrame, p: str, keys: list[str], order: list[str], tests: Column | None = None) -> DataFrame:
    """values with p_adj: Benjamini-Hochberg within keys. tests is the number of tests if
    values only has those whose p isn't 1; the others change nothing else."""
    w = Window.partitionBy(*keys)
    ranked = values.withColumn("_r", F.row_number().over(w.orderBy(p, *order))).withColumn("_n", F.count(F.lit(1)).over(w) if tests is None else tests)
    least = F.min(F.col(p) * F.col("_n") / F.col("_r")).over(w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_adj", F.least(F.lit(1.0), least)).drop("_r", "_n")


def binomial(grid: DataFrame, axis: str = "xi", accept: float = 0.05, tests: Column | None = None) -> DataFrame:
    """grid with p_val, p_adj and significant (1 or 0): is a bin fuller than chance within
    its slice, whose reads fall evenly on its non-empty bins. tests is the number of bins of
    a slice if grid leaves out empty ones."""
    slices = slice_coverage(grid, axis)
    rows = grid.join(slices, axis).withColumn("p_val", F.when(F.col("filled") == 0, 1.0).otherwise(binomial_tail("v", "coverage", F.try_divide(F.lit(1.0), F.col("filled")))))
    other = "yi" if axis == "xi" else "xi"
    adjusted = false_discovery(rows, "p_val", [axis], [other], tests)
    return adjusted.withColumn("significant", (F.col("p_adj") < accept).cast("int")).drop("coverage", "filled")


def ignore_diagonals(grid: DataFrame, n: int, bin_size: tuple[int, int] | None = None) -> DataFrame:
    """Bins nearer than n bins to the diagonal of a contig set to 0 (chr_x, x_pos, ...). A
    bin's number is its position divided by the window's bin size, as whole numbers; without
    a bin_size the bin's own size is taken. Copies of a contig count as that contig."""
    actual = "actual_x" in grid.columns and "actual_y" in grid.columns
    same = F.col("actual_x") == F.col("actual_y") if actual else F.col("chr_x") == F.col("chr_y")
    width, height = bin_size or ("x_size", "y_size")
    near = same & (F.abs(F.expr(f"x_pos div {width} - y_pos div {height}")) < n)
    return grid.withColumn("v", F.when(near, 0.0).otherwise(F.col("v")))


def margins(grid: DataFrame, axis: str) -> DataFrame:
    return grid.groupBy(axis).agg((2 * F.sum("v")).alias("margin"))


def masked_slices(grid: DataFrame, axis: str, min_nz: int = 10, sparse: float = 10.0, mad_max: float = 5.0, bins: int | None = None) -> DataFrame:
    """(axis, masked): slices with fewer than min_nz non-empty bins, with at most sparse
    percent of them, or whose margin is under exp(median - mad_max * MAD) of the logarithms
    of margins, taken relative to the median of the non-zero ones. bins is the number of bins
    of a slice if grid leaves out empty ones; slices without any row aren't listed."""
    slices = grid.groupBy(axis).agg((2 * F.sum("v")).alias("margin"), F.count_if(F.col("v") > 0).alias("nz"), (F.count(F.lit(1)) if bins is None else F.lit(bins)).alias("bins"))
    middle = slices.agg(F.median(F.when(F.col("margin") > 0, F.col("margin"))).alias("mid"))
    logs = slices.crossJoin(F.broadcast(middle)).withColumn("rel", F.try_divide("margin", "mid")).withColumn("l", F.when(F.col("rel") > 0, F.log("rel")))
    med = logs.agg(F.median("l").alias("med"))
    mad = logs.crossJoin(F.broadcast(med)).agg(F.median(F.abs(F.col("l") - F.col("med"))).alias("mad"), F.first("med").alias("med"))
    cut = logs.crossJoin(F.broadcast(mad))
    masked = (F.col("nz") < min_nz) | (F.col("nz") * 100.0 <= F.col("bins") * sparse)
    if mad_max > 0:
        masked |= F.coalesce(F.col("rel") < F.exp(F.col("med") - mad_max * F.col("mad")), F.lit(True))
    return cut.select(axis, masked.alias("masked"))


def balance_step(grid: DataFrame, bias_x: DataFrame, bias_y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of iterative correction: both biases divided by their slices' margins,
    relative to the mean of the non-zero margins, from one product."""
    product = grid.join(bias_x, "xi").join(bias_y, "yi").withColumn("v", F.col("v") * F.col("bx") * F.col("by"))
    out = []
    for axis, name, bias in (("xi", "bx", bias_x), ("yi", "by", bias_y)):
        m = margins(product, axis)
        mean = m.agg(F.avg(F.when(F.col("margin") != 0, F.col("margin"))).alias("mean"))
        rel = m.crossJoin(F.broadcast(mean)).select(axis, F.when(F.col("margin") == 0, 1.0).otherwise(F.try_divide("margin", "mean")).alias("rel"))
        out.append(bias.join(rel, axis).select(axis, (F.col(name) / F.col("rel")).alias(name)))
    return out[0], out[1]


def balance(grid: DataFrame, bins: tuple[int, int], min_nz: int = 10, sparse: float = 0.0, mad_max: float = 5.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, bool]:
    """Biases (xi, bx) and (yi, by) of a sparse grid (xi, yi, v) of so many bins a side, and
    whether they converged: iterative correction by joins, for matrices of any size.

    Masked slices have the bias 0; slices without a filled bin aren't listed. A round sums
    one product of the grid and both biases over its rows and columns, so only sums by
    slice are shuffled; the new biases are a small table. If all biases come to 0, they
    are 1. Bins that count for nothing (ignored diagonals) must be left out of grid.
    """
    held = staged(grid.filter("v > 0").select("xi", "yi", F.col("v").cast("double").alias("v")), "grid")
    start = []
    for side, (axis, across) in enumerate((("xi", bins[1]), ("yi", bins[0]))):
        masks = masked_slices(held, axis, min_nz, sparse, mad_max, across)
        start.append(masks.select(F.lit(side).alias("side"), F.col(axis).alias("idx"), F.when(F.col("masked"), 0.0).otherwise(1.0).alias("b")))
    bias, done, means = staged(start[0].union(start[1]), "bias"), False, {}
    of = lambda table, side, axis, name: table.filter(F.col("side") == side).select(F.col("idx").alias(axis), F.col("b").alias(name))
    for _ in range(rounds):
        product = held.join(of(bias, 0, "xi", "bx"), "xi").join(of(bias, 1, "yi", "by"), "yi").withColumn("p", F.col("v") * F.col("bx") * F.col("by"))
        ends = F.array(F.struct(F.lit(0).alias("side"), F.col("xi").alias("idx")), F.struct(F.lit(1).alias("side"), F.col("yi").alias("idx")))
        sums = product.select(F.inline(ends), "p").groupBy("side", "idx").agg((2 * F.sum("p")).alias("margin"))
        sums = staged(sums, "margins")
        full = F.when(F.col("margin") != 0, F.col("margin"))
        found = {r["side"]: r for r in sums.groupBy("side").agg(F.avg(full).alias("mean"), F.var_pop(full).alias("var")).collect()}  # two rows
        means = {s: (found[s]["mean"] or 0.0) if s in found else 0.0 for s in (0, 1)}
        spread = [(found[s]["var"] or 0.0) if s in found else 0.0 for s in (0, 1)]
        mean = F.when(F.col("side") == 0, means[0]).otherwise(means[1])
        relative = F.when((F.col("margin") == 0) | (mean == 0), 1.0).otherwise(F.try_divide("margin", mean))
        bias = staged(bias.join(sums, ["side", "idx"], "left").select("side", "idx", (F.col("b") / F.coalesce(relative, F.lit(1.0))).alias("b")), "bias")
        if sum(spread) / 2 < tolerance:
            done = True
            break
    top = {r["side"]: r["b"] for r in bias.groupBy("side").agg(F.max("b").alias("b")).collect()}
    if not top.get(0) or not top.get(1):
        bias, done, means = bias.withColumn("b", F.lit(1.0)), False, {}
    rescale = lambda side: F.col("b") / (means[side] ** 0.5 if means.get(0) and means.get(1) else 1.0)
    scaled = bias.withColumn("b", F.when(F.col("side") == 0, rescale(0)).otherwise(rescale(1)))
    return of(scaled, 0, "xi", "bx"), of(scaled, 1, "yi", "by"), done


def balanced(grid: DataFrame, bias_x: DataFrame, bias_y: DataFrame) -> DataFrame:
    """grid with v times both biases; a slice without a bias has none of its bins filled."""
    rows = grid.join(bias_x, "xi", "left").join(bias_y, "yi", "left")
    return rows.withColumn("v", F.col("v") * F.coalesce("bx", F.lit(0.0)) * F.coalesce("by", F.lit(0.0))).drop("bx", "by")


def balance_matrix(a: np.ndarray, keep_x: np.ndarray, keep_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Biases of a dense window's slices and whether they converged; masked slices have 0.
    If nothing is left, all biases are 1."""
    bx, by, done = keep_x.astype(float), keep_y.astype(float), False
    means = [0.0, 0.0]
    for _ in range(ROUNDS):
        p, spread = a * bx[:, None] * by[None, :], []
        moved = []
        for n, (m, b) in enumerate(((2 * p.sum(1), bx), (2 * p.sum(0), by))):
            full = m[m != 0]
            means[n] = full.mean() if len(full) else 0.0
            spread.append(((full - means[n]) ** 2).mean() if len(full) else 0.0)
            rel = m / means[n] if means[n] else np.zeros_like(m)
            rel[rel == 0] = 1
            moved.append(b / rel)
        bx, by = moved
        if (spread[0] + spread[1]) / 2 < TOLERANCE:
            done = True
            break
    if means[0] and means[1]:
        bx, by = bx / np.sqrt(means[0]), by / np.sqrt(means[1])
    if not bx.max(initial=0) or not by.max(initial=0):
        return np.ones_like(bx), np.ones_like(by), False
    return bx, by, done


def trimmed_mean(values: Column, quantile: float) -> Column:
    """The mean of the central quantile percent of an array; its upper median if that is
    none. Where the nominal number of values is 0, the values summed are counted."""
    q = (1 - quantile / 100) / 2
    ordered, n = F.array_sort(values), F.size(values)
    if q >= 0.5:
        return F.get(ordered, F.floor(n / 2).cast("int"))
    low = F.floor(n * q).cast("int")
    high = F.ceil(n * (1 - q)).cast("int")
    kept = F.slice(ordered, low + 1, F.greatest(F.lit(0), high - low))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    nominal = F.floor(n * (1 - 2 * q) + 1e-9)
    return F.try_divide(total, F.when(nominal > 0, nominal).otherwise(F.size(kept)))


def per_decay(grid: DataFrame, decay: DataFrame, keys: list[str]) -> DataFrame:
    """grid with v over the decay of its band; 0 where that isn't positive."""
    return grid.join(decay, keys, "left").withColumn("v", F.when(F.col("decay") > 0, F.try_divide("v", "decay")).otherwise(0.0))
