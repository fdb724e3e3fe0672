"""One-dimensional results: tracks, viewpoints, slices, annotations on an axis, comparisons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .combine import TINY
from .count import fold, transposed


def value_range(counts: DataFrame) -> DataFrame:
    """(dataset, low, high, low_nz) of a track's bins."""
    return counts.groupBy("dataset").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min(F.when(F.col("n") != 0, F.col("n"))).alias("low_nz"))


def display_range(counts: DataFrame, column: str = "n") -> DataFrame:
    """One row (low, high, low_nz, high_nz): the range of all tracks, and that of what isn't 0.
    A range without extent ends one higher; without any value it is 0 to 1, and 1 to 1."""
    v = F.col(column).cast("double")
    some = F.when(v != 0, v)
    rows = counts.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.min(some).alias("low_nz"), F.max(some).alias("high_nz"))

    def ends(low: str, high: str, least: float) -> list[Column]:
        top = F.greatest(F.lit(TINY), F.coalesce(high, F.lit(TINY)))
        top = F.when(F.col(low).isNull() | (F.col(low) >= top), top + 1).otherwise(top)
        return [F.coalesce(low, F.lit(least)).alias(low), F.when(top == TINY, 1.0).otherwise(top).alias(high)]

    return rows.select(*ends("low", "high", 0.0), *ends("low_nz", "high_nz", 1.0))


def wide(counts: DataFrame, bins: DataFrame, datasets: list[str], dividend: int) -> DataFrame:
    """chr, start, end (base pairs) and a column v1, v2, ... per dataset, for every bin."""
    values = counts.groupBy("idx").agg(*[F.sum(F.when(F.col("dataset") == d, F.col("n"))).alias(f"v{k}") for k, d in enumerate(datasets, 1)])
    rows = bins.join(values, "idx", "left")
    return rows.select("idx", "chr", (F.col("index_pos") * dividend).alias("start"), ((F.col("index_pos") + F.col("index_size")) * dividend).alias("end"), *[F.coalesce(f"v{k}", F.lit(0)).cast("long").alias(f"v{k}") for k in range(1, len(datasets) + 1)])


def viewpoint(grid: DataFrame, view: DataFrame, by_size: bool = True) -> DataFrame:
    """(idx, v): values of the other axis over the bins of a viewpoint (xi, size), per unit
    of its extent if by_size."""
    extent = view.agg(F.sum("size").alias("extent"))
    sums = grid.join(view, "xi").groupBy(F.col("yi").alias("idx")).agg(F.sum("v").alias("v"))
    return sums.crossJoin(F.broadcast(extent)).select("idx", (F.try_divide("v", "extent") if by_size else F.col("v")).alias("v"))  # a single row


def annotation_hits(spans: DataFrame, bins: DataFrame) -> DataFrame:
    """(type, idx, hits): line-sweep rows that touch a bin."""
    rows = spans.select("type", "chr", F.col("i_s").alias("low"), F.col("i_e").alias("high"))
    places = bins.select("idx", "chr", F.col("index_pos").alias("low"), (F.col("index_pos") + F.col("index_size")).alias("high"))
    return intervals.overlaps(rows, places, ["idx"]).groupBy("type", "idx").agg(F.count(F.lit(1)).alias("hits"))


def overlapping(annotations: DataFrame, regions: DataFrame) -> DataFrame:
    """Annotations that touch a region (chr, low, high in base pairs), each once."""
    spans = annotations.withColumns({"low": F.col("start_bp"), "high": F.col("end_bp")})
    return intervals.overlaps(spans, regions, []).dropDuplicates(["type", "desc_id"]).select(annotations.columns)


def in_order(annotations: DataFrame) -> DataFrame:
    """Annotations by contig, start, end and number, as their list shows them."""
    return annotations.orderBy("chr", "start_bp", "end_bp", "desc_id")


def packed_rows(annotations: DataFrame, gap: int) -> DataFrame:
    """(type, chr, desc_id, row): the first display row whose last annotation ends gap before.

    Where an annotation begins gap after all before it have ended, every row is free and
    packing starts anew, so contigs are cut there and the stretches are packed one by one.
    """
    w = Window.partitionBy("type", "chr").orderBy("start_bp", "end_bp", "desc_id")
    reach = F.max("end_bp").over(w.rowsBetween(Window.unboundedPreceding, -1))
    free = F.coalesce((reach + gap <= F.col("start_bp")).cast("int"), F.lit(1))
    cut = annotations.select("type", "chr", "desc_id", "start_bp", "end_bp").withColumn("_free", free)
    cut = cut.withColumn("stretch", F.sum("_free").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_free")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part, ends, rows = part.sort_values(["start_bp", "end_bp", "desc_id"]), [], []
        for start, end in zip(part["start_bp"], part["end_bp"], strict=True):
            row = next((n for n, e in enumerate(ends) if e + gap <= start), len(ends))
            ends[row : row + 1] = [end]
            rows.append(row)
        return part[["type", "chr", "desc_id"]].assign(row=rows)

    return cut.groupBy("type", "chr", "stretch").applyInPandas(pack, "type string, chr string, desc_id long, row int")


def axis_coverage(counts: DataFrame, axis: str) -> DataFrame:
    """(idx, coverage) summed over the other axis and all datasets."""
    return counts.groupBy(F.col(axis).alias("idx")).agg(F.sum("n").alias("coverage"))


def full_slices(counts: DataFrame, least_x: int, least_y: int) -> DataFrame:
    """(idx, c0, c1): slices whose coverages as columns and as rows both reach their thresholds."""
    one = lambda axis, name, least: axis_coverage(counts, axis).filter(F.col("coverage") >= least).withColumnRenamed("coverage", name)
    return one("xi", "c0", least_x).join(one("yi", "c1", least_y), "idx")


def ranked(coverage: DataFrame) -> DataFrame:
    """Non-empty slices with their place, the emptiest first. Slices are those of an axis, whose number is bounded."""
    return coverage.filter("coverage > 0").withColumn("place", (F.row_number().over(Window.orderBy("coverage", "idx")) - 1).cast("long"))


def over_datasets(counts: DataFrame, axis: str, datasets: list[str] | None = None) -> DataFrame:
    """(idx, lowest, highest) coverage of a slice among these datasets; one with nothing in a
    slice, or without any read at all, has 0 there. None: those that counts has rows of."""
    rows = counts if datasets is None else counts.filter(F.col("dataset").isin(*datasets))
    slices = rows.groupBy("dataset", F.col(axis).alias("idx")).agg(F.sum("n").alias("s"))
    number = slices.select("dataset").distinct().agg(F.count(F.lit(1)).alias("datasets")) if datasets is None else counts.sparkSession.createDataFrame([(len(set(datasets)),)], "datasets long")
    return lowest_highest(slices, number, "idx", "s")


def lowest_highest(values: DataFrame, datasets: DataFrame, key: str, value: str) -> DataFrame:
    """(key, lowest, highest) over one row per key and dataset at most; datasets is one row
    with their number, and where one is absent the lowest value is 0."""
    found = values.groupBy(key).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count(F.lit(1)).alias("_n"))
    some = F.col("_n") < F.col("datasets")
    return found.crossJoin(F.broadcast(datasets)).select(key, F.when(some, F.least("lowest", F.lit(0))).otherwise(F.col("lowest")).alias("lowest"), "highest")  # a single row


def leaf_tiles(low: int, high: int, most: int) -> list[tuple[int, int]]:
    """Halves of halves of an interval until none is longer than most."""
    if high - low <= max(1, most):
        return [(low, high)]
    middle = (low + high) // 2
    return leaf_tiles(low, middle, most) + leaf_tiles(middle, high, most)


def max_tile_coverage(contacts: DataFrame, contigs: DataFrame, sample: int, most: int) -> DataFrame:
    """(chr_x, sample, coverage): of samples of one size along x, the fullest tile of y.

    Splitting on can only lower a tile's count, so the leaves hold the answer of a search
    that bisects the fullest tile first.
    """
    spark = contacts.sparkSession
    tiles = [(r["chr"], a, b) for r in contigs.collect() for a, b in leaf_tiles(0, r["len"], most)]  # contigs are few
    leaves = spark.createDataFrame(tiles, "chr string, low long, high long")
    rows = contacts.filter(F.expr(f"x_s div {sample} = x_e div {sample}"))
    met = intervals.inside(rows, "chr_y", "y_s", "y_e", leaves, {"low": "tile"})
    per_tile = met.groupBy("chr_x", "chr_y", F.expr(f"x_s div {sample}").alias("sample"), "tile").agg(F.sum("cnt").alias("n"))
    return per_tile.groupBy("chr_x", "sample").agg(F.max("n").alias("coverage"))


def background(counts: DataFrame, bins: DataFrame, least: int, datasets: list[str], ignore_cis: bool = True, intersection: bool = True) -> DataFrame:
    """(idx, background): what the slices of x that are full enough in every dataset (or, if
    not intersection, in one) have in a bin of y, other contigs only if ignore_cis."""
    full = over_datasets(counts, "xi", datasets).filter((F.col("lowest") if intersection else F.col("highest")) >= least).select(F.col("idx").alias("xi"))
    side = lambda s: bins.select(F.col("idx").alias(f"{s}i"), F.col("chr").alias(f"chr_{s}"))
    rows = counts.join(full, "xi").join(side("x"), "xi").join(side("y"), "yi")
    if ignore_cis:
        rows = rows.filter("chr_x <> chr_y")
    return rows.groupBy(F.col("yi").alias("idx")).agg(F.sum("n").alias("background"))


def in_samples(contacts: DataFrame, samples: DataFrame, side: str) -> DataFrame:
    """contacts with sample, once for each sample (sample, chr, low, high) that holds the
    mate on this side."""
    return intervals.inside(contacts, f"chr_{side}", f"{side}_s", f"{side}_e", samples, {"sample": "sample"})


def sample_coverage(contacts: DataFrame, samples: DataFrame, contigs: DataFrame, side: str, most: int | None = None) -> DataFrame:
    """(dataset, sample, n): reads with one mate in a sample and the other anywhere on contigs
    or, with most, in the fullest of the tiles that the contigs are halved to."""
    other = "y" if side == "x" else "x"
    spark = contacts.sparkSession
    lengths = [(r["chr"], r["len"]) for r in contigs.collect()]  # contigs are few
    tiles = [(f"{c}:{a}", c, a, b) for c, n in lengths for a, b in (leaf_tiles(0, n, most) if most else [(0, n)])]
    regions = spark.createDataFrame(tiles, "sample string, chr string, low long, high long")
    met = in_samples(contacts, samples, side).withColumnRenamed("sample", "_sample")
    rows = in_samples(met, regions, other).groupBy("dataset", F.col("_sample").alias("sample"), F.col("sample").alias("tile")).agg(F.sum("cnt").alias("n"))
    return rows.groupBy("dataset", "sample").agg((F.max("n") if most else F.sum("n")).alias("n"))


def folded_coverage(contacts: DataFrame, flipped: DataFrame, samples: DataFrame, contigs: tuple[DataFrame, DataFrame], side: str, symmetry: str, least: int, most: int | None = None) -> DataFrame:
    """(dataset, sample, v): coverages of samples on one side and, with mates in exchanged
    roles, of the flipped reads, folded. contigs are those of the other side and of its own."""
    straight = sample_coverage(contacts, samples, contigs[0], side, most).withColumns({"a": F.col("n"), "b": F.lit(0).cast("long")})
    if symmetry == "all":
        both = straight
    else:
        turned = sample_coverage(transposed(flipped), samples, contigs[0], side, most).withColumns({"a": F.lit(0).cast("long"), "b": F.col("n")})
        both = straight.unionByName(turned).groupBy("dataset", "sample").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.select("dataset", "sample", fold(F.col("a"), F.col("b"), symmetry, least).alias("v"))


def associated_background(contacts: DataFrame, flipped: DataFrame, samples: DataFrame, bins: DataFrame, contigs: tuple[DataFrame, DataFrame], datasets: list[str], symmetry: str = "all", least: int = 0, thresholds: tuple[int, int] = (1, 1), most: int = 10, intersection: bool = True, ignore_cis: bool = True) -> DataFrame:
    """(idx, background) of bins of x (idx, chr, actual, index_pos, index_size): the reads
    between a bin and all samples (sample, chr, low, high) on y that are associated, which
    are those full enough both over the whole of y on x and in the fullest tile of x on y.

    contigs are those of x and of y (chr, len). Coverages combine datasets by the least
    (intersection) or the greatest; the background sums them, in straight orientation.
    Samples of one interval have the same reads: each interval is looked at once, and counts
    as often in the background, so that reads aren't met by every sample that holds them.
    """
    samples = samples.groupBy("chr", "low", "high").agg(F.min("sample").alias("sample"), F.count(F.lit(1)).alias("_times"))
    times, samples = samples.select("sample", "_times"), samples.drop("_times")
    number = contacts.sparkSession.createDataFrame([(len(datasets),)], "datasets long")
    first = lowest_highest(folded_coverage(contacts, flipped, samples, (contigs[1], contigs[0]), "x", symmetry, least), number, "sample", "v")
    second = lowest_highest(folded_coverage(contacts, flipped, samples, (contigs[0], contigs[1]), "y", symmetry, least, most), number, "sample", "v")
    value = "lowest" if intersection else "highest"
    full = samples.join(first.select("sample", F.col(value).alias("c0")), "sample", "left").join(second.select("sample", F.col(value).alias("c1")), "sample", "left")
    full = full.filter((F.coalesce("c0", F.lit(0)) >= thresholds[0]) & (F.coalesce("c1", F.lit(0)) >= thresholds[1])).select("sample", "chr", "low", "high")
    met = in_samples(contacts, full, "y")
    if ignore_cis:
        met = met.filter("chr_x <> chr_y")
    places = bins.select(F.col("idx").alias("sample"), F.col("actual").alias("chr"), F.col("index_pos").alias("low"), (F.col("index_pos") + F.col("index_size")).alias("high"))
    found = in_samples(met.withColumnRenamed("sample", "_of"), places, "x").groupBy("_of", F.col("sample").alias("idx")).agg(F.sum("cnt").alias("n"))
    return found.join(times.withColumnRenamed("sample", "_of"), "_of").groupBy("idx").agg(F.sum(F.col("n") * F.col("_times")).alias("background"))


def over_background(counts: DataFrame, bg: DataFrame) -> DataFrame:
    """counts with v, n over the background of the bin's slice of y, at least 1."""
    return counts.join(bg.withColumnRenamed("idx", "yi"), "yi", "left").withColumn("v", F.try_divide(F.col("n"), F.greatest(F.lit(1), F.coalesce("background", F.lit(0)))))


def polylines(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """(dataset, chr, points): a track's points (idx, at, n) in order, broken at contig
    borders, in the middle of their bins."""
    at = (F.col("screen_pos") + F.col("index_size") / 2).alias("at")
    rows = counts.join(bins, "idx").groupBy("dataset", "chr").agg(F.array_sort(F.collect_list(F.struct("idx", at, "n"))).alias("points"))
    return rows


def compared(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean absolute deviation and Pearson's r of the shared keys."""
    rows = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return rows.agg(F.round(F.avg(F.abs(F.col("_a") - F.col("_b"))), 9).alias("deviation"), F.round(F.corr("_a", "_b"), 9).alias("r"))


def key_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys both exports have, and how many only one."""
    tagged = a.select(*keys).withColumns({"a": F.lit(1), "b": F.lit(0)}).union(b.select(*keys).withColumns({"a": F.lit(0), "b": F.lit(1)}))
    seen = tagged.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return seen.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("shared"), F.count_if(F.expr("a = 1 and b = 0")).alias("only_a"), F.count_if(F.expr("a = 0 and b = 1")).alias("only_b"))
