"""From cleaned reads to contacts: loci, groups of multi-mapping reads, codes and categories."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.staging import staged

#: Thresholds that part mapping qualities into buckets.
MAPQ_THRESHOLDS = (3, 30)
#: Filterable annotations at most.
MAX_CATEGORIES = 3
#: Rows of a range in which islands are numbered, on average: what one task sorts.
RANGE_ROWS = 1 << 19


def known_contigs(reads: DataFrame, contigs: DataFrame, *columns: str) -> DataFrame:
    """Reads all of whose mates lie on a listed contig. The list is broadcast: reads dealt by
    contig would be as few tasks as there are contigs. A null-safe equality keeps Spark from
    testing names for null beneath the parsing of lines, all of which would be done twice."""
    names = F.broadcast(contigs.select("chr").filter("chr is not null").distinct())
    for c in columns:
        reads = reads.join(names.withColumnRenamed("chr", "_known"), F.col(c).eqNullSafe(F.col("_known")), "left_semi")
    return reads


def clean_mapq(text: Column) -> Column:
    """Empty, nomapq, 255, * and . are 0; negative values too; what isn't a number is an error."""
    null = text.isNull() | text.isin("", "nomapq", "255", "*", ".")
    return F.when(null, F.lit(0)).otherwise(F.greatest(F.lit(0), text.cast("int")))


def clean_strand(text: Column) -> Column:
    return F.when(text == "+", True).when(text == "-", False).otherwise(F.raise_error(F.concat(F.lit("strand is neither + nor -: "), text)).cast("boolean"))


def clean_count(text: Column) -> Column:
    return F.floor(text.cast("double")).cast("long")


def mapq_bucket(mapq: Column, thresholds: tuple[int, ...] = MAPQ_THRESHOLDS) -> Column:
    """0 for 0, n for up to the n-th threshold, one more beyond the last."""
    out = F.when(mapq <= 0, 0)
    for n, t in enumerate(thresholds):
        out = out.when(mapq <= t, n + 1)
    return out.otherwise(len(thresholds) + 1)


def unit(position: Column, dividend: int) -> Column:
    return F.floor(position / F.lit(dividend)).cast("long") if dividend != 1 else position.cast("long")


def encode_contacts(reads: DataFrame, dividend: int, thresholds: tuple[int, ...] = MAPQ_THRESHOLDS, multi_map: bool = True, strands: bool = True, map_q: bool = True) -> DataFrame:
    """Boxes in dividend units, mapping-quality buckets and strand codes (same_strand: 0 if
    both mates agree; y_strand: 0 if the first is forward). A dataset that lacks a
    property gets the code that every filter lets through."""
    end = lambda s, e: unit(F.col(e) if multi_map else F.col(s), dividend)
    code = lambda c: F.when(c, 0).otherwise(1) if strands else F.lit(0)
    return reads.select(
        "dataset",
        "read_id",
        "chr_x",
        "chr_y",
        unit(F.col("pos1_s"), dividend).alias("x_s"),
        end("pos1_s", "pos1_e").alias("x_e"),
        unit(F.col("pos2_s"), dividend).alias("y_s"),
        end("pos2_s", "pos2_e").alias("y_e"),
        (mapq_bucket(F.col("mapq"), thresholds) if map_q else F.lit(1)).alias("bucket"),
        code(F.col("strand1") == F.col("strand2")).alias("same_strand"),
        code(F.col("strand1")).alias("y_strand"),
        "cnt",
    )


def encode_track(reads: DataFrame, dividend: int, thresholds: tuple[int, ...] = MAPQ_THRESHOLDS) -> DataFrame:
    """Track reads as 1-D boxes; strand is 0 for forward."""
    return reads.select(
        "dataset",
        "read_id",
        "chr",
        unit(F.col("pos"), dividend).alias("x_s"),
        unit(F.col("pos"), dividend).alias("x_e"),
        mapq_bucket(F.col("mapq"), thresholds).alias("bucket"),
        F.when(F.col("strand"), 0).otherwise(1).alias("strand"),
        "cnt",
    )


def upper_triangle(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Mates swapped, with all that belongs to them, so that the first comes first in
    (contig order, position)."""
    order = lambda c, o: F.broadcast(contigs.select(F.col("chr").alias(c), F.col("ord").alias(o)))  # noqa: E731  a row for each contig
    sided = reads.join(order("_cx", "_ox"), F.col("chr_x") == F.col("_cx")).join(order("_cy", "_oy"), F.col("chr_y") == F.col("_cy"))
    swap = (F.col("_ox") > F.col("_oy")) | ((F.col("_ox") == F.col("_oy")) & (F.col("pos1_s") > F.col("pos2_s")))
    pairs = [("chr_x", "chr_y"), ("pos1_s", "pos2_s"), ("pos1_e", "pos2_e"), ("strand1", "strand2")]
    swapped = {}
    for a, b in pairs:
        swapped |= {a: F.when(swap, F.col(b)).otherwise(F.col(a)), b: F.when(swap, F.col(a)).otherwise(F.col(b))}
    return sided.withColumns(swapped).select(reads.columns)


def read_islands(rows: DataFrame, name: str, order: list[str], partition: list[str], parts: int | None = None) -> DataFrame:
    """island: a number for every run of neighbouring rows with the same read name, in the
    given order within a partition (a file, say). Rows without a name ('', '.', '-', '/',
    null) are islands of their own.

    Rows are dealt to ranges of the order and numbered within these; a row per range brings
    the islands before it, and whether its first island began there, so a large partition
    isn't one task. There are as many ranges as RANGE_ROWS asks for. They are a staged table,
    as a second draw of their bounds could differ; it holds all columns of rows.
    """
    parts = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE_ROWS))
    ranged = rows.repartitionByRange(parts, *partition, *order).sortWithinPartitions(*partition, *order)
    ranges = staged(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    inside, over = Window.partitionBy("_range", *partition).orderBy("_at"), Window.partitionBy(*partition).orderBy("_range")
    nameless = lambda c: F.col(c).isNull() | F.col(c).cast("string").isin("", ".", "-", "/")
    starts = nameless(name) | F.lag(name).over(inside).isNull() | (F.lag(name).over(inside) != F.col(name))
    marked = ranges.repartition(parts, "_range", *partition).withColumn("_start", starts.cast("int"))
    blocks = marked.groupBy("_range", *partition).agg(F.sum("_start").alias("_n"), F.min_by(name, "_at").alias("_first"), F.max_by(name, "_at").alias("_last"))
    goes_on = ~nameless("_first") & F.coalesce(F.lag("_last").over(over) == F.col("_first"), F.lit(False))
    blocks = blocks.withColumn("_on", goes_on.cast("int"))
    before = F.sum(F.col("_n") - F.col("_on")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    # the first block of a partition has none before it, so at most one block of a range is left
    blocks = blocks.select("_range", *[F.col(c).alias(f"_of_{c}") for c in partition], (before - F.col("_on")).alias("_before")).filter("_before is not null")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in partition]
    met = marked.join(F.broadcast(blocks.withColumnRenamed("_range", "_in")), reduce(and_, same, F.col("_range") == F.col("_in")), "left")
    running = F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("island", running + F.coalesce("_before", F.lit(0))).select(*rows.columns, "island")


def merge_islands(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One box per group of alternative loci.

    rows: one per locus, with chr_x, pos1, mapq1, strand1, chr_y, pos2, mapq2, strand2, cnt.
    A side whose loci lie on one contig spans them all; with several contigs, both sides
    are the point of the first locus. Quality is the lesser of the sides' best ones, plus 1
    if each side has two loci or more and no side is mixed. Strand and contig are the
    first locus', cnt the last one's.
    """
    at = F.col(order)
    merged = rows.groupBy(*keys).agg(
        *[F.min_by(c, at).alias(c) for c in ("chr_x", "chr_y", "strand1", "strand2")],
        F.max_by("cnt", at).alias("cnt"),
        F.count(F.lit(1)).alias("loci"),
        (F.min("chr_x") != F.max("chr_x")).alias("several_x"),
        (F.min("chr_y") != F.max("chr_y")).alias("several_y"),
        *[f(c).alias(f"{n}_{c}") for c in ("pos1", "pos2") for n, f in (("low", F.min), ("high", F.max))],
        *[F.min_by(c, at).alias(f"first_{c}") for c in ("pos1", "pos2")],
        F.least(F.max("mapq1"), F.max("mapq2")).alias("best"),
    )
    mixed = F.col("several_x") | F.col("several_y")
    edge = lambda c, side: F.when(mixed, F.col(f"first_{c}")).otherwise(F.col(f"{side}_{c}"))
    return merged.select(
        *keys, "chr_x", "chr_y",
        edge("pos1", "low").alias("pos1_s"), edge("pos1", "high").alias("pos1_e"), edge("pos2", "low").alias("pos2_s"), edge("pos2", "high").alias("pos2_e"),
        "strand1", "strand2", (F.col("best") + F.when((F.col("loci") > 1) & ~mixed, 1).otherwise(0)).alias("mapq"), "cnt",
    )


def first_loci(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Without grouping: the first locus of each read."""
    at = F.col(order)
    sides = [F.min_by(c, at).alias(c) for c in ("chr_x", "pos1", "mapq1", "strand1", "chr_y", "pos2", "mapq2", "strand2", "cnt")]
    return rows.groupBy(*keys).agg(*sides)


def covered_units(annotations: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(chr, start_bp, end_bp, type): overlapping annotations of a type merged, so that a
    position lies in one interval of a type at most."""
    w = Window.partitionBy("type", "chr").orderBy("start_bp", "end_bp")
    reach = F.max("end_bp").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = annotations.filter(F.col("type").isin(*kinds)).withColumn("new", F.coalesce((F.col("start_bp") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("type", "chr", "run").agg(F.min("start_bp").alias("start_bp"), F.max("end_bp").alias("end_bp")).drop("run")


def covered_cells(annotations: DataFrame, kinds: tuple[str, ...], cell: int) -> DataFrame:
    """(chr, cell, spans): the merged annotations in each cell of a contig. As those of one
    type don't overlap, a cell has a bounded number of them."""
    merged = covered_units(annotations, kinds)
    cells = merged.withColumn("cell", F.explode(F.expr(f"sequence(start_bp div {cell}, greatest(start_bp, end_bp - 1) div {cell})")))
    return cells.groupBy("chr", "cell").agg(F.collect_list(F.struct("type", "start_bp", "end_bp")).alias("spans"))


def with_categories(reads: DataFrame, annotations: DataFrame, kinds: tuple[str, ...], dividend: int, cell: int = 20_000) -> DataFrame:
    """Encoded contacts with cat_x and cat_y: an array over kinds, 0 where a mate lies in
    an annotation (start <= position < end, in base pairs) and 1 where not.

    Each side is one equi-join on (chr, cell) with the table of cells, which Spark
    broadcasts if it is small; the intervals of the cell are then looked through in place.
    """
    if len(kinds) > MAX_CATEGORIES:
        raise ValueError(f"at most {MAX_CATEGORIES} annotations can be filtered")
    cells, out = covered_cells(annotations, kinds, cell), reads
    for side, chrom, pos in (("x", "chr_x", "pos1_s"), ("y", "chr_y", "pos2_s")):
        mine = cells.select(F.col("chr").alias("_c"), F.col("cell").alias("_n"), F.col("spans").alias("_s"))
        out = out.join(mine, (F.col(chrom) == F.col("_c")) & (F.expr(f"{pos} div {cell}") == F.col("_n")), "left")
        inside = lambda k, p=pos: F.exists("_s", lambda s: (s["type"] == k) & (s["start_bp"] <= F.col(p)) & (s["end_bp"] > F.col(p)))
        codes = F.array(*[F.when(inside(k), 0).otherwise(1) for k in kinds])
        out = out.withColumn(f"_cat_{side}", codes).drop("_c", "_n", "_s")
    encoded = encode_contacts(out.withColumn("read_id", F.struct("read_id", F.col("_cat_x").alias("x"), F.col("_cat_y").alias("y"))), dividend)
    return encoded.withColumns({"cat_x": F.col("read_id.x"), "cat_y": F.col("read_id.y"), "read_id": F.col("read_id.read_id")})


def category_code(cat_x: Column, cat_y: Column) -> Column:
    """Bits of both mates, interleaved, as one number."""
    bits = F.flatten(F.zip_with(cat_x, cat_y, lambda x, y: F.array(x, y)))
    return F.aggregate(F.transform(bits, lambda b, i: (b * F.pow(F.lit(2), i)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def diagnostics(contacts: DataFrame, contigs: DataFrame) -> DataFrame:
    """What a new dataset lacks, one row per dataset: which triangle it fills, whether it
    has multi-mappers, several quality buckets and both strands."""
    order = lambda c, o: F.broadcast(contigs.select(F.col("chr").alias(c), F.col("ord").alias(o)))  # noqa: E731  a row for each contig
    sided = contacts.join(order("_cx", "_ox"), F.col("chr_x") == F.col("_cx")).join(order("_cy", "_oy"), F.col("chr_y") == F.col("_cy"))
    upper = (F.col("_ox") < F.col("_oy")) | ((F.col("_ox") == F.col("_oy")) & (F.col("x_s") < F.col("y_s")))
    lower = (F.col("_ox") > F.col("_oy")) | ((F.col("_ox") == F.col("_oy")) & (F.col("x_s") > F.col("y_s")))
    return sided.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total_reads"),
        (F.bool_or(upper) & ~F.bool_or(lower)).alias("only_upper"),
        (F.bool_or(lower) & ~F.bool_or(upper)).alias("only_lower"),
        F.bool_or((F.col("x_s") < F.col("x_e")) | (F.col("y_s") < F.col("y_e"))).alias("has_multi"),
        (F.min("bucket") < F.max("bucket")).alias("has_map_q"),
        ((F.min("same_strand") < F.max("same_strand")) | (F.min("y_strand") < F.max("y_strand"))).alias("has_strand"),
    )


def totals(contacts: DataFrame) -> DataFrame:
    """(dataset, total): read groups, not their counts."""
    return contacts.groupBy("dataset").agg(F.count(F.lit(1)).alias("total"))


def rollup(contacts: DataFrame) -> DataFrame:
    """Contacts that no filter can tell apart, counted once: a smaller table for repeated queries."""
    keys = [c for c in ("dataset", "chr_x", "chr_y", "x_s", "x_e", "y_s", "y_e", "bucket", "same_strand", "y_strand", "cat_x", "cat_y") if c in contacts.columns]
    return contacts.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def line_sweep(annotations: DataFrame, dividend: int) -> DataFrame:
    """Disjoint sub-intervals of each type and contig, in dividend units, one row for every
    annotation active in one.

    i_s, i_e: the sub-interval; interval_id: its number; coord_s, coord_e: its place when
    gaps between annotations are left out; anno_s, anno_e: the annotation.
    """
    spans = annotations.withColumns({"anno_s": unit(F.col("start_bp"), dividend), "anno_e": unit(F.col("end_bp") - 1, dividend) + 1}).filter("anno_e > anno_s")
    edges = spans.select("type", "chr", F.explode(F.array("anno_s", "anno_e")).alias("i_s")).distinct()
    w = Window.partitionBy("type", "chr").orderBy("i_s")
    steps = edges.withColumn("i_e", F.lead("i_s").over(w)).filter("i_e is not null")
    # one more or one less annotation at every edge; a running sum tells which steps are covered
    turns = spans.select("type", "chr", F.inline(F.array(F.struct(F.col("anno_s").alias("i_s"), F.lit(1).alias("d")), F.struct(F.col("anno_e").alias("i_s"), F.lit(-1).alias("d")))))
    depth = turns.groupBy("type", "chr", "i_s").agg(F.sum("d").alias("d")).withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = steps.join(depth.filter("depth > 0").select("type", "chr", "i_s"), ["type", "chr", "i_s"])
    before = F.coalesce(F.sum(F.col("i_e") - F.col("i_s")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumns({"interval_id": F.row_number().over(w) - 1, "coord_s": before}).withColumn("coord_e", F.col("coord_s") + F.col("i_e") - F.col("i_s"))
    # an annotation begins and ends with a step, and all steps between are covered at least by it
    first = kept.select("type", "chr", F.col("i_s").alias("anno_s"), F.col("interval_id").alias("_first"))
    last = kept.select("type", "chr", F.col("i_e").alias("anno_e"), F.col("interval_id").alias("_last"))
    ranks = spans.select("type", "chr", "desc_id", "forw", "anno_s", "anno_e").join(first, ["type", "chr", "anno_s"]).join(last, ["type", "chr", "anno_e"])
    ranks = ranks.withColumn("interval_id", F.explode(F.sequence("_first", "_last")))
    return ranks.join(kept, ["type", "chr", "interval_id"]).select("type", "chr", "interval_id", "i_s", "i_e", "anno_s", "anno_e", "desc_id", "forw", "coord_s", "coord_e")
