"""From files of pairs or track reads to contacts: layouts by file, groups of neighbouring
lines, alternative loci, categories, base resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspan.operators import ingest
from gridspan.sources import text

NAMELESS = ("", ".", "-", "/")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, block, line): block is where the split that holds a line begins, and
    line rises within a block."""
    lines = spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_files(spark: SparkSession, path: str | list[str], kind: str = "pairs", layout: str | None = None) -> DataFrame:
    """String columns of all known names with file, block and line. Without a layout each
    file's own first `#columns:` line holds for it, and the default for files without one."""
    lines = numbered_lines(spark, path)
    if layout is not None:
        return text.parse_table(lines, kind, layout)
    own = lines.filter(F.col("value").startswith("#columns:")).groupBy("file").agg(F.min_by("value", F.struct("block", "line")).alias("_layout"))
    kinds = [r["_layout"] for r in own.select("_layout").distinct().collect()]  # as many as there are layouts
    tagged = lines.join(F.broadcast(own), "file", "left")  # a row for each file

    def lines_of(own_layout: Column) -> DataFrame:
        # filters on fields stop at a column that isn't deterministic; below the join they would
        # be tested on lines of other layouts. It never changes line.
        return tagged.filter(own_layout).withColumn("line", F.greatest("line", -1 - F.monotonically_increasing_id())).drop("_layout")

    out = text.parse_table(lines_of(F.col("_layout").isNull()), kind)
    for found in kinds:
        out = out.unionByName(text.parse_table(lines_of(F.col("_layout") == found), kind, found.removeprefix("#columns:").strip()))
    return out


def file_islands(rows: DataFrame, name: str) -> DataFrame:
    """rows (file, block, line, ...) with island: the place of the first of a run of
    neighbouring lines of a file that share a name; nameless lines stand alone.

    Windows never leave a block. A row per block (its last name, and the island open at its
    end) carries runs over from the block before, so one large file isn't one task.
    """
    nameless = F.col(name).isNull() | F.col(name).isin(*NAMELESS)
    inside = Window.partitionBy("file", "block").orderBy("line")
    over = Window.partitionBy("file").orderBy("block")
    blocks = rows.groupBy("file", "block").agg(F.max_by(name, "line").alias("_last"))
    blocks = blocks.select("file", "block", F.lag("_last").over(over).alias("_before"))
    marked = rows.join(F.broadcast(blocks), ["file", "block"])  # a row for each block, as is carried
    before = F.coalesce(F.lag(name).over(inside), F.when(F.row_number().over(inside) == 1, F.col("_before")))
    place = F.struct("block", "line")
    starts = marked.withColumn("_start", F.when(nameless | before.isNull() | (before != F.col(name)), place))
    ends = starts.groupBy("file", "block").agg(F.max("_start").alias("_open"))
    carried = ends.select("file", "block", F.last("_open", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    found = F.coalesce(F.last("_start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried"))
    return starts.join(F.broadcast(carried), ["file", "block"]).withColumn("island", found).drop("_before", "_start", "_carried")


def _own_loci(rows: DataFrame, sides: list[tuple[int, str, str, str, str, str]]) -> DataFrame:
    """A row per line: file, block, line, readid, cnt and loci, an array of all its loci. A
    side is its number and its columns of contig, position, quality, strand and alternatives,
    which come after the locus itself and have quality 0."""
    def loci_of(number: int, chrom: str, pos: str, mapq: str, strand: str, alternatives: str) -> Column:
        own = F.struct(F.lit(number).alias("side"), F.col(chrom).alias("chr"), F.col(pos).cast("long").alias("pos"), ingest.clean_mapq(F.col(mapq)).alias("mapq"), ingest.clean_strand(F.col(strand)).alias("strand"))
        others = F.transform(text.parse_xa(F.col(alternatives)), lambda x: F.struct(F.lit(number).alias("side"), x["chr"].alias("chr"), x["pos"].alias("pos"), F.lit(0).alias("mapq"), x["strand"].alias("strand")))
        return F.concat(F.array(own), others)

    each = [loci_of(*side) for side in sides]
    return rows.select("file", "block", "line", "readid", ingest.clean_count(F.col("cnt")).alias("cnt"), F.flatten(F.array(*each)).alias("loci"))


def _loci(rows: DataFrame, sides: list[tuple[int, str, str, str, str, str]]) -> DataFrame:
    """A row per locus: file, island, place, side, nth, chr, pos, mapq, strand, cnt. Lines are
    parsed before islands are found, so that the stage after the windows holds little code."""
    held = file_islands(_own_loci(rows, sides), "readid").select("file", "island", F.struct("block", "line").alias("place"), "cnt", F.posexplode("loci").alias("nth", "x"))
    return held.select("file", "island", F.struct("place", "nth").alias("at"), "cnt", "x.*")


def _codes(loci: DataFrame, annotations: DataFrame, kinds: tuple[str, ...], cell: int = 20_000) -> DataFrame:
    """loci with codes: an array over kinds, 0 where the locus lies in an annotation, else 1."""
    cells = ingest.covered_cells(annotations, kinds, cell).select(F.col("chr").alias("_c"), F.col("cell").alias("_n"), F.col("spans").alias("_s"))
    met = loci.join(cells, (F.col("chr") == F.col("_c")) & (F.expr(f"pos div {cell}") == F.col("_n")), "left")
    inside = lambda k: F.coalesce(F.exists("_s", lambda s: (s["type"] == k) & (s["start_bp"] <= F.col("pos")) & (s["end_bp"] > F.col("pos"))), F.lit(False))
    return met.withColumn("codes", F.array(*[F.when(inside(k), 0).otherwise(1) for k in kinds])).drop("_c", "_n", "_s")


def _merged(loci: DataFrame, sides: int, kinds: tuple[str, ...], all_loci: bool) -> DataFrame:
    """One row per file and island: for each side s its first locus (chr, strand), span and
    codes, and the quality and count of the whole. With all_loci False only first loci count."""
    mine = lambda s, c: F.when(F.col("side") == s, c)
    aggregates: list[Column] = [F.max_by("cnt", "at").alias("cnt"), F.min("at").alias("first")]
    for s in range(1, sides + 1):
        aggregates += [
            F.min(mine(s, F.struct("at", "chr", "pos", "mapq", "strand"))).alias(f"f{s}"),
            F.min(mine(s, F.col("pos"))).alias(f"low{s}"), F.max(mine(s, F.col("pos"))).alias(f"high{s}"),
            F.max(mine(s, F.col("mapq"))).alias(f"q{s}"), F.count(mine(s, F.lit(1))).alias(f"n{s}"),
            (F.min(mine(s, F.col("chr"))) != F.max(mine(s, F.col("chr")))).alias(f"mixed{s}"),
            *[F.min(mine(s, F.get("codes", F.lit(k)))).alias(f"k{s}_{k}") for k in range(len(kinds))],
        ]
    groups = loci.groupBy("file", "island").agg(*aggregates)
    numbers = range(1, sides + 1)
    mixed, several = F.lit(False), F.lit(True)
    for s in numbers:
        mixed, several = mixed | F.col(f"mixed{s}"), several & (F.col(f"n{s}") > 1)
    point = mixed if all_loci else F.lit(True)
    least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]
    best = least([F.col(f"q{s}") for s in numbers]) + F.when(several & ~mixed, 1).otherwise(0) if all_loci else least([F.col(f"f{s}.mapq") for s in numbers])
    out = [F.struct("file", "island").alias("read_id"), best.alias("mapq"), "cnt"]
    for s in numbers:
        out += [F.col(f"f{s}.chr").alias(f"chr{s}"), F.col(f"f{s}.strand").alias(f"strand{s}")]
        out += [F.when(point, F.col(f"f{s}.pos")).otherwise(F.col(f"{edge}{s}")).alias(f"pos{s}_{e}") for edge, e in (("low", "s"), ("high", "e"))]
        out += [F.array(*[F.col(f"k{s}_{k}") for k in range(len(kinds))]).alias(f"cat{s}")] if kinds else []
    return groups.select(*out)


def contacts_of_files(
    spark: SparkSession, path: str | list[str], dataset: str, contigs: DataFrame, dividend: int, annotations: DataFrame | None = None, kinds: tuple[str, ...] = (), layout: str | None = None, groups: bool = True, upper: bool = False, **flags: bool
) -> DataFrame:
    """Encoded contacts of pair files, with cat_x and cat_y if kinds are named.

    Lines with a mate on an unknown contig are left out. Neighbouring lines of one name are
    one read: its box spans all loci of a mate, unless a mate has several contigs; without
    groups the first locus stands for it. A mate is in an annotation if any locus is.
    """
    if len(kinds) > ingest.MAX_CATEGORIES:
        raise ValueError(f"at most {ingest.MAX_CATEGORIES} annotations can be filtered")
    rows = ingest.known_contigs(read_files(spark, path, "pairs", layout), contigs, "chr1", "chr2")
    loci = _loci(rows, [(1, "chr1", "pos1", "mapq1", "strand1", "xa1"), (2, "chr2", "pos2", "mapq2", "strand2", "xa2")])
    loci = _codes(loci, annotations, kinds) if kinds else loci
    reads = _merged(loci, 2, kinds, groups).withColumnRenamed("chr1", "chr_x").withColumnRenamed("chr2", "chr_y").withColumn("dataset", F.lit(dataset))
    if upper:
        if kinds:
            raise ValueError("categories belong to mates; force the triangle of reads without them")
        reads = ingest.upper_triangle(reads, contigs)
    if not kinds:
        return ingest.encode_contacts(reads, dividend, **flags)
    held = ingest.encode_contacts(reads.withColumn("read_id", F.struct("read_id", "cat1", "cat2")), dividend, **flags)
    return held.withColumns({"cat_x": F.col("read_id.cat1"), "cat_y": F.col("read_id.cat2"), "read_id": F.col("read_id.read_id")})


def track_of_files(spark: SparkSession, path: str | list[str], dataset: str, contigs: DataFrame, dividend: int, layout: str | None = None, groups: bool = True) -> DataFrame:
    """Encoded 1-D reads of track files: dataset, read_id, chr, x_s, x_e, bucket, strand, cnt."""
    rows = ingest.known_contigs(read_files(spark, path, "track", layout), contigs, "chr")
    reads = _merged(_loci(rows, [(1, "chr", "pos", "mapq", "strand", "xa")]), 1, (), groups)
    return reads.select(
        F.lit(dataset).alias("dataset"), "read_id", F.col("chr1").alias("chr"), ingest.unit(F.col("pos1_s"), dividend).alias("x_s"), ingest.unit(F.col("pos1_e"), dividend).alias("x_e"),
        ingest.mapq_bucket(F.col("mapq")).alias("bucket"), F.when(F.col("strand1"), 0).otherwise(1).alias("strand"), "cnt",
    )


def dataset_row(contacts: DataFrame, contigs: DataFrame) -> DataFrame:
    """What a session keeps of new datasets: totals, what they lack, and the fold that a
    one-sided triangle asks for. A dataset without reads has no row."""
    rows = ingest.diagnostics(contacts, contigs)
    return rows.withColumn("symmetry", F.when(F.col("only_upper") | F.col("only_lower"), "mirror").otherwise("all"))
