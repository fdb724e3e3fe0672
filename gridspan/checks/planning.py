"""Queries of axes, labels and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.functions import text
from gridspan.operators import ingest
from gridspan.plans import axis
from gridspan.plans.annotation_axis import annotation_axis
from gridspan.session import Session
from gridspan.sources import views

from .base import ANNOTATIONS, CONTACTS, CUSTOMER_CONTIGS, query
from .ingesting import SWEEP

SIZE = 30
COLUMNS = ["chr", "index_pos", "index_size", "screen_pos"]


def _shape(n: str, size: str, screen: str = "off + k * 30", where: str = "true", before: str = "g") -> str:
    return f"WITH {CUSTOMER_CONTIGS}, h AS ({before}), k AS (SELECT *, unnest(range(({n})::BIGINT)) AS k FROM h WHERE {where}) SELECT chr, k * 30 AS index_pos, {size} AS index_size, {screen} AS screen_pos FROM k"


def _whole(length: str) -> str:
    return f"SELECT chr, ord, w AS len, sum(w) OVER (ORDER BY ord) - w AS off FROM (SELECT chr, ord, {length} AS w FROM g)"


SHAPES = {
    "smaller": _shape("(len + 29) // 30", "least(30, len - k * 30)", where="len >= 30", before="SELECT * FROM g"),
    "larger": _shape("greatest(1, len // 30)", "CASE WHEN k = greatest(1, len // 30) - 1 THEN len - k * 30 ELSE 30 END", where="len >= 30", before="SELECT * FROM g"),
    "skip": _shape("len // 30", "30", before="SELECT * FROM g"),
    "fit_chrom_smaller": _shape("len // 30", "30", "(off + k * 30)::BIGINT", before=_whole("len // 30 * 30")),
    "fit_chrom_larger": _shape("len // 30", "30", "(off + k * 30)::BIGINT", before=_whole("(len + 29) // 30 * 30")),
    "cover_multiple": f"WITH {CUSTOMER_CONTIGS}, s AS (SELECT unnest(range((SELECT sum(len)::BIGINT + 29 FROM g) // 30)) * 30 AS p) SELECT chr, p - off AS index_pos, 30 AS index_size, p AS screen_pos FROM s JOIN g ON p >= off AND p < off + len",
}
for _how, _sql in SHAPES.items():
    query(f"c5_axis_{_how}", _sql)(lambda spark, sf_dir, h=_how: axis.genome_axis(views.customer_contigs(spark, sf_dir), SIZE, h).bins().select(*COLUMNS))


@query(
    "c10_window_axis",
    f"WITH {CUSTOMER_CONTIGS}, w AS (SELECT *, greatest(0, 35 - off) AS low, least(450, off + len) - off - greatest(0, 35 - off) AS seen FROM g), n AS (SELECT *, greatest(1, (len - low) // 30) AS held FROM w WHERE seen > 0 AND (low > 0 OR len - low >= 30)), k AS (SELECT *, unnest(range(least(held, (seen + 29) // 30)::BIGINT)) AS k FROM n) SELECT chr, low + k * 30 AS index_pos, CASE WHEN k = held - 1 THEN len - low - k * 30 ELSE 30 END AS index_size, off + low + k * 30 AS screen_pos FROM k",
)
def _window(spark, sf_dir):
    return axis.genome_axis(views.customer_contigs(spark, sf_dir), SIZE, window=(35, 450)).bins().select(*COLUMNS)


@query("w1_contig_offsets", f"WITH {CUSTOMER_CONTIGS} SELECT chr, off AS start_at FROM g")
def _offsets(spark, sf_dir):
    return axis.offsets(views.customer_contigs(spark, sf_dir)).select("chr", F.col("offset").alias("start_at"))


@query("c11_contig_ticks", f"WITH {CUSTOMER_CONTIGS} SELECT chr, off AS start_at, off + len / 2.0 AS label_at, off + len AS end_at FROM g")
def _ticks(spark, sf_dir):
    return axis.ticks(views.customer_contigs(spark, sf_dir)).select("chr", F.col("offset").alias("start_at"), "label_at", F.col("end").alias("end_at"))


@query("a16_canvas_size", f"WITH {CUSTOMER_CONTIGS}, k AS (SELECT sum(len // 30 * 30)::BIGINT AS fitted FROM g) SELECT sum(len)::BIGINT AS canvas, any_value(fitted) AS fitted FROM g, k")
def _canvas(spark, sf_dir):
    c = views.customer_contigs(spark, sf_dir)
    return axis.canvas(c).crossJoin(axis.canvas(c, SIZE, "fit_chrom_smaller").withColumnRenamed("canvas", "fitted"))  # single rows


@query("m7_axis_regions", f"WITH {CUSTOMER_CONTIGS} SELECT chr, 0 AS index_pos, len AS index_size, off AS screen_pos, len // 30 AS num_bins FROM g WHERE len >= 30")
def _regions(spark, sf_dir):
    return axis.regions_of(axis.genome_axis(views.customer_contigs(spark, sf_dir), SIZE).bins()).drop("ord")


@query("c7_active_contigs", f"WITH {CONTACTS} SELECT chr_x, chr_y, count(*) AS n_reads FROM c WHERE chr_x IN ('chr1', 'chr3') AND chr_y IN ('chr0', 'chr1') GROUP BY ALL")
def _active(spark, sf_dir):
    listed = lambda *names: views.contigs(spark).filter(F.col("chr").isin(*names))
    rows = ingest.known_contigs(ingest.known_contigs(views.contacts(spark, sf_dir), listed("chr1", "chr3"), "chr_x"), listed("chr0", "chr1"), "chr_y")
    return rows.groupBy("chr_x", "chr_y").agg(F.count(F.lit(1)).alias("n_reads"))


IDS = "ids AS (SELECT DISTINCT type, chr, interval_id, i_s, i_e, coord_s, coord_e FROM sw WHERE type = 'gene')"


@query("c6_annotation_axis_squeeze", f"WITH {SWEEP}, {IDS} SELECT chr, interval_id::BIGINT AS coord, i_s AS index_pos, i_e - i_s AS index_size, 1::BIGINT AS screen_size FROM ids")
def _squeeze(spark, sf_dir):
    intervals = ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND).filter("type = 'gene'")
    return annotation_axis(intervals, 1, "squeeze", "force_separate").select("chr", "coord", "index_pos", "index_size", "screen_size")


@query("c6_annotation_axis_separate", f"WITH {SWEEP}, {IDS}, k AS (SELECT chr, i_s, i_e, coord_s, unnest(range(0, i_e - i_s, 5)) AS p FROM ids) SELECT chr, coord_s + p AS coord, i_s + p AS index_pos, least(5, i_e - i_s - p) AS index_size, least(5, i_e - i_s - p) AS screen_size FROM k")
def _separate(spark, sf_dir):
    intervals = ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND).filter("type = 'gene'")
    return annotation_axis(intervals, 5, "separate", "force_separate").select("chr", "coord", "index_pos", "index_size", "screen_size")


@query("c6_annotation_axis_combine", f"WITH {SWEEP}, {IDS}, bb AS (SELECT chr, coord_s // 5 AS k, min(i_s) AS index_pos, max(i_e) AS hi, sum(i_e - i_s)::BIGINT AS screen_size FROM ids GROUP BY ALL) SELECT chr, k * 5 AS coord, index_pos, hi - index_pos AS index_size, screen_size FROM bb")
def _combine(spark, sf_dir):
    intervals = ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND).filter("type = 'gene'")
    return annotation_axis(intervals, 5, "stretch", "combine").select("chr", "coord", "index_pos", "index_size", "screen_size")


@query("c6_annotation_axis_first", f"WITH {SWEEP}, {IDS}, bb AS (SELECT chr, coord_s // 5 AS k, arg_min({{'a': i_s, 'b': i_e}}, coord_s) AS f FROM ids GROUP BY ALL) SELECT chr, k * 5 AS coord, f.a AS index_pos, f.b - f.a AS index_size, f.b - f.a AS screen_size FROM bb")
def _first(spark, sf_dir):
    intervals = ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND).filter("type = 'gene'")
    return annotation_axis(intervals, 5, "stretch", "first").select("chr", "coord", "index_pos", "index_size", "screen_size")


@query("c6_annotation_axis_power", f"WITH {SWEEP}, {IDS}, bb AS (SELECT chr, coord_s // 5 AS k, arg_max({{'a': i_s, 'b': i_e}}, {{'p': CASE WHEN interval_id = 0 THEN 0 ELSE interval_id & -interval_id END, 'q': -interval_id}}) AS f FROM ids GROUP BY ALL) SELECT chr, k * 5 AS coord, f.a AS index_pos, f.b - f.a AS index_size, f.b - f.a AS screen_size FROM bb")
def _power(spark, sf_dir):
    intervals = ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND).filter("type = 'gene'")
    return annotation_axis(intervals, 5, "stretch", "max_fac_pow_two").select("chr", "coord", "index_pos", "index_size", "screen_size")


BP = "CASE WHEN n = 0 THEN '0 bp' WHEN n % 1000000 = 0 THEN format('{:,}', n // 1000000) || ' Mbp' WHEN n % 1000 = 0 THEN format('{:,}', n // 1000) || ' kbp' ELSE format('{:,}', n) || ' bp' END"


@query("s_readable_bp", f"SELECT n, {BP} AS shown FROM (SELECT DISTINCT o_custkey * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS n FROM orders)")
def _bp(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS n").distinct()
    return rows.select("n", text.readable_bp(F.col("n")).alias("shown"))


@query("s_short_names", "SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '...' ELSE p_name END AS shown FROM part")
def _short(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.shortened(F.col("p_name"), 8).alias("shown"))


@query("w7_numbered_labels", f"WITH {ANNOTATIONS}, s AS (SELECT desc_id, left(info, 6) AS short FROM an), n AS (SELECT *, row_number() OVER (PARTITION BY short ORDER BY desc_id) AS r, count(*) OVER (PARTITION BY short) AS c FROM s) SELECT desc_id, CASE WHEN c > 1 THEN short || ' (' || r || ')' ELSE short END AS label FROM n")
def _labels(spark, sf_dir):
    return text.numbered_labels(views.annotations(spark, sf_dir).select("desc_id", F.substring("info", 1, 6).alias("short")), "short", "desc_id").select("desc_id", "label")


@query("s_safe_file_names", "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM part")
def _safe(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.safe_file_name(F.col("p_name")).alias("safe"))


_S = Session().interface()
_MOST, _LEAST = _S["max_num_bins"] * _S["max_num_bins_factor"], axis.least_bin(_S["min_bin_size"], views.DIVIDEND)


@query(
    "c1_bin_sizes",
    f"""WITH {CUSTOMER_CONTIGS}, w AS (SELECT chr, len * {views.DIVIDEND} AS width FROM g), f AS (SELECT f * 10 ** k AS size FROM (SELECT unnest([{", ".join(map(str, _S["snap_factors"]))}]) AS f), (SELECT unnest(range(12)) AS k))
SELECT chr, width, greatest({_LEAST}, ceil(sqrt(width * width // {_MOST})))::BIGINT AS plain, greatest({_LEAST}, floor(min(size)))::BIGINT AS snapped FROM w JOIN f ON size > sqrt(width * width // {_MOST}) GROUP BY ALL""",
)
def _bin_sizes(spark, sf_dir):
    """Automatic bin sizes of windows on each contig."""
    rows = [(r["chr"], r["len"] * views.DIVIDEND) for r in views.customer_contigs(spark, sf_dir).collect()]  # contigs are few
    size = lambda w, snap: axis.bin_size((0, w, 0, w), _S | {"snap_bin_size": snap}, views.DIVIDEND)[0]
    return spark.createDataFrame([(c, w, size(w, False), size(w, True)) for c, w in rows], "chr string, width long, plain long, snapped long")
