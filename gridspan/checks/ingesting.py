"""Queries of the ingest operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.operators import diagnostics, ingest
from gridspan.sources import views

from .base import ANNOTATIONS, BUCKET, CONTACTS, RAW, TRACK, query

ALL_CONTACTS = f"WITH {CONTACTS} SELECT * FROM c"


@query("i14_contacts", ALL_CONTACTS)
def _contacts(spark, sf_dir):
    return views.contacts(spark, sf_dir)


@query("i14_track_reads", f"WITH {TRACK} SELECT dataset, read_id, chr, x_s, x_s AS x_e, bucket, strand, cnt FROM t")
def _track(spark, sf_dir):
    return views.track_reads(spark, sf_dir)


@query("i1_known_contigs", f"WITH {RAW} SELECT read_id, chr_x, chr_y FROM r WHERE chr_x IN ('chr0', 'chr2') AND chr_y IN ('chr0', 'chr2')")
def _known(spark, sf_dir):
    listed = views.contigs(spark).filter("chr in ('chr0', 'chr2')")
    return ingest.known_contigs(views.raw_contacts(spark, sf_dir), listed, "chr_x", "chr_y").select("read_id", "chr_x", "chr_y")


@query(
    "i2_cleaning",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN 0 ELSE greatest(0, floor(l_quantity)::INT - 10) END AS mapq,
  l_returnflag = 'N' AS strand, floor(l_tax * 100 + 0.5)::BIGINT AS cnt FROM lineitem""",
)
def _cleaning(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_linenumber", "CASE l_linenumber WHEN 1 THEN '*' WHEN 2 THEN '255' ELSE CAST(CAST(floor(l_quantity) AS INT) - 10 AS STRING) END AS q",
        "CASE WHEN l_returnflag = 'N' THEN '+' ELSE '-' END AS s", "CAST(l_tax * 100 + 0.5 AS STRING) AS n",
    )
    return rows.select("l_orderkey", "l_linenumber", ingest.clean_mapq(F.col("q")).alias("mapq"), ingest.clean_strand(F.col("s")).alias("strand"), ingest.clean_count(F.col("n")).alias("cnt"))


ISLANDS = f"""{RAW}, o AS (SELECT *, lag(read_id) OVER w AS before FROM r WINDOW w AS (PARTITION BY dataset ORDER BY read_id, chr_x, chr_y, pos1_s, pos2_s, mapq)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> read_id THEN 1 ELSE 0 END) OVER (PARTITION BY dataset ORDER BY read_id, chr_x, chr_y, pos1_s, pos2_s, mapq ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM o)"""


@query("w2_read_islands", f"WITH {ISLANDS} SELECT dataset, island, count(*) AS n_reads, min(pos1_s) AS low FROM i GROUP BY ALL")
def _islands(spark, sf_dir):
    order = ["read_id", "chr_x", "chr_y", "pos1_s", "pos2_s", "mapq"]
    rows = ingest.read_islands(views.raw_contacts(spark, sf_dir).select("dataset", *order), "read_id", order, ["dataset"])
    return rows.groupBy("dataset", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("n_reads"), F.min("pos1_s").alias("low"))


def _loci(spark, sf_dir):
    rows = views.raw_contacts(spark, sf_dir).select(
        "dataset", "read_id", "chr_x", F.col("pos1_s").alias("pos1"), F.col("mapq").alias("mapq1"), "strand1", "chr_y", F.col("pos2_s").alias("pos2"), (F.col("mapq") + F.lit(3)).alias("mapq2"), "strand2", "cnt"
    )
    return rows.withColumn("at", F.struct("pos1", "pos2", "mapq1", "chr_x", "chr_y", "strand1", "strand2"))


@query(
    "i3_multi_mappers",
    f"""WITH {RAW}, k AS (
  SELECT dataset, read_id, count(*) AS loci, count(DISTINCT chr_x) > 1 OR count(DISTINCT chr_y) > 1 AS mixed, min(pos1_s) AS a, max(pos1_s) AS b, min(pos2_s) AS p, max(pos2_s) AS q, least(max(mapq), max(mapq) + 3) AS best,
         arg_min({{'x': chr_x, 'y': chr_y, 'f': pos1_s, 's': pos2_s}}, {{'a': pos1_s, 'b': pos2_s, 'c': mapq, 'd': chr_x, 'e': chr_y, 'f': strand1, 'g': strand2}}) AS first
  FROM r GROUP BY ALL)
SELECT dataset, read_id, first.x AS chr_x, first.y AS chr_y, CASE WHEN mixed THEN first.f ELSE a END AS pos1_s, CASE WHEN mixed THEN first.f ELSE b END AS pos1_e,
       CASE WHEN mixed THEN first.s ELSE p END AS pos2_s, CASE WHEN mixed THEN first.s ELSE q END AS pos2_e, (best + CASE WHEN loci > 1 AND NOT mixed THEN 1 ELSE 0 END)::INT AS mapq FROM k""",
)
def _merged(spark, sf_dir):
    return ingest.merge_islands(_loci(spark, sf_dir), ["dataset", "read_id"], "at").drop("strand1", "strand2", "cnt")


@query("i4_first_loci", f"WITH {RAW} SELECT dataset, read_id, min(pos1_s) AS pos1 FROM r GROUP BY ALL")
def _first(spark, sf_dir):
    return ingest.first_loci(_loci(spark, sf_dir), ["dataset", "read_id"], "at").select("dataset", "read_id", "pos1")


@query(
    "i5_upper_triangle",
    f"""WITH {RAW} SELECT read_id, dataset, CASE WHEN sw THEN chr_y ELSE chr_x END AS chr_x, CASE WHEN sw THEN chr_x ELSE chr_y END AS chr_y, CASE WHEN sw THEN pos2_s ELSE pos1_s END AS pos1_s,
  CASE WHEN sw THEN pos1_s ELSE pos2_s END AS pos2_s, CASE WHEN sw THEN strand2 ELSE strand1 END AS strand1 FROM (SELECT *, chr_x > chr_y OR (chr_x = chr_y AND pos1_s > pos2_s) AS sw FROM r)""",
)
def _upper(spark, sf_dir):
    return ingest.upper_triangle(views.raw_contacts(spark, sf_dir), views.contigs(spark)).select("read_id", "dataset", "chr_x", "chr_y", "pos1_s", "pos2_s", "strand1")


@query("i7_base_resolution", f"WITH {RAW} SELECT read_id, pos1_s // 25000 AS x_s, pos1_s // 25000 AS x_e FROM r")
def _units(spark, sf_dir):
    return ingest.encode_contacts(views.raw_contacts(spark, sf_dir), 25_000, multi_map=False).select("read_id", "x_s", "x_e")


@query("i8_mapq_buckets", f"WITH {RAW} SELECT {BUCKET.format(m='mapq')} AS bucket, count(*) AS n_reads FROM r GROUP BY ALL")
def _buckets(spark, sf_dir):
    return views.contacts(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_reads"))


HIT = "CASE WHEN EXISTS (SELECT 1 FROM an WHERE an.type = '{k}' AND an.chr = r.{c} AND r.{p} >= an.start_bp AND r.{p} < an.end_bp) THEN 0 ELSE 1 END"
BITS = ", ".join(HIT.format(k=k, c=c, p=p) + f" AS {n}" for k, c, p, n in (("gene", "chr_x", "pos1_s", "gx"), ("gene", "chr_y", "pos2_s", "gy"), ("exon", "chr_x", "pos1_s", "ex"), ("exon", "chr_y", "pos2_s", "ey")))
CATEGORIES = f"{RAW}, {ANNOTATIONS}, k AS (SELECT dataset, read_id, chr_x, chr_y, pos1_s // 10000 AS x_s, pos1_e // 10000 AS x_e, pos2_s // 10000 AS y_s, pos2_e // 10000 AS y_e, cnt, {BITS} FROM r)"


@query("i9_categories", f"WITH {CATEGORIES} SELECT dataset, gx, gy, ex, ey, count(*) AS n_reads FROM k GROUP BY ALL")
def _categories(spark, sf_dir):
    at = lambda c, n: F.get(F.col(c), F.lit(n))
    rows = views.annotation_contacts(spark, sf_dir)
    return rows.groupBy("dataset", at("cat_x", 0).alias("gx"), at("cat_y", 0).alias("gy"), at("cat_x", 1).alias("ex"), at("cat_y", 1).alias("ey")).agg(F.count(F.lit(1)).alias("n_reads"))


@query("i11_category_code", f"WITH {CATEGORIES} SELECT (gx + 2 * gy + 4 * ex + 8 * ey)::BIGINT AS code, count(*) AS n_reads FROM k GROUP BY ALL")
def _code(spark, sf_dir):
    rows = views.annotation_contacts(spark, sf_dir)
    return rows.groupBy(ingest.category_code(F.col("cat_x"), F.col("cat_y")).alias("code")).agg(F.count(F.lit(1)).alias("n_reads"))


@query("i10_strands", f"WITH {CONTACTS} SELECT dataset, same_strand, y_strand, count(*) AS n_reads FROM c GROUP BY ALL")
def _strands(spark, sf_dir):
    return views.contacts(spark, sf_dir).groupBy("dataset", "same_strand", "y_strand").agg(F.count(F.lit(1)).alias("n_reads"))


@query(
    "i12_diagnostics",
    f"""WITH {CONTACTS}, s AS (SELECT *, chr_x < chr_y OR (chr_x = chr_y AND x_s < y_s) AS up, chr_x > chr_y OR (chr_x = chr_y AND x_s > y_s) AS lo FROM c)
SELECT dataset, count(*) AS total_reads, bool_or(up) AND NOT bool_or(lo) AS only_upper, bool_or(lo) AND NOT bool_or(up) AS only_lower, bool_or(x_s < x_e OR y_s < y_e) AS has_multi,
       min(bucket) < max(bucket) AS has_map_q, min(same_strand) < max(same_strand) OR min(y_strand) < max(y_strand) AS has_strand FROM s GROUP BY ALL""",
)
def _diagnostics(spark, sf_dir):
    return ingest.diagnostics(views.contacts(spark, sf_dir), views.contigs(spark))


@query("i13_totals", f"WITH {RAW} SELECT dataset, count(*) AS total FROM r GROUP BY ALL")
def _totals(spark, sf_dir):
    return ingest.totals(views.contacts(spark, sf_dir))


@query("i15_rollup", f"WITH {CONTACTS} SELECT * EXCLUDE (read_id, cnt), sum(cnt)::BIGINT AS cnt FROM c GROUP BY ALL")
def _rollup(spark, sf_dir):
    return ingest.rollup(views.contacts(spark, sf_dir))


@query("i16_annotation_index", f"WITH {ANNOTATIONS} SELECT type, chr, count(*) AS n_annotations, min(start_bp) AS first_bp FROM an GROUP BY ALL")
def _index(spark, sf_dir):
    return views.annotations(spark, sf_dir).groupBy("type", "chr").agg(F.count(F.lit(1)).alias("n_annotations"), F.min("start_bp").alias("first_bp"))


SWEEP = f"""{ANNOTATIONS}, sp AS (SELECT type, chr, start_bp // 10000 AS s, (end_bp - 1) // 10000 + 1 AS e, desc_id, forw FROM an),
b AS (SELECT DISTINCT type, chr, unnest([s, e]) AS i_s FROM sp), st AS (SELECT *, lead(i_s) OVER (PARTITION BY type, chr ORDER BY i_s) AS i_e FROM b),
kp AS (SELECT * FROM st WHERE i_e IS NOT NULL AND EXISTS (SELECT 1 FROM sp WHERE sp.type = st.type AND sp.chr = st.chr AND sp.s <= st.i_s AND sp.e >= st.i_e)),
nu AS (SELECT *, (row_number() OVER w - 1)::INT AS interval_id, coalesce(sum(i_e - i_s) OVER (PARTITION BY type, chr ORDER BY i_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS coord_s FROM kp WINDOW w AS (PARTITION BY type, chr ORDER BY i_s)),
sw AS (SELECT nu.type, nu.chr, interval_id, i_s, i_e, s AS anno_s, e AS anno_e, desc_id, forw, coord_s, (coord_s + i_e - i_s)::BIGINT AS coord_e FROM nu JOIN sp ON sp.type = nu.type AND sp.chr = nu.chr AND sp.s <= nu.i_s AND sp.e >= nu.i_e)"""


@query("i17_line_sweep", f"WITH {SWEEP} SELECT * FROM sw")
def _sweep(spark, sf_dir):
    return ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND)


@query("a15_annotation_totals", f"WITH {SWEEP} SELECT type, chr, (max(coord_e) - min(coord_s))::BIGINT AS total_size, (max(interval_id) + 1)::INT AS intervals FROM sw GROUP BY ALL")
def _anno_totals(spark, sf_dir):
    return diagnostics.annotation_totals(ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND))


@query("u2_filterable", f"WITH {ANNOTATIONS} SELECT DISTINCT type FROM an WHERE type IN ('gene', 'repeat')")
def _filterable(spark, sf_dir):
    kept = diagnostics.filterable(views.annotations(spark, sf_dir), ["repeat", "gene"])
    return spark.createDataFrame([(k,) for k in kept], "type string")


@query(
    "a22_unique_interactions",
    f"""WITH {RAW}, o AS (SELECT *, lag(pos1_s) OVER w AS b1, lag(pos2_s) OVER w AS b2 FROM r WINDOW w AS (PARTITION BY dataset, chr_x, chr_y ORDER BY pos1_s, pos2_s, read_id, mapq))
SELECT dataset, count(*) AS interactions, count(*) FILTER (b1 IS NULL OR b1 <> pos1_s OR b2 <> pos2_s) AS unique_interactions, count(*) / (4 * 1020.0 * 4 * 1020.0) AS per_kb2 FROM o GROUP BY ALL""",
)
def _unique(spark, sf_dir):
    return diagnostics.unique_interactions(views.raw_contacts(spark, sf_dir), views.contigs(spark), views.DIVIDEND, ["read_id", "mapq"])


@query("a23_multimapper_histogram", f"WITH {RAW}, h AS (SELECT dataset, read_id, count(*) AS n_maps, count(DISTINCT chr_x) AS n_contigs FROM r GROUP BY ALL) SELECT n_maps, n_contigs, count(*) AS n_reads FROM h GROUP BY ALL")
def _histogram(spark, sf_dir):
    return diagnostics.multimapper_histogram(views.raw_contacts(spark, sf_dir), ["dataset", "read_id"])


@query("k12_index_sizes", f"WITH {CONTACTS} SELECT dataset, chr_x, chr_y, count(*) AS n_reads, sum(CASE WHEN x_s < x_e OR y_s < y_e THEN 1 ELSE 0 END)::BIGINT AS n_boxes FROM c GROUP BY ALL")
def _sizes(spark, sf_dir):
    return diagnostics.pair_sizes(views.contacts(spark, sf_dir))


