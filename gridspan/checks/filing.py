"""Queries that write the driver's tables as files of lines and ingest these."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan import staging
from gridspan.plans import files
from gridspan.sources import views

from .base import ANNOTATIONS, BUCKET, query

#: Lines: one read per order, whose lines are alternative loci; every third has another one.
LINES = """ln AS (
  SELECT l_orderkey AS o, l_linenumber AS k, 'chr' || (l_orderkey % 4) AS c1, (l_partkey * 7919 + l_orderkey * 31) % 1000000 AS p1,
         'chr' || ((l_orderkey + CASE WHEN l_linenumber > 4 THEN 1 ELSE 0 END) % 4) AS c2, (l_suppkey * 104729 + l_orderkey * 17) % 1000000 AS p2,
         l_returnflag = 'N' AS s1, l_linestatus = 'O' AS s2, floor(l_quantity)::INT AS q1, l_linenumber * 9 AS q2
  FROM lineitem)"""
LOCI = f"""{LINES}, lo AS (
  SELECT o, k, 0 AS n, 1 AS side, c1 AS c, p1 AS p, q1 AS q, s1 AS s FROM ln UNION ALL SELECT o, k, 1, 1, c1, (p1 + 77777) % 1000000, 0, false FROM ln WHERE k % 3 = 0
  UNION ALL SELECT o, k, 0, 2, c2, p2, q2, s2 FROM ln),
md AS (SELECT o, side, min(c) <> max(c) AS mixed, min(p) AS low, max(p) AS high, max(q) AS best, count(*) AS loci, arg_min(p, k * 10 + n) AS p, arg_min(c, k * 10 + n) AS c, arg_min(s, k * 10 + n) AS s FROM lo GROUP BY ALL),
rd AS (SELECT a.o, a.c AS chr_x, b.c AS chr_y, a.mixed OR b.mixed AS mixed, a.s AS s1, b.s AS s2,
  CASE WHEN a.mixed OR b.mixed THEN a.p ELSE a.low END // 10000 AS x_s, CASE WHEN a.mixed OR b.mixed THEN a.p ELSE a.high END // 10000 AS x_e,
  CASE WHEN a.mixed OR b.mixed THEN b.p ELSE b.low END // 10000 AS y_s, CASE WHEN a.mixed OR b.mixed THEN b.p ELSE b.high END // 10000 AS y_e,
  least(a.best, b.best) + CASE WHEN a.loci > 1 AND b.loci > 1 AND NOT (a.mixed OR b.mixed) THEN 1 ELSE 0 END AS mapq
  FROM md a JOIN md b ON a.o = b.o AND a.side = 1 AND b.side = 2)"""
HITS = """hit AS (SELECT o, side, type, bool_or(p >= start_bp AND p < end_bp) AS h FROM lo JOIN an ON lo.c = an.chr GROUP BY ALL),
ct AS (SELECT o, coalesce(bool_or(h) FILTER (side = 1 AND type = 'gene'), false) AS gx, coalesce(bool_or(h) FILTER (side = 2 AND type = 'exon'), false) AS ey FROM hit GROUP BY ALL)"""


def _written(spark, sf_dir) -> str:
    """Two kinds of files: with the default layout, and with a layout of their own. An order's
    lines are neighbours in one file, by number and then as the table has them, as numbers
    repeat. There are more files with more partitions, so that no task sorts a third of all."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey AS o", "l_linenumber AS k", "concat('chr', l_orderkey % 4) AS c1", "(l_partkey * 7919 + l_orderkey * 31) % 1000000 AS p1",
        "concat('chr', (l_orderkey + IF(l_linenumber > 4, 1, 0)) % 4) AS c2", "(l_suppkey * 104729 + l_orderkey * 17) % 1000000 AS p2",
        "IF(l_returnflag = 'N', '+', '-') AS s1", "IF(l_linestatus = 'O', '+', '-') AS s2", "CAST(floor(l_quantity) AS INT) AS q1", "l_linenumber * 9 AS q2",
        "IF(l_linenumber % 3 = 0, concat('XA:Z:chr', l_orderkey % 4, ',-', (((l_partkey * 7919 + l_orderkey * 31) % 1000000) + 77777) % 1000000, ',10M,0;'), '') AS xa",
        "_metadata.file_path AS f", "_metadata.row_index AS r",
    )
    path = f"{staging.shared_dir(spark)}/lines-{sf_dir.strip('/').replace('/', '-')}"
    first = F.concat_ws("\t", "o", "c1", "p1", "c2", "p2", "s1", "s2", F.lit("."), "q1", "q2", "xa", F.lit(""), F.lit("1"))
    own = F.concat_ws(" ", "c2", "p2", "o", "c1", "p1", "q2", "q1", "s2", "s1", F.when(F.col("xa") == "", "notag").otherwise(F.col("xa")))
    parts = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, "o").sortWithinPartitions("o", "k", "f", "r")
    ranged.filter("o % 2 = 0").select(first.alias("value")).write.mode("overwrite").text(f"{path}/default")
    heads = spark.range(parts).select(F.lit("#columns: chr2 pos2 readid chr1 pos1 mapq2 mapq1 strand2 strand1 xa1").alias("value"), (F.col("id") * 0 - 1).alias("o"), F.lit(0).alias("k"), F.lit("").alias("f"), F.lit(0).cast("long").alias("r"), F.col("id"))
    body = rows.filter("o % 2 = 1").select(own.alias("value"), "o", "k", "f", "r", (F.expr("o div 2") % parts).alias("id"))
    heads.unionByName(body).repartition(parts, "id").sortWithinPartitions("id", "o", "k", "f", "r").select("id", "value").write.mode("overwrite").partitionBy("id").text(f"{path}/own")
    return path


def _contacts(spark, sf_dir, **settings):
    path = _written(spark, sf_dir)
    read = lambda p: files.contacts_of_files(spark, p, "all", views.contigs(spark), views.DIVIDEND, **settings)
    return read(f"{path}/default").unionByName(read(f"{path}/own/*"))


@query("i14_files", f"WITH {LOCI} SELECT chr_x, chr_y, x_s, x_e, y_s, y_e, {BUCKET.format(m='mapq')} AS bucket, CASE WHEN s1 = s2 THEN 0 ELSE 1 END AS same_strand, CASE WHEN s1 THEN 0 ELSE 1 END AS y_strand, count(*) AS reads FROM rd GROUP BY ALL")
def _files(spark, sf_dir):
    keys = ["chr_x", "chr_y", "x_s", "x_e", "y_s", "y_e", "bucket", "same_strand", "y_strand"]
    return _contacts(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("reads"))


@query("i9_file_categories", f"WITH {ANNOTATIONS}, {LOCI}, {HITS} SELECT chr_x, gx, ey, count(*) AS reads FROM rd JOIN ct USING (o) GROUP BY ALL")
def _file_categories(spark, sf_dir):
    rows = _contacts(spark, sf_dir, annotations=views.annotations(spark, sf_dir), kinds=("gene", "exon"))
    code = lambda c, k: F.get(F.col(c), F.lit(k)) == 0
    return rows.groupBy("chr_x", code("cat_x", 0).alias("gx"), code("cat_y", 1).alias("ey")).agg(F.count(F.lit(1)).alias("reads"))


@query("i4_file_first_loci", f"WITH {LINES} SELECT chr_x, chr_y, x, y, count(*) AS reads FROM (SELECT o, arg_min(c1, k) AS chr_x, arg_min(c2, k) AS chr_y, arg_min(p1, k) // 10000 AS x, arg_min(p2, k) // 10000 AS y FROM ln GROUP BY ALL) GROUP BY ALL")
def _first(spark, sf_dir):
    rows = _contacts(spark, sf_dir, groups=False)
    return rows.groupBy("chr_x", "chr_y", F.col("x_s").alias("x"), F.col("y_s").alias("y")).agg(F.count(F.lit(1)).alias("reads"))


@query("i12_dataset_row", f"WITH {LOCI} SELECT 'all' AS dataset, count(*) AS total_reads, bool_or(x_s < x_e OR y_s < y_e) AS has_multi, 'all' AS symmetry FROM rd")
def _row(spark, sf_dir):
    found = files.dataset_row(_contacts(spark, sf_dir), views.contigs(spark))
    return found.select("dataset", "total_reads", "has_multi", "symmetry")
