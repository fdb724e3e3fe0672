"""What the contact-map queries share: views in Spark, and the same views as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that it equals."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


BUCKET = "CASE WHEN {m} <= 0 THEN 0 WHEN {m} <= 3 THEN 1 WHEN {m} <= 30 THEN 2 ELSE 3 END"

#: Contacts in base pairs (r) and encoded (c), track reads (t), annotations (an), contigs (g).
RAW = """r AS (
  SELECT l_orderkey * 10 + l_linenumber AS read_id, 'rep' || (l_orderkey % 3) AS dataset, 'chr' || (l_partkey % 4) AS chr_x, 'chr' || (l_suppkey % 4) AS chr_y,
         (l_partkey * 7919 + l_orderkey * 31) % 1000000 AS pos1_s,
         (l_partkey * 7919 + l_orderkey * 31) % 1000000 + CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber * 2000 ELSE 0 END AS pos1_e,
         (l_suppkey * 104729 + l_orderkey * 17 + l_linenumber * 4001) % 1000000 AS pos2_s,
         (l_suppkey * 104729 + l_orderkey * 17 + l_linenumber * 4001) % 1000000 + CASE WHEN l_linenumber % 5 = 0 THEN 7000 ELSE 0 END AS pos2_e,
         floor(l_quantity)::INT AS mapq, l_returnflag = 'N' AS strand1, l_linestatus = 'O' AS strand2, 1::BIGINT AS cnt
  FROM lineitem)"""
CONTACTS = RAW + f""",
c AS (
  SELECT dataset, read_id, chr_x, chr_y, pos1_s // 10000 AS x_s, pos1_e // 10000 AS x_e, pos2_s // 10000 AS y_s, pos2_e // 10000 AS y_e,
         {BUCKET.format(m="mapq")} AS bucket, CASE WHEN strand1 = strand2 THEN 0 ELSE 1 END AS same_strand, CASE WHEN strand1 THEN 0 ELSE 1 END AS y_strand, cnt
  FROM r)"""
TRACK = f"""t AS (
  SELECT event_type AS dataset, event_id AS read_id, 'chr' || (user_id % 4) AS chr, (event_id * 997 + user_id * 131) % 1000000 // 10000 AS x_s,
         {BUCKET.format(m="(floor(value)::INT % 61)")} AS bucket, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS strand, 1::BIGINT AS cnt
  FROM events)"""
ANNOTATIONS = """an AS (
  SELECT CASE WHEN p_size <= 25 THEN 'gene' ELSE 'exon' END AS type, 'chr' || (p_partkey % 4) AS chr, (p_partkey * 38971) % 950000 AS start_bp,
         (p_partkey * 38971) % 950000 + p_size * 200 AS end_bp, p_partkey % 2 = 0 AS forw, p_name AS info, p_partkey AS desc_id
  FROM part)"""
CONTIGS = "g(chr, ord, len) AS (VALUES ('chr0', 0, 102), ('chr1', 1, 102), ('chr2', 2, 102), ('chr3', 3, 102))"


#: Contigs of unequal lengths that follow from the data; off is the length of those before.
CUSTOMER_CONTIGS = """g AS (SELECT *, coalesce(sum(len) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM (SELECT 'nation' || c_nationkey AS chr, c_nationkey AS ord, count(*) // (1 + c_nationkey % 3) AS len FROM customer GROUP BY c_nationkey))"""


def axis_sql(size: int, name: str = "ax") -> str:
    """Bins of the whole genome, the last of a contig taking what is left."""
    return f"""{name} AS (
  SELECT (row_number() OVER (ORDER BY ord, k) - 1)::BIGINT AS idx, chr, ord, k * {size} AS index_pos,
         CASE WHEN k = greatest(1, len // {size}) - 1 THEN len - k * {size} ELSE {size} END AS index_size, ord * 102 + k * {size} AS screen_pos
  FROM (SELECT *, unnest(range(greatest(1, len // {size}))) AS k FROM g))"""


#: The condition of each box test between a box (s, e) and a bin (p, z).
BOX = {
    "enclosed": "{s} >= {p} AND {e} < {p} + {z}",
    "enclosed_only": "{s} >= {p} AND {e} < {p} + {z}",
    "encloses": "{s} <= {p} AND {e} >= {p} + {z} - 1",
    "overlaps": "{e} >= {p} AND {s} < {p} + {z}",
    "overlaps_only": "{e} >= {p} AND {s} < {p} + {z}",
    "first": "{s} >= {p} AND {s} < {p} + {z}",
    "last": "{e} >= {p} AND {e} < {p} + {z}",
    "points_only": "{s} >= {p} AND {s} < {p} + {z}",
}


def counts_sql(mode: str = "enclosed", where: str = "true", x: str = "ax", y: str = "ay", source: str = "c") -> str:
    """(dataset, xi, yi, n) by a plain range join."""
    only = {"enclosed_only": "(x_s < x_e OR y_s < y_e)", "overlaps_only": "(x_s < x_e OR y_s < y_e)", "points_only": "(x_s = x_e AND y_s = y_e)"}.get(mode, "true")
    box = lambda s: BOX[mode].format(s=f"{source}.{s}_s", e=f"{source}.{s}_e", p=f"{s}x.index_pos", z=f"{s}x.index_size")
    return f"""SELECT dataset, xx.idx AS xi, yx.idx AS yi, sum(cnt)::BIGINT AS n
  FROM {source} JOIN {x} xx ON {source}.chr_x = xx.chr AND {box("x")} JOIN {y} yx ON {source}.chr_y = yx.chr AND {box("y")}
  WHERE {where} AND {only} GROUP BY ALL"""
