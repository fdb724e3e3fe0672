"""Queries over a store: its list, and heatmaps that summaries answer."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import functions as F

from gridspan.sources import views
from gridspan.staging import shared_dir
from gridspan.store import Store

from .base import CONTACTS, CONTIGS, axis_sql, counts_sql, query


def built(spark, sf_dir, factors=(1, 5, 10)) -> Store:
    """rep0 in two batches, rep1 and rep2 in one, flat without strands or qualities, empty without reads."""
    store = Store.create(spark, f"{shared_dir(spark)}/contacts-{uuid.uuid4().hex}.store", views.contigs(spark), views.DIVIDEND, factors)
    rows = views.contacts(spark, sf_dir)
    for odd in (0, 1):
        store.add("rep0", rows.filter((F.col("dataset") == "rep0") & (F.col("read_id") % 2 == odd)))
    for name in ("rep1", "rep2"):
        store.add(name, rows.filter(F.col("dataset") == name))
    flat = rows.filter("dataset = 'rep1' and chr_x < chr_y").withColumns({"bucket": F.lit(1), "same_strand": F.lit(0), "y_strand": F.lit(0), "x_e": F.col("x_s"), "y_e": F.col("y_s")})
    store.add("flat", flat)
    store.add("empty", rows.limit(0))
    return store


FLAT = "SELECT 'flat' AS dataset, read_id, chr_x, chr_y, x_s, x_s AS x_e, y_s, y_s AS y_e, 1 AS bucket, 0 AS same_strand, 0 AS y_strand, cnt FROM c WHERE dataset = 'rep1' AND chr_x < chr_y"
ALL = f"{CONTACTS}, {CONTIGS}, al AS (SELECT * FROM c UNION ALL {FLAT})"


@query(
    "i14_store_list",
    f"""WITH {ALL}, d AS (SELECT dataset, CASE WHEN dataset = 'rep0' THEN 2 ELSE 1 END AS batches, count(*) AS total, bool_and(chr_x < chr_y OR (chr_x = chr_y AND x_s <= y_s)) AS only_upper, bool_and(chr_x > chr_y OR (chr_x = chr_y AND x_s >= y_s)) AS only_lower,
bool_or(x_s < x_e OR y_s < y_e) AS has_multi, min(bucket) < max(bucket) AS has_map_q, min(same_strand) < max(same_strand) OR min(y_strand) < max(y_strand) AS has_strand FROM al GROUP BY ALL)
SELECT *, CASE WHEN only_upper OR only_lower THEN 'mirror' ELSE 'all' END AS symmetry FROM d UNION ALL SELECT 'empty', 1, 0, false, false, false, false, false, 'all'""",
)
def _list(spark, sf_dir):
    return built(spark, sf_dir).datasets()


def _sql(mode, where, value):
    only = {"enclosed_only": "(x_s < x_e OR y_s < y_e)", "points_only": "(x_s = x_e AND y_s = y_e)"}.get(mode, "true")
    return f"""WITH {ALL}, {axis_sql(20)}, {axis_sql(20, 'ay')}, n AS ({counts_sql(mode, f"{where} AND {only} AND al.dataset IN ('rep0', 'flat', 'rep2')", source="al")}), t AS (SELECT count(*) FILTER (dataset <> 'rep2') AS ta, count(*) FILTER (dataset = 'rep2') AS tb FROM al WHERE dataset <> 'rep1'),
q AS (SELECT xi, yi, coalesce(sum(n) FILTER (dataset <> 'rep2'), 0) AS a, coalesce(sum(n) FILTER (dataset = 'rep2'), 0) AS b FROM n GROUP BY ALL) SELECT xi, yi, round({value}, 6) AS v FROM q, t"""


def _heatmap(spark, sf_dir, **settings):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        h = built(spark, sf_dir).heatmap(["rep0", "flat", "empty"], ["rep2"], bin_size=(20, 20), scale="dont", between_group="sub", **settings)
    return h.values().select("xi", "yi", F.round("v", 6).alias("v"))


for _mode in ("enclosed", "enclosed_only", "overlaps", "points_only", "last"):
    query(f"i15_summaries_{_mode}", _sql(_mode, "true", "a - b"))(lambda spark, sf_dir, m=_mode: _heatmap(spark, sf_dir, mode=m))


# flat has neither qualities nor strands, so both filters let it through
@query("i15_summaries_per_million", _sql("enclosed", "(bucket > 1 AND bucket <= 254 AND same_strand = 0 OR al.dataset = 'flat')", "1e6 * a / ta - 1e6 * b / tb"))
def _per_million(spark, sf_dir):
    return _heatmap(spark, sf_dir, map_q=(1, 254, False), direction="same", normalize="rpm")
