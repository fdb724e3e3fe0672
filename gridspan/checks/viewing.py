"""Queries of viewpoints: beside the heatmap from one pass, and where they lie on the screen."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.plans.annotation_window import annotation_bins
from gridspan.plans.axis import genome_axis
from gridspan.plans.viewpoint import viewpoint_places
from gridspan.sources import views

from .annotating import SIZE, WINDOW, _sweep, axis_of
from .base import CONTACTS, CONTIGS, axis_sql, query
from .ingesting import SWEEP
from .whole import heatmap

COLUMN, ROW = (80, 250), (204, 204 + 90)


def viewpoint_sql(low, high, name):
    return f"""{name} AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS idx, chr, ord, greatest({low}, ord * 102) - ord * 102 AS index_pos, least({high}, ord * 102 + len) - greatest({low}, ord * 102) AS index_size
  FROM g WHERE ord * 102 + len >= {low} AND ord * 102 <= {high})"""


def _counts(system, x, y, turned=False):
    a, b = ("y", "x") if turned else ("x", "y")
    return f"""SELECT dataset, '{system}' AS system, x.idx AS xi, y.idx AS yi, {"0" if turned else "sum(cnt)"} AS a, {"sum(cnt)" if turned else "0"} AS b FROM f JOIN {x} x ON x.chr = f.chr_{a} AND f.{a}_s >= x.index_pos AND f.{a}_e < x.index_pos + x.index_size
JOIN {y} y ON y.chr = f.chr_{b} AND f.{b}_s >= y.index_pos AND f.{b}_e < y.index_pos + y.index_size GROUP BY ALL"""


SYSTEMS = (("heatmap", "ax", "ay"), ("column", "vx", "ay"), ("row", "ax", "vy"))


def systems_sql(value, mirrored):
    parts = [_counts(*s) for s in SYSTEMS] + ([_counts(*s, turned=True) for s in SYSTEMS] if mirrored else [])
    return f"""WITH {CONTACTS}, {CONTIGS}, {axis_sql(7)}, {axis_sql(7, 'ay')}, {viewpoint_sql(*COLUMN, 'vx')}, {viewpoint_sql(*ROW, 'vy')}, f AS (SELECT * FROM c WHERE bucket <= 1 AND same_strand = 0),
u AS ({" UNION ALL ".join(parts)}), s AS (SELECT dataset, system, xi, yi, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL), p AS (SELECT *, {value} AS n FROM s),
t AS (SELECT count(*) FILTER (dataset <> 'rep2') AS ta, count(*) FILTER (dataset = 'rep2') AS tb FROM c),
q AS (SELECT system, xi, yi, coalesce(sum(n) FILTER (dataset <> 'rep2'), 0) AS va, coalesce(sum(n) FILTER (dataset = 'rep2'), 0) AS vb FROM p GROUP BY ALL)"""


@query("c9_three_systems", f"{systems_sql('a', False)} SELECT system, xi, yi, (va + vb)::DOUBLE AS v FROM q")
def _three(spark, sf_dir):
    return heatmap(spark, sf_dir).with_viewpoints(COLUMN, ROW)


@query("c9_three_systems_per_million", f"{systems_sql('a + b', True)} SELECT system, xi, yi, round(1e6 * va / (2 * ta) - 1e6 * vb / (2 * tb), 8) AS v FROM q, t")
def _per_million(spark, sf_dir):
    rows = heatmap(spark, sf_dir, symmetry="mirror", normalize="rpm", between_group="sub").with_viewpoints(COLUMN, ROW)
    return rows.withColumn("v", F.round("v", 8))


def places_sql(low, high, bins, base, total):
    """The stated mapping, bin after bin in order, as a fold over the contig's bins."""
    step = lambda end, s: f"CASE WHEN b.p <= v.{end} AND v.{end} <= b.p + b.z THEN least(v.{end} - b.p + b.sp, b.sp + b.sz) WHEN v.{end} > b.p + b.z THEN greatest({s}, b.sp + b.sz) WHEN v.{end} < b.p THEN least({s}, b.sp) ELSE {s} END"
    return f"""{viewpoint_sql(low, high, 'vp')}, v AS (SELECT chr, index_pos AS fr, index_pos + index_size AS til, index_pos, index_size, {base} AS base, {total} AS total FROM vp LEFT JOIN ex USING (chr)),
bn AS (SELECT row_number() OVER (PARTITION BY chr ORDER BY idx) AS k, chr, index_pos AS p, index_size AS z, screen_pos AS sp, {bins}),
w AS (SELECT chr, 0::BIGINT AS k, base::BIGINT AS s0, (base + total)::BIGINT AS s1 FROM v UNION ALL SELECT w.chr, w.k + 1, ({step("fr", "s0")})::BIGINT, ({step("til", "s1")})::BIGINT FROM w JOIN bn b ON b.chr = w.chr AND b.k = w.k + 1 JOIN v ON v.chr = w.chr)
SELECT v.chr, index_pos, index_size, s0 AS screen_pos, s1 - s0 AS screen_size FROM v JOIN (SELECT chr, arg_max(s0, k) AS s0, arg_max(s1, k) AS s1 FROM w GROUP BY ALL) USING (chr)"""


@query("c9_viewpoint_on_genome", f"WITH RECURSIVE {CONTIGS}, {axis_sql(7)}, ex AS (SELECT chr, ord * 102 AS base, len AS total FROM g), {places_sql(40, 330, 'index_size AS sz FROM ax', 'base', 'total')}")
def _on_genome(spark, sf_dir):
    return viewpoint_places(views.contigs(spark), 40, 330, genome_axis(views.contigs(spark), 7))


@query("c9_viewpoint_on_annotations", f"WITH RECURSIVE {CONTIGS}, {SWEEP}, {axis_of('gene', 'stretch', 'first')}, ex AS (SELECT t.chr, t.base, max(coord_e) AS total FROM t JOIN n ON n.chr = t.chr GROUP BY ALL), {places_sql(40, 330, 'screen_size AS sz FROM bins', 'base', 'total')}")
def _on_annotations(spark, sf_dir):
    return viewpoint_places(views.contigs(spark), 40, 330, annotation_bins(_sweep(spark, sf_dir, "gene"), views.contigs(spark), SIZE, "stretch", "first", WINDOW))
