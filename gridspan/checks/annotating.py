"""Queries of annotations as axes: all rules, and whole heatmaps on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.operators import ingest
from gridspan.plans.annotation_table import annotation_table
from gridspan.plans.annotation_axis import BIN_RULES, MULTI_RULES
from gridspan.plans.annotation_window import annotation_bins
from gridspan.plans.axis import genome_axis
from gridspan.plans.heatmap import Heatmap
from gridspan.sources import views

from .base import CONTACTS, CONTIGS, axis_sql, query
from .ingesting import SWEEP

WINDOW, SIZE = (7, 331), 6


def _sweep(spark, sf_dir, kind):
    return ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND).filter(F.col("type") == kind)


def axis_of(kind, across, several, window=WINDOW, size=SIZE, name="bins", before=""):
    """SQL of an annotation axis, bin after bin. force_separate shows the sub-intervals of a bin
    one at a time, up to the bin's bound even where the window ends before."""
    squeeze, force, k = across == "squeeze", several == "force_separate", before
    begin, end = ("interval_id", "interval_id + 1") if squeeze else ("coord_s", "coord_e")
    pick = f"(SELECT arg_max(p, {{'e': CASE WHEN r = 0 THEN 0 ELSE r & -r END, 'f': -r}}) FROM {k}rw p WHERE p.chr = f.chr AND r >= f.row_from AND r < l.row_from + l.n)"
    pos = f"f.i_s + (here - f.base) - f.{begin}"
    length = {"combine": f"l.i_e - ({pos})", "first": f"f.i_e - ({pos})", "force_separate": f"f.i_e - ({pos})"}.get(several)
    if several == "max_fac_pow_two":
        pos = f"CASE WHEN f.interval_id = l.interval_id THEN f.i_s{' + (here - f.base) - f.coord_s' if across == 'separate' else ''} ELSE greatest(0, {pick}.i_s{f' + (here - f.base) - {pick}.coord_s' if across == 'separate' else ''}) END"
        length = f"CASE WHEN f.interval_id = l.interval_id THEN f.i_e ELSE {pick}.i_e END - ({pos})"
    shown = length if force else "l.coord_e - f.coord_s"
    if across == "separate":
        length, shown = f"least({size} + (l.i_s - f.i_e) - (l.coord_s - f.coord_e), {length})", f"least({size}, {shown})"
    elif squeeze:
        shown = "1" if force else "l.row_from + l.n - f.row_from"
    # of force_separate the last of a bin is also its first
    last = "f.interval_id" if force else f"(SELECT max(z.interval_id) FROM {k}iv z WHERE z.chr = f.chr AND z.base + z.{begin} < here + {size})"
    first = f"(SELECT min({{'o': z.ord, 'i': z.interval_id}}) FROM {k}iv z WHERE z.base + {end.replace(begin, 'z.' + begin) if squeeze else 'z.' + end} > here)"
    return f"""{k}n AS (SELECT chr, interval_id, i_s, i_e, coord_s, coord_e, count(*) AS n FROM sw WHERE type = '{kind}' GROUP BY ALL),
{k}t AS (SELECT chr, ord, coalesce(sum(t) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM (SELECT chr, ord, max({end}) AS t FROM {k}n JOIN g USING (chr) GROUP BY ALL)),
{k}iv AS (SELECT {k}n.*, ord, base, coalesce(sum(n) OVER (PARTITION BY {k}n.chr ORDER BY interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row_from FROM {k}n JOIN {k}t USING (chr)),
{k}rw AS (SELECT *, unnest(range(row_from::BIGINT, (row_from + n)::BIGINT)) AS r FROM {k}iv),
{k}wk AS (SELECT {window[0]}::BIGINT AS here, 0::BIGINT AS bound, NULL::BIGINT AS screen_pos, NULL::VARCHAR AS chr, NULL::BIGINT AS index_pos, NULL::BIGINT AS index_size, NULL::BIGINT AS screen_size
  UNION ALL SELECT here + shown, bound, here, chr, pos, length, shown FROM (
    SELECT here, bound, f.chr, ({pos})::BIGINT AS pos, ({length})::BIGINT AS length, ({shown})::BIGINT AS shown
    FROM (SELECT here, CASE WHEN here >= bound OR here IN (SELECT base FROM {k}t) THEN here + {size} ELSE bound END AS bound, {first} AS fi FROM {k}wk WHERE here < {window[1]}{' OR here < bound' if force else ''}) c JOIN {k}iv f ON f.ord = fi.o AND f.interval_id = fi.i JOIN {k}iv l ON l.chr = f.chr AND l.interval_id = {last})),
{name} AS (SELECT row_number() OVER (ORDER BY screen_pos) - 1 AS idx, chr, index_pos, index_size, screen_pos, screen_size FROM {k}wk WHERE screen_pos IS NOT NULL)"""


for _across in BIN_RULES:
    for _several in MULTI_RULES:
        query(f"c6_bins_{_across}_{_several}", f"WITH RECURSIVE {CONTIGS}, {SWEEP}, {axis_of('gene', _across, _several)} SELECT * FROM bins")(
            lambda spark, sf_dir, a=_across, s=_several: annotation_bins(_sweep(spark, sf_dir, "gene"), views.contigs(spark), SIZE, a, s, WINDOW).bins().drop("ord")
        )

INSIDE = {"enclosed": "c.{s}_s >= {s}.p AND c.{s}_e < {s}.p + {s}.z", "overlaps": "c.{s}_e >= {s}.p AND c.{s}_s < {s}.p + {s}.z", "encloses": "c.{s}_s <= {s}.p AND c.{s}_e >= {s}.p + {s}.z - 1 AND {s}.z > 0", "last": "c.{s}_e >= {s}.p AND c.{s}_e < {s}.p + {s}.z"}


def heatmap_of(x, y, mode):
    """(xi, yi, v): contacts of the first group between two axes, x and y being bins in SQL."""
    box = " AND ".join(INSIDE[mode].format(s=s) for s in "xy")
    return f"""SELECT xi, yi, count(*)::DOUBLE AS v FROM c JOIN (SELECT idx AS xi, chr, index_pos AS p, index_size AS z FROM {x}) x ON x.chr = chr_x JOIN (SELECT idx AS yi, chr, index_pos AS p, index_size AS z FROM {y}) y ON y.chr = chr_y
WHERE dataset <> 'rep2' AND {box} GROUP BY ALL"""


def _heatmap(spark, sf_dir, mode, annotated, window, sizes, **rules):
    h = Heatmap(views.contacts(spark, sf_dir), views.contigs(spark), views.DIVIDEND, views.GROUP_A, bin_size=sizes, window=window, annotated=annotated, mode=mode, between_group="1st", scale="dont", **rules)
    return h.values().select("xi", "yi", "v")


for _mode, _rules in (("enclosed", ("stretch", "combine")), ("overlaps", ("separate", "first")), ("last", ("separate", "max_fac_pow_two"))):
    query(f"c6_heatmap_{_mode}", f"WITH RECURSIVE {CONTACTS}, {CONTIGS}, {SWEEP}, {axis_of('gene', *_rules, name='bx', before='x')}, {axis_sql(10, 'ay')} {heatmap_of('bx', 'ay', _mode)}")(
        lambda spark, sf_dir, m=_mode, r=_rules: _heatmap(spark, sf_dir, m, (_sweep(spark, sf_dir, "gene"), None), (*WINDOW, 0, 408), (SIZE, 10), across=r[0], several=r[1])
    )


@query("c6_heatmap_encloses", f"WITH RECURSIVE {CONTACTS}, {CONTIGS}, {SWEEP}, {axis_of('gene', 'squeeze', 'force_separate', name='bx', before='x')} {heatmap_of('bx', 'bx', 'encloses')}")
def _enclosing(spark, sf_dir):
    genes = _sweep(spark, sf_dir, "gene")
    return _heatmap(spark, sf_dir, "encloses", (genes, genes), (*WINDOW, *WINDOW), (SIZE, SIZE), across="squeeze", several="force_separate")


@query("c6_heatmap_of_two_annotations", f"WITH RECURSIVE {CONTACTS}, {CONTIGS}, {SWEEP}, {axis_of('gene', 'stretch', 'combine', name='bx', before='x')}, {axis_of('exon', 'stretch', 'combine', (0, 200), 9, 'bz', 'y')} {heatmap_of('bx', 'bz', 'enclosed')}")
def _two(spark, sf_dir):
    return _heatmap(spark, sf_dir, "enclosed", (_sweep(spark, sf_dir, "gene"), _sweep(spark, sf_dir, "exon")), (*WINDOW, 0, 200), (SIZE, 9))


SHOWN_BP = "CASE WHEN {n} = 0 THEN '0 bp' WHEN {n} % 1000000 = 0 THEN format('{{:,}}', {n} // 1000000) || ' Mbp' WHEN {n} % 1000 = 0 THEN format('{{:,}}', {n} // 1000) || ' kbp' ELSE format('{{:,}}', {n}) || ' bp' END"


def _described(spark, sf_dir):
    """Annotations whose info has the lines of a GFF record."""
    return views.annotations(spark, sf_dir).withColumn("info", F.concat(F.lit("ID=a"), F.col("desc_id"), F.lit("\nnote="), F.col("info"), F.when(F.col("forw"), F.concat(F.lit("\ndescription=on "), F.col("chr"))).otherwise("")))


@query(
    "k7_annotations_by_bin",
    f"""WITH {CONTIGS}, {SWEEP}, {axis_sql(10)} SELECT type, ax.chr, {SHOWN_BP.format(n="(index_pos * 10000)")} AS index_start, {SHOWN_BP.format(n="((index_pos + index_size) * 10000)")} AS index_end, screen_pos::DOUBLE AS screen_start, (screen_pos + index_size)::DOUBLE AS screen_end,
count(*) AS num_anno, NULL::INT AS row, 0.0::DOUBLE AS "offset", 0.9025::DOUBLE AS height, NULL::VARCHAR AS strand, NULL::VARCHAR AS id, NULL::VARCHAR AS "desc", NULL::VARCHAR AS info
FROM sw JOIN ax ON sw.chr = ax.chr AND i_s < index_pos + index_size AND i_e > index_pos GROUP BY type, ax.chr, index_pos, index_size, screen_pos""",
)
def _by_bin(spark, sf_dir):
    return annotation_table(ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND), _described(spark, sf_dir), genome_axis(views.contigs(spark), 10), ["gene", "exon"], views.DIVIDEND, most=100)


def _table_sql(axis, start, end, kinds):
    """The detailed table over rg (region, chr, p, z, sp, sz), rows being packed one after the other."""
    return f"""WITH RECURSIVE {CONTIGS}, {SWEEP}, {axis},
m AS (SELECT sw.type, sw.desc_id, rg.*, min(interval_id) AS first FROM sw JOIN rg ON sw.chr = rg.chr AND i_s < p + z AND i_e > p WHERE sw.type IN ({kinds}) GROUP BY ALL),
o AS (SELECT m.*, start_bp, end_bp, forw, info, {start} AS s0, {end} AS e0 FROM m JOIN an ON an.type = m.type AND an.desc_id = m.desc_id),
q AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY region, first, start_bp, end_bp, desc_id) AS nth FROM o WHERE e0 >= s0),
pk AS (SELECT type, 0::BIGINT AS nth, []::DOUBLE[] AS ends, NULL::BIGINT AS row FROM q GROUP BY type
  UNION ALL SELECT type, nth, CASE WHEN row = len(ends) THEN list_append(ends, e0) ELSE list_concat(list_append(ends[:row], e0), ends[row + 2:]) END, row FROM (
    SELECT q.type, q.nth, ends, e0, coalesce(list_position(list_transform(ends, lambda e: s0 >= e + 2), true) - 1, len(ends)) AS row FROM pk JOIN q ON q.type = pk.type AND q.nth = pk.nth + 1)),
dp AS (SELECT max(row) + 1 AS deep FROM pk), tp AS (SELECT type, max(row) + 1 AS n FROM pk GROUP BY ALL)
SELECT q.type, q.chr, {SHOWN_BP.format(n="start_bp")} AS index_start, {SHOWN_BP.format(n="end_bp")} AS index_end, s0 AS screen_start, e0 AS screen_end, 1::BIGINT AS num_anno, row::INT AS row,
round(CASE WHEN row % 2 = 0 THEN 1 ELSE -1 END * (0.95 / deep) * ((row + 1) // 2) + CASE WHEN n % 2 = 0 THEN 0.95 / deep / 2 ELSE 0 END, 9) AS "offset", round(0.95 / deep * 0.95, 9) AS height,
CASE WHEN forw THEN '+' ELSE '-' END AS strand, 'a' || desc_id AS id, CASE WHEN forw THEN 'on ' || q.chr END AS "desc", 'note=' || info AS info FROM q JOIN pk USING (type, nth) JOIN tp USING (type), dp"""


def _rounded(rows):
    return rows.withColumns({c: F.round(c, 9) for c in ("offset", "height")})


MOVED = "greatest(0, {c} / 10000.0 - p)::DOUBLE + sp"


@query("k7_annotations_in_detail", _table_sql("rg AS (SELECT ord::BIGINT AS region, chr, CASE ord WHEN 1 THEN 58 ELSE 0 END AS p, CASE ord WHEN 1 THEN 44 ELSE 16 END AS z, 102 * ord + CASE ord WHEN 1 THEN 58 ELSE 0 END AS sp, CASE ord WHEN 1 THEN 44 ELSE 16 END AS sz FROM g WHERE ord IN (1, 2))", MOVED.format(c="start_bp"), f"least({MOVED.format(c='end_bp')}, sp + sz)::DOUBLE", "'gene', 'exon'"))
def _in_detail(spark, sf_dir):
    axis = genome_axis(views.contigs(spark), 4, window=(160, 220))
    return _rounded(annotation_table(ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND), _described(spark, sf_dir), axis, ["gene", "exon"], views.DIVIDEND, most=None))


@query("k7_annotations_on_themselves", _table_sql(f"{axis_of('gene', 'squeeze', 'combine', (0, 60))}, rg AS (SELECT idx AS region, chr, index_pos AS p, index_size AS z, screen_pos AS sp, screen_size AS sz FROM bins)", "sp::DOUBLE", "(sp + sz)::DOUBLE", "'gene'"))
def _on_themselves(spark, sf_dir):
    genes = _sweep(spark, sf_dir, "gene")
    return _rounded(annotation_table(genes, _described(spark, sf_dir), annotation_bins(genes, views.contigs(spark), SIZE, "squeeze", "combine", (0, 60)), ["gene"], views.DIVIDEND, most=None, squeeze=True))
