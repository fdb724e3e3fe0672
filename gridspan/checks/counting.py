"""Queries of filters, box tests, orientations and combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.operators import combine, count, ingest
from gridspan.plans import axis
from gridspan.sources import views

from .base import CONTACTS, CONTIGS, RAW, TRACK, axis_sql, counts_sql, query
from .ingesting import CATEGORIES

SIZE = 10
AXES = f"{CONTIGS}, {axis_sql(SIZE)}, {axis_sql(SIZE, 'ay')}"


def _axis(spark, size=SIZE):
    return axis.genome_axis(views.contigs(spark), size)


def _counted(spark, sf_dir, where=None, mode="enclosed"):
    rows = views.contacts(spark, sf_dir)
    a = _axis(spark)
    return count.bin_counts(rows if where is None else rows.filter(where), a, a, mode)


for _mode in count.MODES:
    query(f"f5_{_mode}", f"WITH {CONTACTS}, {AXES} {counts_sql(_mode)}")(lambda spark, sf_dir, m=_mode: _counted(spark, sf_dir, mode=m))

query("a1_bin_counts", f"WITH {CONTACTS}, {AXES} {counts_sql()}")(_counted)
for _name, _args, _where in (
    ("f1_map_quality", (1, 2, True), "bucket BETWEEN 2 AND 2"),
    ("f2_incomplete", (0, 2, True), "bucket BETWEEN 0 AND 2"),
    ("f2_complete_only", (0, 254, False), "bucket BETWEEN 1 AND 254"),
):
    query(_name, f"WITH {CONTACTS}, {AXES} {counts_sql(where=_where)}")(lambda spark, sf_dir, a=_args: _counted(spark, sf_dir, count.map_quality(*a)))
for _which, _where in (("same", "same_strand = 0"), ("oppo", "same_strand = 1"), ("forw", "same_strand = 0 AND y_strand = 0"), ("rev", "same_strand = 0 AND y_strand = 1")):
    query(f"f3_{_which}", f"WITH {CONTACTS}, {AXES} {counts_sql(where=_where)}")(lambda spark, sf_dir, w=_which: _counted(spark, sf_dir, count.directionality(w)))


@query("f4_annotation_filters", f"WITH {CATEGORIES}, {AXES} {counts_sql(where='gx = 0 AND ey = 1', source='k')}")
def _annotated(spark, sf_dir):
    kinds = ("gene", "exon")
    rows = views.annotation_contacts(spark, sf_dir, kinds).filter(count.categories(kinds, present=((), ("exon",)), absent=(("gene",), ())))
    return count.bin_counts(rows, _axis(spark), _axis(spark))


def _placed(spark, sf_dir):
    bins = _axis(spark).bins()
    side = lambda s: bins.select(F.col("idx").alias(f"{s}i"), F.col("chr").alias(f"chr_{s}"), F.col("index_pos").alias(f"{s}_pos"), F.col("index_size").alias(f"{s}_size"))
    return _counted(spark, sf_dir).join(side("x"), "xi").join(side("y"), "yi")


@query("f6_near_diagonal", f"WITH {CONTACTS}, {AXES}, n AS ({counts_sql()}) SELECT dataset, xi, yi, CASE WHEN x.chr = y.chr AND abs(x.index_pos - y.index_pos) < 20 THEN 0 ELSE n END AS n FROM n JOIN ax x ON xi = x.idx JOIN ay y ON yi = y.idx")
def _diagonal(spark, sf_dir):
    return _placed(spark, sf_dir).select("dataset", "xi", "yi", F.when(count.near_diagonal(20), 0).otherwise(F.col("n")).cast("long").alias("n"))


@query("f7_least_interactions", f"WITH {CONTACTS}, {AXES}, n AS ({counts_sql()}) SELECT dataset, xi, yi, greatest(n - 5, 0) AS n FROM n")
def _least(spark, sf_dir):
    return _counted(spark, sf_dir).withColumn("n", F.greatest(F.col("n") - 5, F.lit(0)))


@query("f8_window", f"WITH {CONTACTS}, {AXES}, w AS (SELECT * FROM ax WHERE ord = 1 AND index_pos < 50), n AS ({counts_sql(x='w', y='w')}) SELECT dataset, xi - 10 AS xi, yi - 10 AS yi, n FROM n")
def _window(spark, sf_dir):
    a = axis.genome_axis(views.contigs(spark), SIZE, window=(102, 152))
    return count.bin_counts(views.contacts(spark, sf_dir), a, a)


@query("f10_active_datasets", f"WITH {CONTACTS}, {AXES} {counts_sql(where='''dataset IN ('rep0', 'rep2')''')}")
def _active(spark, sf_dir):
    return _counted(spark, sf_dir, F.col("dataset").isin("rep0", "rep2"))


@query("f9_active_contigs", f"WITH {CONTACTS}, {AXES}, w AS (SELECT idx - 22 AS idx, * EXCLUDE (idx) FROM ax WHERE chr = 'chr3'), n AS ({counts_sql(x='w', y='w')}) SELECT dataset, xi - 8 AS xi, yi - 8 AS yi, n FROM n")
def _contigs(spark, sf_dir):
    a = axis.genome_axis(views.contigs(spark).filter("chr = 'chr3'"), SIZE)
    return count.bin_counts(views.contacts(spark, sf_dir), a, a)


PAIR = f"""{CONTACTS}, {AXES}, n AS ({counts_sql()}), k AS (SELECT dataset, xi, yi FROM n UNION SELECT dataset, yi, xi FROM n),
m AS (SELECT k.*, coalesce(s.n, 0) AS a, coalesce(f.n, 0) AS b FROM k LEFT JOIN n s ON (k.dataset, k.xi, k.yi) = (s.dataset, s.xi, s.yi) LEFT JOIN n f ON (k.dataset, k.xi, k.yi) = (f.dataset, f.yi, f.xi))"""
FOLDS = {"all": "a", "sym": "least(a, b)", "asym": "greatest(a - b, 0)", "mirror": "a + b"}


def _pairs(spark, sf_dir):
    a = _axis(spark)
    return count.both_orientations(views.contacts(spark, sf_dir), a, a)


for _s, _e in FOLDS.items():
    query(f"j5_symmetry_{_s}", f"WITH {PAIR} SELECT dataset, xi, yi, ({_e})::BIGINT AS n FROM m")(
        lambda spark, sf_dir, s=_s: _pairs(spark, sf_dir).select("dataset", "xi", "yi", count.fold(F.col("a"), F.col("b"), s).cast("long").alias("n"))
    )

WIDE = "SELECT xi, yi, sum(CASE WHEN dataset = 'rep0' THEN n ELSE 0 END)::DOUBLE AS d0, sum(CASE WHEN dataset = 'rep1' THEN n ELSE 0 END)::DOUBLE AS d1, sum(CASE WHEN dataset = 'rep2' THEN n ELSE 0 END)::DOUBLE AS d2 FROM n GROUP BY ALL"
GROUPED = f"{CONTACTS}, {AXES}, n AS ({counts_sql()}), w AS ({WIDE})"
IN_GROUP = {"sum": "d0 + d1 + d2", "min": "least(d0, d1, d2)", "max": "greatest(d0, d1, d2)", "mean": "list_sort([d0, d1, d2])[2]", "dif": "2 * (abs(d0 - d1) + abs(d0 - d2) + abs(d1 - d2))"}
for _h, _e in IN_GROUP.items():
    query(f"a3_in_group_{_h}", f"WITH {GROUPED} SELECT xi, yi, {_e} AS va FROM w")(
        lambda spark, sf_dir, h=_h: combine.group_values(_counted(spark, sf_dir), F.col("n"), views.DATASETS, [], h).select("xi", "yi", "va")
    )
BETWEEN = {
    "1st": "a", "2nd": "b", "sub": "a - b", "min": "least(a, b)", "max": "greatest(a, b)", "dif": "abs(a - b)", "sum": "a + b",
    "div": "CASE WHEN b > 0 THEN a / b ELSE 0 END", "div+": "(a + 1e-6) / (b + 1e-6)",
}
AB = f"{GROUPED}, v AS (SELECT xi, yi, d0 + d1 AS a, d2 AS b FROM w)"


def _groups(spark, sf_dir):
    return combine.group_values(_counted(spark, sf_dir), F.col("n"), views.GROUP_A, views.GROUP_B, "sum")


for _h, _e in BETWEEN.items():
    query(f"n9_between_{_h.replace('+', 'plus')}", f"WITH {AB} SELECT xi, yi, round({_e}, 9) AS v FROM v")(
        lambda spark, sf_dir, h=_h: _groups(spark, sf_dir).select("xi", "yi", F.round(combine.between(F.col("va"), F.col("vb"), h), 9).alias("v"))
    )


@query("a4_folded_totals", f"WITH {CONTACTS}, tt AS (SELECT dataset, count(*)::DOUBLE AS t FROM c GROUP BY ALL) SELECT 2 * sum(t) FILTER (dataset <> 'rep2') AS va, 2 * sum(t) FILTER (dataset = 'rep2') AS vb FROM tt")
def _folded(spark, sf_dir):
    totals = ingest.totals(views.contacts(spark, sf_dir)).withColumn("k", F.lit(1))
    v = count.fold(F.col("total"), F.col("total"), "mirror")
    return combine.group_values(totals, v, views.GROUP_A, views.GROUP_B, "sum", ("k",)).select("va", "vb")


for _name, _unit in (("rpm", 1e6), ("rpk", 1e3)):
    query(f"n2_{_name}", f"WITH {AB}, s AS (SELECT (count(*) FILTER (dataset <> 'rep2'))::DOUBLE AS ta FROM c) SELECT xi, yi, round({_unit} * a / ta, 6) AS v FROM v, s")(
        lambda spark, sf_dir, u=_unit: _groups(spark, sf_dir)
        .crossJoin(F.broadcast(views.contacts(spark, sf_dir).filter("dataset <> 'rep2'").agg(F.count(F.lit(1)).cast("double").alias("ta"))))
        .select("xi", "yi", F.round(combine.per(F.col("va"), F.col("ta"), u), 6).alias("v"))
    )

SCALES = {"max": "v / hi", "abs": "v / greatest(abs(hi), abs(lo))", "minmax": "(v + lo) / (hi - lo)", "dont": "v"}
for _h, _e in SCALES.items():
    query(f"n10_scale_{_h}", f"WITH {AB}, q AS (SELECT xi, yi, a - b AS v FROM v), e AS (SELECT min(v) AS lo, greatest(max(v), 2.2250738585072014e-308) AS hi FROM q) SELECT xi, yi, round({_e}, 9) AS v FROM q, e")(
        lambda spark, sf_dir, h=_h: combine.scaled(_groups(spark, sf_dir).withColumn("v", F.col("va") - F.col("vb")), h).select("xi", "yi", F.round("scaled", 9).alias("v"))
    )


@query("a12_value_range", f"WITH {AB} SELECT min(a - b) AS low, greatest(max(a - b), 2.2250738585072014e-308) AS high FROM v")
def _range(spark, sf_dir):
    return combine.value_range(_groups(spark, sf_dir).withColumn("v", F.col("va") - F.col("vb")))


LOG = "ln(power(2, 10) * (least(1.0, s) * (1 - power(2, -10)) + power(2, -10))) / ln(power(2, 10))"


@query(
    "n12_color_index",
    f"WITH {AB}, q AS (SELECT xi, yi, a / max(a) OVER () AS s0 FROM v), s AS (SELECT xi, yi, greatest(0, least(1, s0)) AS s FROM q) SELECT xi, yi, least(255, floor(round({LOG}, 9) * 255))::INT AS color FROM s",
)
def _colors(spark, sf_dir):
    rows = combine.scaled(_groups(spark, sf_dir).withColumn("v", F.col("va")), "max")
    return rows.select("xi", "yi", combine.color_index(F.col("scaled"), 0.0, 1.0, 10.0).alias("color"))


@query("n13_low_to_high", "SELECT p_size, '#' || lower(lpad(to_hex(floor(p_size / 50.0 * 255)::BIGINT), 2, '0')) || '00' || lower(lpad(to_hex(floor(255 * (1 - p_size / 50.0))::BIGINT), 2, '0')) AS color FROM (SELECT DISTINCT p_size FROM part)")
def _mixed(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size").distinct()
    return sizes.select("p_size", combine.mixed_color(F.col("p_size") / F.lit(50.0), "#0000ff", "#ff0000").alias("color"))


EXPORT = f"""WITH {AB}, q AS (SELECT xi, yi, a + b AS v FROM v), e AS (SELECT max(v) AS hi FROM q)
SELECT x.chr AS chr_x, x.index_pos * 10000 AS start_x, (x.index_pos + x.index_size) * 10000 AS end_x, y.chr AS chr_y, y.index_pos * 10000 AS start_y, (y.index_pos + y.index_size) * 10000 AS end_y, round(v / hi, 9) AS score
FROM q JOIN ax x ON xi = x.idx JOIN ay y ON yi = y.idx, e"""


@query("k1_heatmap_export", EXPORT)
def _export(spark, sf_dir):
    from gridspan.plans.heatmap import Heatmap

    return Heatmap(views.contacts(spark, sf_dir), views.contigs(spark), views.DIVIDEND, views.GROUP_A, views.GROUP_B, bin_size=(SIZE, SIZE)).export().withColumn("score", F.round("score", 9))


@query("j4_dense_grid", f"WITH {AXES}, {CONTACTS}, n AS ({counts_sql()}) SELECT x.idx AS xi, y.idx AS yi, coalesce(n, 0)::BIGINT AS n FROM ax x CROSS JOIN ay y LEFT JOIN n ON xi = x.idx AND yi = y.idx AND dataset = 'rep0'")
def _dense(spark, sf_dir):
    bins = _axis(spark).bins()
    counts = _counted(spark, sf_dir, F.col("dataset") == "rep0")
    return count.dense_grid(bins, bins).join(counts, ["xi", "yi"], "left").select("xi", "yi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


REGIONS = "(VALUES ('chr0', 0, 15), ('chr0', 10, 15), ('chr1', 7, 33), ('chr3', 50, 1))"


@query("j2_irregular_bins", f"WITH {CONTACTS}, v AS (SELECT (row_number() OVER (ORDER BY chr, index_pos) - 1)::INT AS idx, * FROM {REGIONS} q(chr, index_pos, index_size)) {counts_sql(x='v', y='v')}")
def _irregular(spark, sf_dir):
    rows = spark.createDataFrame([("chr0", 0, 15), ("chr0", 10, 15), ("chr1", 7, 33), ("chr3", 50, 1)], "chr string, index_pos long, index_size long")
    bins = axis.region_axis(rows)
    return count.region_counts(views.contacts(spark, sf_dir), bins, bins)


@query("f13_track_direction", f"WITH {CONTIGS}, {axis_sql(SIZE)}, {TRACK} SELECT dataset, idx, sum(cnt)::BIGINT AS n FROM t JOIN ax ON t.chr = ax.chr AND x_s >= index_pos AND x_s < index_pos + index_size WHERE strand = 0 AND bucket BETWEEN 2 AND 254 GROUP BY ALL")
def _track(spark, sf_dir):
    rows = views.track_reads(spark, sf_dir).filter(count.track_directionality("forw") & count.map_quality(1))
    return count.track_counts(rows, _axis(spark))


def _windows(spark, size):
    """Windows of one size in base pairs, each overlapping half of the next."""
    contigs = views.contigs(spark).selectExpr("chr", f"len * {views.DIVIDEND} AS bp")
    return axis.region_axis(contigs.selectExpr("chr", f"explode(sequence(0L, bp - {size}, {size // 2}L)) AS index_pos", f"{size}L AS index_size"))


def _windows_sql(size):
    return f"""WITH {RAW}, {CONTIGS}, w AS (SELECT *, row_number() OVER (ORDER BY chr, l) - 1 AS idx FROM (SELECT chr, unnest(range(0, len * 10000 - {size} + 1, {size // 2})) AS l FROM g))
SELECT dataset, x.idx AS xi, y.idx AS yi, sum(cnt)::BIGINT AS n FROM r JOIN w x ON x.chr = chr_x AND pos1_s >= x.l AND pos1_e < x.l + {size} JOIN w y ON y.chr = chr_y AND pos2_s >= y.l AND pos2_e < y.l + {size} GROUP BY ALL"""


def _in_windows(size):
    def run(spark, sf_dir):
        w = _windows(spark, size)
        return count.region_counts(ingest.encode_contacts(views.raw_contacts(spark, sf_dir), 1), w, w)

    return run


for _size in (500, 500_000):  # one join, windows a thousand times apart
    query(f"j2_windows_of_{_size}", _windows_sql(_size))(_in_windows(_size))
