"""Whole heatmaps on a window of mostly empty bins whose last bins of a contig are larger.

The SQL fills all bins of the window, as the definitions of the normalisations do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.operators import combine, count, decay, ingest, normalize
from gridspan.plans.heatmap import Associated, Balancing, Decay, Heatmap
from gridspan.sources import views

from .base import CONTACTS, CONTIGS, axis_sql, counts_sql, query
from .ingesting import CATEGORIES, SWEEP

SIZE = 7
FEW = "bucket <= 1 AND same_strand = 0"
DATASET_COUNTS = f"{CONTACTS}, {CONTIGS}, {axis_sql(SIZE)}, {axis_sql(SIZE, 'ay')}, n AS ({counts_sql(where=FEW)})"
ALL_BINS = """d AS (
  SELECT x.idx AS xi, y.idx AS yi, x.chr AS chr_x, y.chr AS chr_y, x.index_pos AS x_pos, y.index_pos AS y_pos, x.index_size AS x_size, y.index_size AS y_size,
         coalesce(sum(n) FILTER (dataset <> 'rep2'), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (dataset = 'rep2'), 0)::DOUBLE AS b
  FROM ax x CROSS JOIN ay y LEFT JOIN n ON xi = x.idx AND yi = y.idx GROUP BY ALL)"""
BINS = f"{DATASET_COUNTS}, {ALL_BINS}"
SCORES = {
    "minmax": "(v + lo) / (hi - lo)",
    "abs": "v / greatest(abs(hi), abs(lo))",
    "max": "v / hi",
}


def heatmap(spark, sf_dir, **settings) -> Heatmap:
    few = F.expr(FEW)
    given = {"bin_size": (SIZE, SIZE), "filters": [few], "scale": "dont"} | settings
    return Heatmap(views.contacts(spark, sf_dir), views.contigs(spark), views.DIVIDEND, views.GROUP_A, views.GROUP_B, **given)


def scores(h: Heatmap, column: str = "v"):
    return h.values().select("xi", "yi", F.round(column, 8).alias("v"))


for _how, _e in SCORES.items():
    for _between, _v in (("sum", "a + b"), ("sub", "a - b"), ("div+", "(a + 1e-6) / (b + 1e-6)")):
        _range = "e AS (SELECT min(v) AS lo, greatest(max(v), 2.2250738585072014e-308) AS hi FROM q)"
        _name = f"n10_whole_{_how}_{_between.replace('+', 'plus')}"
        query(_name, f"WITH {BINS}, q AS (SELECT xi, yi, {_v} AS v FROM d), {_range} SELECT xi, yi, round({_e}, 8) AS v FROM q, e")(
            lambda spark, sf_dir, h=_how, b=_between: scores(heatmap(spark, sf_dir, between_group=b, scale=h, dense=True), "scaled")
        )
        query(f"{_name}_filled", f"WITH {BINS}, q AS (SELECT xi, yi, a, b, {_v} AS v FROM d), {_range} SELECT xi, yi, round({_e}, 8) AS v FROM q, e WHERE a > 0 OR b > 0")(
            lambda spark, sf_dir, h=_how, b=_between: scores(heatmap(spark, sf_dir, between_group=b, scale=h), "scaled")
        )


@query("f15_last_bins", f"WITH {BINS} SELECT xi, yi, CASE WHEN chr_x = chr_y AND abs(x_pos // {SIZE} - y_pos // {SIZE}) < 2 THEN 0 ELSE a END AS v FROM d")
def _diagonals(spark, sf_dir):
    h = heatmap(spark, sf_dir, dense=True, between_group="1st")
    return normalize.ignore_diagonals(h.values(), 2, (SIZE, SIZE)).select("xi", "yi", "v")


PVALUE = """CASE WHEN i = 0 OR v = 0 THEN 1 WHEN i = 1 THEN CASE WHEN v <= c THEN 1 ELSE 0 END
  ELSE least(1, list_sum(list_transform(range(v::BIGINT, c + 1), lambda k: exp(lgamma(c + 1) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END - CASE WHEN k = c THEN 0 ELSE lgamma(c - k + 1) END - k * ln(i) + (c - k) * ln(1 - 1.0 / i))))) END"""


def _radicl_sql(key: str, other: str) -> str:
    return f"""WITH {BINS}, u AS (SELECT xi, yi, 'a' AS g, a AS v FROM d UNION ALL SELECT xi, yi, 'b', b FROM d),
sl AS (SELECT g, {key}, sum(v)::BIGINT AS c, count(*) FILTER (v > 0) AS i FROM u GROUP BY ALL),
pv AS (SELECT g, xi, yi, {PVALUE} AS p FROM u JOIN sl USING (g, {key})),
rk AS (SELECT *, row_number() OVER (PARTITION BY g, {key} ORDER BY p, {other}) AS rnk, count(*) OVER (PARTITION BY g, {key}) AS m FROM pv),
fd AS (SELECT g, xi, yi, min(p * m / rnk) OVER (PARTITION BY g, {key} ORDER BY rnk DESC ROWS UNBOUNDED PRECEDING) < 0.3 AS yes FROM rk)
SELECT xi, yi, sum(yes::INT * CASE g WHEN 'a' THEN 1 ELSE 2 END)::DOUBLE AS v FROM fd GROUP BY ALL"""


for _column, _key, _other in ((True, "xi", "yi"), (False, "yi", "xi")):

    @query(f"n3_heatmap_by_{'column' if _column else 'row'}", _radicl_sql(_key, _other))
    def _radicl(spark, sf_dir, column=_column):
        h = heatmap(spark, sf_dir, normalize="radicl-seq", by_column=column, p_accept=0.3)
        x, y = h.axes()
        grid = count.dense_grid(x.bins(), y.bins()).select("xi", "yi").join(h.normalized(), ["xi", "yi"], "left")
        return grid.select("xi", "yi", (F.coalesce("va", F.lit(0.0)) + 2 * F.coalesce("vb", F.lit(0.0))).alias("v"))


ROUNDS = 3


def _balance_sql(least: int, mad: float) -> str:
    """Three rounds of iterative correction of group A, with masks, as plain SQL."""
    out = f"""WITH {BINS}, gd AS (SELECT xi, yi, a, CASE WHEN chr_x = chr_y AND abs(x_pos // {SIZE} - y_pos // {SIZE}) < 2 THEN 0 ELSE a END AS v FROM d)"""
    for axis in ("xi", "yi"):
        out += f""", m_{axis} AS (SELECT {axis}, 2 * sum(v) AS m, count(*) FILTER (v > 0) AS nz, count(*) AS c FROM gd GROUP BY ALL),
l_{axis} AS (SELECT *, m / (SELECT median(m) FROM m_{axis} WHERE m > 0) AS rel FROM m_{axis}),
k_{axis} AS (SELECT median(ln(rel)) AS med FROM l_{axis} WHERE rel > 0),
j_{axis} AS (SELECT median(abs(ln(rel) - med)) AS mad, any_value(med) AS med FROM l_{axis}, k_{axis} WHERE rel > 0),
b_{axis}0 AS (SELECT {axis}, CASE WHEN nz < {least} OR nz = 0 OR rel < exp(med - {mad} * mad) THEN 0.0 ELSE 1.0 END::DOUBLE AS w FROM l_{axis}, j_{axis})"""
    for r in range(1, ROUNDS + 1):
        product = f"gd.v * x.w * y.w FROM gd JOIN b_xi{r - 1} x USING (xi) JOIN b_yi{r - 1} y USING (yi)"
        out += f", p{r} AS (SELECT xi, yi, {product.replace(' FROM', ' AS p FROM', 1)})"
        for axis in ("xi", "yi"):
            out += f""", s_{axis}{r} AS (SELECT {axis}, 2 * sum(p) AS m FROM p{r} GROUP BY ALL), a_{axis}{r} AS (SELECT avg(m) FILTER (m <> 0) AS mean FROM s_{axis}{r}),
b_{axis}{r} AS (SELECT {axis}, w / CASE WHEN m = 0 THEN 1 ELSE m / mean END AS w FROM b_{axis}{r - 1} JOIN s_{axis}{r} USING ({axis}), a_{axis}{r})"""
    return out + f" SELECT xi, yi, round(a * x.w / sqrt(ax.mean) * y.w / sqrt(ay.mean), 7) AS v FROM gd JOIN b_xi{ROUNDS} x USING (xi) JOIN b_yi{ROUNDS} y USING (yi), a_xi{ROUNDS} ax, a_yi{ROUNDS} ay WHERE a > 0"


for _name, _how, _mad in (("n4_heatmap_ice", "ice", 2.0), ("n5_heatmap_cool_ice", "cool-ice", 5.0)):

    @query(_name, _balance_sql(4, _mad))
    def _ice(spark, sf_dir, how=_how, mad=_mad):
        h = heatmap(spark, sf_dir, normalize=how, between_group="1st", balancing=Balancing(4, 0.0, mad, 2, ROUNDS))
        return h.normalized().filter(F.expr("va is not null")).join(h.grouped().filter("va > 0").select("xi", "yi"), ["xi", "yi"]).select("xi", "yi", F.round("va", 7).alias("v"))


BAND = "least(x_pos + x_size - y_pos, x_pos - y_pos - y_size)"
DECAY_SQL = f"""{BINS}, t AS (SELECT *, {BAND} AS lo, greatest(greatest(x_pos + x_size - y_pos, x_pos - y_pos - y_size), {BAND} + 1) AS hi FROM d),
u AS (SELECT DISTINCT chr_x, chr_y, lo, hi, CASE WHEN lo + hi >= 0 THEN (lo + hi) // 2 ELSE -((-lo - hi) // 2) END AS c FROM t WHERE a > 0 OR b > 0),
f AS (SELECT *, abs(c) AS bot, 204 - abs(c) AS top, greatest(1, hi - lo) AS h FROM u WHERE c BETWEEN -102 AND 102),
z AS (SELECT *, greatest(1, (top - h - bot) // 12) AS step FROM f), q AS (SELECT *, unnest(range(bot, top, step)) AS spot FROM z),
k AS (SELECT *, (spot + c) // 2 AS x0, greatest((spot + c) // 2 + 1, (spot + h + c) // 2) AS x1, (spot - c) // 2 AS y0, greatest((spot - c) // 2 + 1, (spot + h - c) // 2) AS y1 FROM q),
r2 AS (SELECT unnest(['rep0', 'rep1', 'rep2']) AS dataset), kept AS (SELECT * FROM c WHERE {FEW}),
s1 AS (SELECT r2.dataset, k.chr_x, k.chr_y, lo, hi, top, bot, h, spot, count(kept.cnt) AS n FROM k CROSS JOIN r2 LEFT JOIN kept ON kept.dataset = r2.dataset AND kept.chr_x = k.chr_x AND kept.chr_y = k.chr_y AND x_s >= x0 AND x_e < x1 AND y_s >= y0 AND y_e < y1 GROUP BY ALL),
s2 AS (SELECT r2.dataset, k.chr_x, k.chr_y, lo, hi, top, bot, h, spot, count(kept.cnt) AS n FROM k CROSS JOIN r2 LEFT JOIN kept ON kept.dataset = r2.dataset AND kept.chr_y = k.chr_x AND kept.chr_x = k.chr_y AND y_s >= x0 AND y_e < x1 AND x_s >= y0 AND x_e < y1 GROUP BY ALL)"""
_TRIM = "list_sum(v[floor(m * 0.125)::INT + 1 : ceil(m * 0.875)::INT])::DOUBLE / CASE WHEN floor(m * 0.75 + 1e-9) > 0 THEN floor(m * 0.75 + 1e-9) ELSE ceil(m * 0.875) - floor(m * 0.125) END"
DECAYS = f"""{DECAY_SQL}, o AS (SELECT 0 AS side, * FROM s1 UNION ALL SELECT 1, * FROM s2),
gr AS (SELECT side, dataset, chr_x, chr_y, lo, hi, any_value(top) AS top, any_value(bot) AS bot, any_value(h) AS h, list_sort(list(n)) AS v, count(*) AS m FROM o GROUP BY side, dataset, chr_x, chr_y, lo, hi),
tm AS (SELECT side, dataset, chr_x, chr_y, lo, hi, CASE WHEN top - bot < 2 * h THEN 0 ELSE {_TRIM} END AS y FROM gr),
md AS (SELECT dataset, chr_x, chr_y, lo, hi, sum(y) AS y FROM tm GROUP BY ALL),
dd AS (SELECT chr_x, chr_y, lo, hi, sum(y) FILTER (dataset <> 'rep2') AS da, sum(y) FILTER (dataset = 'rep2') AS db FROM md GROUP BY ALL)"""
FEW_BOXES = Decay(3, 12, 75.0)


@query("k8_decay_by_group", f"WITH {DECAYS} SELECT chr_x, chr_y, lo * 10000 AS from_bp, hi * 10000 AS to_bp, round(1e18 * da / ((hi - lo) * 10000.0) ** 2, 3) AS a, round(1e18 * db / ((hi - lo) * 10000.0) ** 2, 3) AS b FROM dd")
def _decays(spark, sf_dir):
    h = heatmap(spark, sf_dir, ddd=FEW_BOXES, symmetry="mirror")
    straight = Heatmap(h.contacts, h.contigs, h.dividend, h.group_a, h.group_b, bin_size=h.bin_size, filters=h.filters)
    bands = decay.bands(straight.placed(straight.grouped().filter("va > 0 or vb > 0")))
    found = decay.group_decay(bands, h.contigs, h.filtered(), h.filtered(mirrored=True), h.group_a, h.group_b, "sum", "mirror", 0, 3, 12, 75.0)
    return decay.exported(found, h.dividend).select("chr_x", "chr_y", "from_bp", "to_bp", F.round(F.col("a") * 1e12, 3).alias("a"), F.round(F.col("b") * 1e12, 3).alias("b"))


@query(
    "n7_heatmap_decay",
    f"""WITH {DECAYS.replace("SELECT 1, * FROM s2", "SELECT 1, * FROM s2 WHERE false")}
SELECT xi, yi, round(CASE WHEN da > 0 THEN a / da ELSE 0 END - CASE WHEN db > 0 THEN b / db ELSE 0 END, 8) AS v FROM t LEFT JOIN dd USING (chr_x, chr_y, lo, hi) WHERE a > 0 OR b > 0""",
)
def _undecayed(spark, sf_dir):
    return scores(heatmap(spark, sf_dir, ddd=FEW_BOXES, between_group="sub"))


COPIES = [("chr0-a", "chr0", 0, 102, 0), ("chr0-b", "chr0", 1, 102, 1), ("chr1-a", "chr1", 2, 102, 0), ("chr2", "chr2", 3, 102, 2)]
COPIES_SQL = "g(chr, actual, ord, len, grp) AS (VALUES ('chr0-a', 'chr0', 0, 102, 0), ('chr0-b', 'chr0', 1, 102, 1), ('chr1-a', 'chr1', 2, 102, 0), ('chr2', 'chr2', 3, 102, 2))"
PAIRS_SQL = """pr AS (SELECT x.chr AS cx, y.chr AS cy, x.actual AS ax, y.actual AS ay, x.grp = y.grp AS same, max(x.grp = y.grp) OVER (PARTITION BY x.actual, y.actual) AS shared FROM g x CROSS JOIN g y),
vl AS (SELECT *, CASE WHEN ax = ay AND cx <> cy AND {intra} THEN false WHEN same AND {inter} THEN true WHEN NOT shared AND {distinct} THEN true ELSE NOT {others} END AS valid FROM pr),
sp AS (SELECT cx, cy, CASE WHEN valid THEN sum(valid::INT) OVER (PARTITION BY ax, ay) ELSE 0 END AS spots FROM vl)"""
SHOWN = f"""{CONTACTS}, {COPIES_SQL}, {axis_sql(SIZE)}, {axis_sql(SIZE, 'ay')}, sh AS (SELECT dataset, x.chr AS chr_x, y.chr AS chr_y, x_s, x_e, y_s, y_e, cnt FROM c JOIN g x ON x.actual = c.chr_x JOIN g y ON y.actual = c.chr_y WHERE {FEW}),
n AS ({counts_sql(source='sh')}), w AS (SELECT xi, yi, sum(n) FILTER (dataset <> 'rep2') AS a, sum(n) FILTER (dataset = 'rep2') AS b FROM n GROUP BY ALL)"""


def _flag_settings():
    names = ("keep_distinct_group", "keep_inter_group", "remove_others", "remove_intra")
    return [dict(zip(names, (n & 8 > 0, n & 4 > 0, n & 2 > 0, n & 1 > 0), strict=True)) for n in range(16)]


def _ruled(spark, sf_dir, rules):
    """All reads of every pair of displayed copies, over the spots that the rules leave."""
    copies = spark.createDataFrame(COPIES, "chr string, actual string, ord int, len long, ploidy_group int")
    h = Heatmap(views.contacts(spark, sf_dir), copies, views.DIVIDEND, [*views.GROUP_A, *views.GROUP_B], mode="first", bin_size=(102, 102), scale="dont", between_group="1st", ploidy_rules=rules)
    return h.values().join(combine.ploidy_divisors(copies, **rules), ["chr_x", "chr_y"]).select("chr_x", "chr_y", "spots", F.round("v", 6).alias("v"))


for _n, _rules in enumerate(_flag_settings()):
    _s = {k: str(v).lower() for k, v in _rules.items()}
    _pairs = PAIRS_SQL.format(intra=_s["remove_intra"], inter=_s["keep_inter_group"], distinct=_s["keep_distinct_group"], others=_s["remove_others"])
    query(f"a17_ploidy_rules_{_n}", f"WITH {CONTACTS}, {COPIES_SQL}, {_pairs}, k AS (SELECT x.chr AS cx, y.chr AS cy, count(*) AS n FROM c JOIN g x ON x.actual = chr_x JOIN g y ON y.actual = chr_y GROUP BY ALL) SELECT cx AS chr_x, cy AS chr_y, spots::BIGINT AS spots, round(CASE WHEN spots > 0 THEN n / spots ELSE 0 END, 6) AS v FROM sp JOIN k USING (cx, cy)")(
        lambda spark, sf_dir, r=_rules: _ruled(spark, sf_dir, r)
    )
    if _n in (0b1111, 0b0110):

        @query(f"n8_heatmap_ploidy_{_n}", f"WITH {SHOWN}, {_pairs} SELECT xi, yi, round(CASE WHEN spots > 0 THEN (coalesce(a, 0) + coalesce(b, 0)) / spots ELSE 0 END, 8) AS v FROM w JOIN ax x ON x.idx = xi JOIN ay y ON y.idx = yi JOIN sp ON cx = x.chr AND cy = y.chr")
        def _ploidy(spark, sf_dir, rules=_rules):
            copies = spark.createDataFrame(COPIES, "chr string, actual string, ord int, len long, ploidy_group int")
            h = Heatmap(views.contacts(spark, sf_dir), copies, views.DIVIDEND, views.GROUP_A, views.GROUP_B, bin_size=(SIZE, SIZE), filters=[F.expr(FEW)], scale="dont", ploidy_rules=rules)
            return scores(h)


MIRRORED = f"""{CATEGORIES}, {CONTIGS}, {axis_sql(SIZE)}, {axis_sql(SIZE, 'ay')}, n AS ({counts_sql(where='gx = 0 AND ey = 1', source='k')}),
kt AS (SELECT dataset, chr_y AS chr_x, chr_x AS chr_y, y_s AS x_s, y_e AS x_e, x_s AS y_s, x_e AS y_e, cnt FROM k WHERE gy = 0 AND ex = 1), m AS ({counts_sql(source='kt')}),
z AS (SELECT xi, yi, sum(n) AS n FROM (FROM n UNION ALL FROM m) GROUP BY ALL)"""


@query("f4_heatmap_mirror", f"WITH {MIRRORED} SELECT xi, yi, n::DOUBLE AS v FROM z")
def _mirror(spark, sf_dir):
    kinds = ("gene", "exon")
    h = Heatmap(
        views.annotation_contacts(spark, sf_dir, kinds), views.contigs(spark), views.DIVIDEND, views.DATASETS, bin_size=(SIZE, SIZE), scale="dont",
        symmetry="mirror", kinds=kinds, present=((), ("exon",)), absent=(("gene",), ()), between_group="1st",
    )
    return h.values().select("xi", "yi", "v")


TILES = [(0, 12), (12, 25), (25, 38), (38, 51), (51, 63), (63, 76), (76, 89), (89, 102)]
POWER = "CASE WHEN interval_id = 0 THEN 0 ELSE interval_id & -interval_id END"


def _associated_sql(x: str, y: str, intersection: bool) -> str:
    how = "min" if intersection else "max"
    axis = "xi" if x == "x" else "yi"
    return f"""WITH {SWEEP}, {CONTACTS.removeprefix(CONTACTS.split("r AS (")[0])}, {CONTIGS}, {axis_sql(SIZE)}, {axis_sql(SIZE, 'ay')}, n AS ({counts_sql(where=FEW)}), {ALL_BINS},
kept AS (SELECT * FROM c WHERE {FEW}), r2 AS (SELECT unnest(['rep0', 'rep1', 'rep2']) AS dataset),
o AS (SELECT *, row_number() OVER (PARTITION BY desc_id ORDER BY {POWER} DESC, interval_id) AS r FROM sw WHERE type = 'gene'), sa AS (SELECT desc_id AS id, chr, i_s AS low, i_e AS high FROM o WHERE r = 1),
c0 AS (SELECT id, dataset, count(*) AS v FROM kept JOIN sa ON chr_{x} = chr AND {x}_s >= low AND {x}_e < high WHERE {y}_e < 102 GROUP BY ALL),
tl(p, q) AS (VALUES {', '.join(map(str, TILES))}),
c1 AS (SELECT id, dataset, max(v) AS v FROM (SELECT id, dataset, chr_{x}, p, count(*) AS v FROM kept JOIN sa ON chr_{y} = chr AND {y}_s >= low AND {y}_e < high JOIN tl ON {x}_s >= p AND {x}_e < q GROUP BY ALL) GROUP BY ALL),
fu AS (SELECT sa.*, {how}(coalesce(c0.v, 0)) AS m0, {how}(coalesce(c1.v, 0)) AS m1 FROM sa CROSS JOIN r2 LEFT JOIN c0 ON c0.id = sa.id AND c0.dataset = r2.dataset LEFT JOIN c1 ON c1.id = sa.id AND c1.dataset = r2.dataset GROUP BY ALL),
bg AS (SELECT ax.idx, count(*) AS g FROM kept JOIN fu ON chr_{y} = fu.chr AND {y}_s >= low AND {y}_e < high AND m0 >= 1 AND m1 >= 1 JOIN ax ON ax.chr = chr_{x} AND {x}_s >= index_pos AND {x}_e < index_pos + index_size WHERE chr_x <> chr_y GROUP BY ALL)
SELECT xi, yi, round((a + b) / greatest(1, coalesce(g, 0)), 8) AS v FROM d LEFT JOIN bg ON bg.idx = d.{axis} WHERE a > 0 OR b > 0"""


for _name, _column, _both in (("column", True, False), ("row", False, True)):

    @query(f"n6_heatmap_by_{_name}", _associated_sql("x" if _column else "y", "y" if _column else "x", _both))
    def _associated(spark, sf_dir, column=_column, both=_both):
        sweep = ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND).filter("type = 'gene'")
        settings = Associated(sweep, None, (1, 1), 13, column, both, True)
        return scores(heatmap(spark, sf_dir, normalize="grid-seq", associated=settings))


@query("a21_heatmap_viewpoint", f"WITH {BINS}, q AS (SELECT yi AS idx, sum(1e6 * a / ta) / 35 AS v FROM d, (SELECT count(*)::DOUBLE AS ta FROM c WHERE dataset <> 'rep2') WHERE chr_x = 'chr1' AND x_pos < 35 GROUP BY ALL) SELECT idx, round(v, 8) AS v FROM q WHERE v > 0")
def _viewpoint(spark, sf_dir):
    return heatmap(spark, sf_dir, normalize="rpm", between_group="1st").viewpoint(102, 137).filter("v > 0").select("idx", F.round("v", 8).alias("v"))


INTERFACE = {"min_bin_size": 0, "max_num_bins": 1, "max_num_bins_factor": 64, "snap_bin_size": False, "fixed_number_of_bins": False, "fixed_bin_size": False, "squared_bins": True}


@query(
    "c1_heatmap_of_area",
    f"WITH {CONTACTS}, ax AS (SELECT k AS idx, 'chr1' AS chr, k * 6 AS index_pos, 6 AS index_size FROM (SELECT unnest(range(11)) AS k)), ay AS (FROM ax), n AS ({counts_sql(where=FEW)}) SELECT xi, yi, sum(n)::DOUBLE AS v FROM n WHERE dataset <> 'rep2' GROUP BY ALL",
)
def _area(spark, sf_dir):
    h = Heatmap.for_area(views.contacts(spark, sf_dir), views.contigs(spark), views.DIVIDEND, views.GROUP_A, (108, 156, 108, 156), INTERFACE, 25.0, filters=[F.expr(FEW)], scale="dont", between_group="1st")
    rows = h.placed(h.values().select("xi", "yi", "v")).filter("chr_x = 'chr1' and chr_y = 'chr1'")
    return rows.select(F.expr("x_pos div 6").alias("xi"), F.expr("y_pos div 6").alias("yi"), "v")  # the margin begins in chr0


_SHADE = "CASE WHEN s > 0.5 THEN 1 ELSE -1 END * ln(1024 * (least(1.0, abs(s - 0.5)) * (1 - 1 / 1024.0) + 1 / 1024.0)) / ln(1024) / 2 + 0.5"


@query("n12_heatmap_colors", f"WITH {BINS}, q AS (SELECT xi, yi, a, b, a - b AS v FROM d), e AS (SELECT max(v) AS hi, min(v) AS lo FROM q), s AS (SELECT xi, yi, a, b, (v / greatest(abs(hi), abs(lo)) + 1) / 2 AS s FROM q, e) SELECT xi, yi, least(255, floor(greatest(0, round({_SHADE}, 9) * 255)))::INT AS color FROM s WHERE a > 0 OR b > 0")
def _colors(spark, sf_dir):
    rows = heatmap(spark, sf_dir, between_group="sub", scale="abs").values()
    return rows.select("xi", "yi", combine.color_index(F.round("scaled", 12), -1.0, 1.0, 10.0, 256, True).alias("color"))


@query(
    "n14_palette",
    f"WITH {BINS}, e AS (SELECT max(a) AS hi FROM d), u AS (SELECT least(255, floor(greatest(0, round(ln(16 * (least(1.0, round(a / hi, 12)) * (15 / 16.0) + 1 / 16.0)) / ln(16) * 255, 9))))::INT AS color, count(*) AS bins FROM d, e GROUP BY ALL), p AS (SELECT k::BIGINT AS place, least(255, floor(greatest(0, round(ln(16 * (least(1.0, k / 255.0) * (15 / 16.0) + 1 / 16.0)) / ln(16), 12) * 255)))::INT AS color FROM (SELECT unnest(range(256)) AS k)) SELECT place, color, coalesce(bins, 0) AS bins FROM p LEFT JOIN u USING (color)",
)
def _palette(spark, sf_dir):
    """The legend, and how many bins of a heatmap have each of its colours."""
    rows = heatmap(spark, sf_dir, between_group="1st", scale="max", dense=True).values()
    used = rows.groupBy(combine.color_index(F.round("scaled", 12), 0.0, 1.0, 4.0).alias("color")).agg(F.count(F.lit(1)).alias("bins"))
    return combine.palette(256, 0.0, 1.0, 4.0, False, spark).join(used, "color", "left").select("place", "color", F.coalesce("bins", F.lit(0)).alias("bins"))


@query("n14_palette_ticks", f"WITH {BINS}, e AS (SELECT min(a - b) AS lo, max(a - b) AS hi FROM d), k AS (SELECT *, least(lo, -2) AS l, greatest(hi, 1) AS h FROM e) SELECT round((lo - l) / (h - l), 9) AS data_low, round((hi - l) / (h - l), 9) AS data_high, round((-2 - l) / (h - l), 9) AS range_low, round((1 - l) / (h - l), 9) AS range_high FROM k")
def _ticks(spark, sf_dir):
    rows = heatmap(spark, sf_dir, between_group="sub", dense=True).values()
    found = combine.palette_ticks(rows, -2.0, 1.0)
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(
    "k6_binomial_tracks",
    f"""WITH {BINS}, u AS (SELECT xi, 'A' AS g, a AS v FROM d UNION ALL SELECT xi, 'B', b FROM d), s AS (SELECT g, xi, sum(v)::DOUBLE AS c, count(*) FILTER (v > 0) AS f FROM u WHERE xi IN (SELECT xi FROM d WHERE a > 0 OR b > 0) GROUP BY ALL)
SELECT 'coverage ' || g AS track, xi AS idx, c AS value FROM s UNION ALL SELECT 'non-empty bins ' || g, xi, f::DOUBLE FROM s""",
)
def _slices(spark, sf_dir):
    return heatmap(spark, sf_dir, normalize="radicl-seq").slice_tracks()


@query(
    "k5_heatmap_table",
    f"""WITH {BINS}, q AS (SELECT *, a - b AS v FROM d), e AS (SELECT greatest(abs(max(v)), abs(min(v))) AS m FROM q), s AS (SELECT *, v / m AS sc, (v / m + 1) / 2 AS s FROM q, e)
SELECT chr_x, x_pos * 10000 AS start_x, (x_pos + x_size) * 10000 AS end_x, chr_y, y_pos * 10000 AS start_y, (y_pos + y_size) * 10000 AS end_y, round(sc, 9) AS score_total, round(s, 9) AS ranged, a AS score_a, b AS score_b,
       least(255, floor(greatest(0, round({_SHADE}, 9) * 255)))::INT AS color FROM s WHERE a > 0 OR b > 0""",
)
def _table(spark, sf_dir):
    rows = heatmap(spark, sf_dir, between_group="sub", scale="abs").table(-1.0, 1.0)
    return rows.withColumns({c: F.round(c, 9) for c in ("score_total", "ranged")})
