"""Queries of normalisations, decay, samples and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.operators import combine, count, decay, ingest, normalize, sampling
from gridspan.plans import axis
from gridspan.sources import views

from .base import CONTACTS, CONTIGS, CUSTOMER_CONTIGS, axis_sql, counts_sql, query
from .counting import AB
from .ingesting import SWEEP

WIDE_SIZE = 34
WIDE_AXES = f"{CONTIGS}, {axis_sql(WIDE_SIZE)}, {axis_sql(WIDE_SIZE, 'ay')}"
DENSE = f"{CONTACTS}, {WIDE_AXES}, n AS ({counts_sql()}), d AS (SELECT x.idx AS xi, y.idx AS yi, x.chr AS chr_x, y.chr AS chr_y, x.index_pos AS x_pos, y.index_pos AS y_pos, x.index_size AS x_size, y.index_size AS y_size, coalesce(n, 0)::DOUBLE AS v FROM ax x CROSS JOIN ay y LEFT JOIN n ON xi = x.idx AND yi = y.idx AND dataset = 'rep0')"


def _dense(spark, sf_dir, size=WIDE_SIZE):
    a = axis.genome_axis(views.contigs(spark), size)
    counts = count.bin_counts(views.contacts(spark, sf_dir).filter("dataset = 'rep0'"), a, a)
    return count.dense_grid(a.bins(), a.bins()).join(counts, ["xi", "yi"], "left").withColumn("v", F.coalesce(F.col("n"), F.lit(0)).cast("double")).drop("n", "dataset")


@query("n1_dont", f"WITH {DENSE} SELECT xi, yi, v FROM d")
def _dont(spark, sf_dir):
    return _dense(spark, sf_dir).select("xi", "yi", "v")


@query("a7_slice_coverage", f"WITH {DENSE} SELECT xi, sum(floor(v))::BIGINT AS coverage, count(*) FILTER (v > 0) AS filled FROM d GROUP BY ALL")
def _coverage(spark, sf_dir):
    return normalize.slice_coverage(_dense(spark, sf_dir))


@query("f15_ignore_diagonals", f"WITH {DENSE} SELECT xi, yi, CASE WHEN chr_x = chr_y AND abs(x_pos / x_size - y_pos / y_size) < 2 THEN 0 ELSE v END AS v FROM d")
def _ignored(spark, sf_dir):
    return normalize.ignore_diagonals(_dense(spark, sf_dir), 2).select("xi", "yi", "v")


@query("a8_margins", f"WITH {DENSE} SELECT xi, 2 * sum(v) AS margin FROM d GROUP BY ALL")
def _margins(spark, sf_dir):
    return normalize.margins(_dense(spark, sf_dir), "xi")


@query("a10_margin_moments", f"WITH {DENSE}, m AS (SELECT xi, 2 * sum(v) AS m FROM d GROUP BY ALL) SELECT round(avg(m) FILTER (m <> 0), 6) AS mean, round(var_pop(m) FILTER (m <> 0), 4) AS variance FROM m")
def _moments(spark, sf_dir):
    full = F.when(F.col("margin") != 0, F.col("margin"))
    return normalize.margins(_dense(spark, sf_dir), "xi").agg(F.round(F.avg(full), 6).alias("mean"), F.round(F.var_pop(full), 4).alias("variance"))


@query(
    "a9_slice_masks",
    f"""WITH {DENSE}, m AS (SELECT xi, 2 * sum(v) AS m, count(*) FILTER (v > 0) AS nz, count(*) AS b FROM d GROUP BY ALL), re AS (SELECT *, m / (SELECT median(m) FROM m WHERE m > 0) AS rel FROM m),
l AS (SELECT *, CASE WHEN rel > 0 THEN ln(rel) END AS lg FROM re), md AS (SELECT median(lg) AS med FROM l), ma AS (SELECT median(abs(lg - med)) AS mad FROM l, md)
SELECT xi, nz < 3 OR nz * 100.0 <= b * 10.0 OR coalesce(rel < exp(med - 1 * mad), true) AS masked FROM l, md, ma""",
)
def _masks(spark, sf_dir):
    return normalize.masked_slices(_dense(spark, sf_dir), "xi", min_nz=3, sparse=10.0, mad_max=1.0)


PVALUE = """CASE WHEN i = 0 THEN 1 WHEN i = 1 THEN CASE WHEN v <= c THEN 1 ELSE 0 END WHEN v = 0 THEN 1 ELSE least(1, list_sum(list_transform(range(v::BIGINT, c + 1), lambda k: exp(lgamma(c + 1) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END - CASE WHEN k = c THEN 0 ELSE lgamma(c - k + 1) END - k * ln(i) + (c - k) * ln(1 - 1.0 / i))))) END"""
BINOMIAL = f"{DENSE}, s AS (SELECT xi, sum(v)::BIGINT AS c, count(*) FILTER (v > 0) AS i FROM d GROUP BY ALL), p AS (SELECT xi, yi, {PVALUE} AS p FROM d JOIN s USING (xi))"


@query("n3_binomial_tail", f"WITH {BINOMIAL} SELECT xi, yi, round(p, 7) AS p_val FROM p")
def _tail(spark, sf_dir):
    return normalize.binomial(_dense(spark, sf_dir).select("xi", "yi", "v")).select("xi", "yi", F.round("p_val", 7).alias("p_val"))


@query(
    "w4_false_discovery",
    f"WITH {BINOMIAL}, q AS (SELECT *, row_number() OVER (PARTITION BY xi ORDER BY round(p, 9), yi) AS r, count(*) OVER (PARTITION BY xi) AS n FROM p) SELECT xi, yi, round(least(1, min(p * n / r) OVER (PARTITION BY xi ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adj FROM q",
)
def _fdr(spark, sf_dir):
    return normalize.binomial(_dense(spark, sf_dir).select("xi", "yi", "v")).select("xi", "yi", F.round("p_adj", 6).alias("p_adj"))


ROUND = """m{n} AS (SELECT xi, 2 * sum(v * wx * wy) AS m FROM d JOIN x{p} USING (xi) JOIN y{p} USING (yi) GROUP BY ALL), o{n} AS (SELECT yi, 2 * sum(v * wx * wy) AS m FROM d JOIN x{p} USING (xi) JOIN y{p} USING (yi) GROUP BY ALL),
x{n} AS (SELECT xi, wx / (CASE WHEN m = 0 THEN 1 ELSE m / (SELECT avg(m) FROM m{n} WHERE m <> 0) END) AS wx FROM x{p} JOIN m{n} USING (xi)), y{n} AS (SELECT yi, wy / (CASE WHEN m = 0 THEN 1 ELSE m / (SELECT avg(m) FROM o{n} WHERE m <> 0) END) AS wy FROM y{p} JOIN o{n} USING (yi))"""


@query(
    "a11_two_balance_rounds",
    f"WITH {DENSE}, x0 AS (SELECT DISTINCT xi, 1.0::DOUBLE AS wx FROM d), y0 AS (SELECT DISTINCT yi, 1.0::DOUBLE AS wy FROM d), {ROUND.format(n=1, p=0)}, {ROUND.format(n=2, p=1)} SELECT xi, round(wx, 9) AS bias FROM x2",
)
def _rounds(spark, sf_dir):
    grid = _dense(spark, sf_dir).select("xi", "yi", "v")
    bx, by = (grid.select(a).distinct().withColumn(b, F.lit(1.0)) for a, b in (("xi", "bx"), ("yi", "by")))
    for _ in range(2):
        bx, by = normalize.balance_step(grid, bx, by)
    return bx.select("xi", F.round("bx", 9).alias("bias"))


def _corrected(grid, bins, **settings):
    bias_x, bias_y, done = normalize.balance(grid, bins, **settings)
    rows = normalize.balanced(grid.select("xi", "yi", "v"), bias_x, bias_y)
    return rows.select("xi", "yi", F.col("v").alias("balanced"), F.lit(done).alias("converged"))


@query("n4_iterative_correction")
def _balanced(spark, sf_dir):
    return _corrected(_dense(spark, sf_dir), (12, 12), min_nz=2)


@query("n5_cool_balance")
def _cool(spark, sf_dir):
    """The same correction with a square matrix's usual masks: the two nearest diagonals are left out."""
    return _corrected(normalize.ignore_diagonals(_dense(spark, sf_dir), 2, (WIDE_SIZE, WIDE_SIZE)), (12, 12), min_nz=2, mad_max=5.0)


BANDS = "least(x_pos + x_size - y_pos, x_pos - y_pos - y_size)"
BAND_SQL = f"b AS (SELECT *, {BANDS} AS lo, greatest(greatest(x_pos + x_size - y_pos, x_pos - y_pos - y_size), {BANDS} + 1) AS hi FROM d)"


@query("a6_decay_bands", f"WITH {DENSE}, {BAND_SQL} SELECT DISTINCT chr_x, chr_y, lo, hi FROM b")
def _bands(spark, sf_dir):
    return decay.bands(_dense(spark, sf_dir)).select("chr_x", "chr_y", "lo", "hi").distinct()


SAMPLES = f"""{DENSE}, {BAND_SQL}, u AS (SELECT DISTINCT chr_x, chr_y, lo, hi, CASE WHEN lo + hi >= 0 THEN (lo + hi) // 2 ELSE -((-lo - hi) // 2) END AS c FROM b),
f AS (SELECT *, abs(c) AS bot, 204 - abs(c) AS top, greatest(1, hi - lo) AS h FROM u WHERE c BETWEEN -102 AND 102), z AS (SELECT *, greatest(1, (top - h - bot) // 20) AS step FROM f),
q AS (SELECT *, unnest(range(bot, top, step)) AS spot FROM z),
k AS (SELECT chr_x, chr_y, lo, hi, top, bot, h, spot, (spot + c) // 2 AS x0, greatest((spot + c) // 2 + 1, (spot + h + c) // 2) AS x1, (spot - c) // 2 AS y0, greatest((spot - c) // 2 + 1, (spot + h - c) // 2) AS y1 FROM q),
w AS (SELECT k.chr_x, k.chr_y, lo, hi, top, bot, h, spot, count(c.cnt) AS n FROM k LEFT JOIN c ON c.dataset = 'rep0' AND c.chr_x = k.chr_x AND c.chr_y = k.chr_y AND c.x_s >= x0 AND c.x_e < x1 AND c.y_s >= y0 AND c.y_e < y1 GROUP BY ALL)"""


@query("a5_decay_samples", f"WITH {SAMPLES} SELECT chr_x, chr_y, lo, hi, spot, n FROM w")
def _samples(spark, sf_dir):
    contacts = views.contacts(spark, sf_dir).filter("dataset = 'rep0'")
    bands = decay.sampled_bands(decay.bands(_dense(spark, sf_dir)), views.contigs(spark), 20)
    return decay.sample_counts(bands, contacts).select("chr_x", "chr_y", "lo", "hi", F.col("at").alias("spot"), "n")


@query(
    "a5_decay_trimmed_mean",
    f"""WITH {SAMPLES}, gr AS (SELECT chr_x, chr_y, lo, hi, any_value(top) AS top, any_value(bot) AS bot, any_value(h) AS h, list_sort(list(n)) AS v, count(*) AS m FROM w GROUP BY chr_x, chr_y, lo, hi)
SELECT chr_x, chr_y, lo, hi, CASE WHEN top - bot < (3 - 1) * h THEN 0 ELSE round(list_sum(v[floor(m * 0.125)::INT + 1 : ceil(m * 0.875)::INT])::DOUBLE / CASE WHEN floor(m * 0.75 + 1e-9) > 0 THEN floor(m * 0.75 + 1e-9) ELSE ceil(m * 0.875) - floor(m * 0.125) END, 9) END AS decay FROM gr""",
)
def _trimmed(spark, sf_dir):
    contacts = views.contacts(spark, sf_dir).filter("dataset = 'rep0'")
    d = decay.decay(decay.bands(_dense(spark, sf_dir)), views.contigs(spark), contacts, least=3, most=20, quantile=75.0)
    return d.select("chr_x", "chr_y", "lo", "hi", F.round("decay", 9).alias("decay"))


_Q = (1 - 80.0 / 100) / 2


@query(
    "n7_decay_removed",
    f"""WITH {SAMPLES}, gr AS (SELECT chr_x, chr_y, lo, hi, any_value(top) AS top, any_value(bot) AS bot, any_value(h) AS h, list_sort(list(n)) AS v, count(*) AS m FROM w GROUP BY chr_x, chr_y, lo, hi),
de AS (SELECT *, floor(m * (1 - 2 * {_Q!r}::DOUBLE) + 1e-9) AS nominal, list_sum(v[floor(m * {_Q!r}::DOUBLE)::INT + 1 : ceil(m * (1 - {_Q!r}::DOUBLE))::INT])::DOUBLE AS total, ceil(m * (1 - {_Q!r}::DOUBLE)) - floor(m * {_Q!r}::DOUBLE) AS kept FROM gr),
dd AS (SELECT chr_x, chr_y, lo, hi, CASE WHEN top - bot < 0 THEN 0 ELSE total / CASE WHEN nominal > 0 THEN nominal ELSE kept END END AS decay FROM de)
SELECT xi, yi, round(CASE WHEN decay > 0 THEN b.v / decay ELSE 0 END, 9) AS v FROM b LEFT JOIN dd ON dd.chr_x = b.chr_x AND dd.chr_y = b.chr_y AND dd.lo = b.lo AND dd.hi = b.hi""",
)
def _removed(spark, sf_dir):
    grid = decay.bands(_dense(spark, sf_dir))
    d = decay.decay(grid, views.contigs(spark), views.contacts(spark, sf_dir).filter("dataset = 'rep0'"), least=1, most=20, quantile=80.0)
    return normalize.per_decay(grid, d.select("chr_x", "chr_y", "lo", "hi", "decay"), ["chr_x", "chr_y", "lo", "hi"]).select("xi", "yi", F.round("v", 9).alias("v"))


COPIES = [("chr0-a", "chr0", 0, 0), ("chr0-b", "chr0", 1, 1), ("chr1-a", "chr1", 2, 0), ("chr2-a", "chr2", 3, 1)]
COPIES_SQL = "pl(chr, actual, ord, ploidy_group) AS (VALUES ('chr0-a', 'chr0', 0, 0), ('chr0-b', 'chr0', 1, 1), ('chr1-a', 'chr1', 2, 0), ('chr2-a', 'chr2', 3, 1))"


def _copies(spark):
    return spark.createDataFrame(COPIES, "chr string, actual string, ord int, ploidy_group int")


@query("a17_ploidy_spots", f"WITH {CONTACTS}, {COPIES_SQL}, s AS (SELECT x.actual AS actual_x, y.actual AS actual_y, sum(CASE WHEN x.ploidy_group = y.ploidy_group THEN 1 ELSE 0 END)::BIGINT AS spots FROM pl x CROSS JOIN pl y GROUP BY ALL) SELECT actual_x, actual_y, spots, count(*) AS reads FROM s JOIN c ON chr_x = actual_x AND chr_y = actual_y GROUP BY ALL")
def _spots(spark, sf_dir):
    c = _copies(spark)
    spots = combine.ploidy_spots(c, c, keep_distinct_group=False)
    reads = views.contacts(spark, sf_dir).groupBy(F.col("chr_x").alias("actual_x"), F.col("chr_y").alias("actual_y")).agg(F.count(F.lit(1)).alias("reads"))
    return spots.join(reads, ["actual_x", "actual_y"])


@query(
    "n8_ploidy_correction",
    f"WITH {CONTACTS}, {COPIES_SQL}, s AS (SELECT x.actual AS a, y.actual AS b, sum(CASE WHEN x.ploidy_group = y.ploidy_group THEN 1 ELSE 0 END) AS spots FROM pl x CROSS JOIN pl y GROUP BY ALL) SELECT chr_x, chr_y, round(CASE WHEN any_value(spots) > 0 THEN count(*) / any_value(spots) ELSE 0 END, 9) AS v FROM c JOIN s ON a = chr_x AND b = chr_y GROUP BY ALL",
)
def _ploidy(spark, sf_dir):
    c = _copies(spark)
    n = views.contacts(spark, sf_dir).groupBy("chr_x", "chr_y").agg(F.count(F.lit(1)).alias("n"))
    spots = combine.ploidy_spots(c, c, keep_distinct_group=False)
    joined = n.join(spots, (F.col("chr_x") == F.col("actual_x")) & (F.col("chr_y") == F.col("actual_y")))
    return joined.select("chr_x", "chr_y", F.round(F.when(F.col("spots") > 0, F.try_divide("n", "spots")).otherwise(0.0), 9).alias("v"))


@query("j7_ploidy_fan_out", f"WITH {CONTACTS}, {COPIES_SQL} SELECT x.chr AS chr_x, y.chr AS chr_y, count(*) AS n FROM c JOIN pl x ON x.actual = c.chr_x JOIN pl y ON y.actual = c.chr_y GROUP BY ALL")
def _fan_out(spark, sf_dir):
    c = _copies(spark)
    side = lambda s: c.select(F.col("actual").alias(f"chr_{s}"), F.col("chr").alias(f"shown_{s}"))
    rows = views.contacts(spark, sf_dir).join(side("x"), "chr_x").join(side("y"), "chr_y")
    return rows.groupBy(F.col("shown_x").alias("chr_x"), F.col("shown_y").alias("chr_y")).agg(F.count(F.lit(1)).alias("n"))


POWER = "CASE WHEN p_partkey = 0 THEN 0 ELSE p_partkey & -p_partkey END"


@query("o1_coarse_order", f"SELECT p_partkey AS x, row_number() OVER (ORDER BY {POWER} DESC, p_partkey) AS place FROM part")
def _order(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("x"))
    return sampling.numbered(rows, sampling.coarse_first())


@query("o2_representative", f"SELECT p_size, arg_max(p_partkey, {{'a': {POWER}, 'b': -p_partkey}}) AS x FROM part GROUP BY ALL")
def _best(spark, sf_dir):
    return sampling.representative(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", F.col("p_partkey").alias("x")), ["p_size"])


SAMPLE_ORDER = "CASE WHEN interval_id = 0 THEN 0 ELSE interval_id & -interval_id END DESC, interval_id"


@query(
    "o3_annotation_samples",
    f"WITH {SWEEP}, f AS (SELECT *, row_number() OVER (PARTITION BY type, chr, desc_id ORDER BY {SAMPLE_ORDER}) AS r FROM sw) SELECT type, chr, desc_id, interval_id AS x FROM f WHERE r = 1",
)
def _annotation_samples(spark, sf_dir):
    rows = ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND).select("type", "chr", "desc_id", F.col("interval_id").alias("x"))
    parts = [rows.filter((F.col("type") == t) & (F.col("chr") == c)) for t in ("gene", "exon") for c, *_ in views.CONTIGS]
    picked = [sampling.take(p, 1_000_000, "x", "desc_id") for p in parts]
    out = picked[0]
    for p in picked[1:]:
        out = out.union(p)
    return out


@query("o5_spaced_bins", f"WITH {CUSTOMER_CONTIGS}, s AS (SELECT greatest(10, sum(len) // 40)::BIGINT AS step FROM g) SELECT chr, ord, pos FROM (SELECT chr, ord, unnest(range(0, len - 10 + 1, step)) AS pos FROM g, s WHERE len >= 10) ORDER BY ord, pos LIMIT 40")
def _spaced(spark, sf_dir):
    return sampling.spaced_bins(views.customer_contigs(spark, sf_dir), 10, 40)


@query(
    "j9_samples_and_bins",
    f"WITH {CONTIGS}, {axis_sql(10)}, w AS (SELECT chr, index_pos AS pos, index_size AS size FROM ax WHERE chr IN ('chr1', 'chr2') AND index_pos < 50), s AS (SELECT DISTINCT 'chr' || (p_partkey % 4) AS chr, (p_partkey * 38971) % 950000 // 10000 AS pos, 3::BIGINT AS size FROM part) SELECT chr, pos, size, true AS is_sample FROM s WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.chr = s.chr AND s.pos < w.pos + w.size AND w.pos < s.pos + s.size) UNION ALL SELECT *, false FROM w",
)
def _apart(spark, sf_dir):
    bins = axis.genome_axis(views.contigs(spark), 10).bins().filter("chr in ('chr1', 'chr2') and index_pos < 50").select("chr", F.col("index_pos").alias("pos"), F.col("index_size").alias("size"))
    samples = views.annotations(spark, sf_dir).select("chr", F.expr("start_bp div 10000").alias("pos"), F.lit(3).cast("long").alias("size")).distinct()
    return sampling.without_overlap(samples, bins)


@query("j14_bias_lookup", f"WITH {AB}, b AS (SELECT idx, 1.0 / (1 + idx) AS bias FROM ax) SELECT xi, yi, round(a * bias, 9) AS v FROM v JOIN b ON xi = idx")
def _bias(spark, sf_dir):
    from .counting import _axis, _groups

    bias = _axis(spark).bins().select(F.col("idx").alias("xi"), (F.lit(1.0) / (F.lit(1) + F.col("idx"))).alias("bias"))
    return _groups(spark, sf_dir).join(bias, "xi").select("xi", "yi", F.round(F.col("va") * F.col("bias"), 9).alias("v"))


