"""Queries of tracks, viewpoints, annotations on axes, ranked slices and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.operators import count, diagnostics, ingest, tracks
from gridspan.plans import axis
from gridspan.plans.heatmap import Heatmap
from gridspan.sources import views

from .base import ANNOTATIONS, CONTACTS, CONTIGS, CUSTOMER_CONTIGS, TRACK, axis_sql, counts_sql, query
from .counting import AB, SIZE, _axis, _counted, _groups
from .ingesting import SWEEP

T_AX = f"{CONTIGS}, {axis_sql(SIZE)}, {TRACK}"
T_COUNT = "tc AS (SELECT dataset, idx, sum(cnt)::BIGINT AS n FROM t JOIN ax ON t.chr = ax.chr AND x_s >= index_pos AND x_s < index_pos + index_size GROUP BY ALL)"


@query("a2_track_counts", f"WITH {T_AX}, {T_COUNT} SELECT * FROM tc")
def _tracks(spark, sf_dir):
    return count.track_counts(views.track_reads(spark, sf_dir), _axis(spark))


@query("a13_track_range", f"WITH {T_AX}, {T_COUNT} SELECT dataset, min(n) AS low, max(n) AS high, min(n) FILTER (n <> 0) AS low_nz FROM tc GROUP BY ALL")
def _range(spark, sf_dir):
    return tracks.value_range(count.track_counts(views.track_reads(spark, sf_dir), _axis(spark)))


@query("a13_display_range", f"WITH {T_AX}, {T_COUNT}, d AS (SELECT ax.idx, coalesce(n, 0)::DOUBLE AS n FROM ax LEFT JOIN (SELECT * FROM tc WHERE dataset = 'click' AND idx < 25) q ON q.idx = ax.idx) SELECT min(n) AS low, max(n) AS high, min(n) FILTER (n <> 0) AS low_nz, max(n) FILTER (n <> 0) AS high_nz FROM d")
def _display(spark, sf_dir):
    counts = count.track_counts(views.track_reads(spark, sf_dir), _axis(spark)).filter("dataset = 'click' and idx < 25")
    return tracks.display_range(_axis(spark).bins().select("idx").join(counts, "idx", "left").fillna(0, ["n"]))


@query("k2_track_export", f"WITH {T_AX}, {T_COUNT}, w AS (SELECT idx, sum(n) FILTER (dataset = 'click') AS v1, sum(n) FILTER (dataset = 'view') AS v2 FROM tc GROUP BY ALL) SELECT chr, index_pos * 10000 AS start_at, (index_pos + index_size) * 10000 AS end_at, coalesce(v1, 0)::BIGINT AS v1, coalesce(v2, 0)::BIGINT AS v2 FROM ax LEFT JOIN w USING (idx)")
def _export(spark, sf_dir):
    counts = count.track_counts(views.track_reads(spark, sf_dir), _axis(spark))
    rows = tracks.wide(counts, _axis(spark).bins(), ["click", "view"], views.DIVIDEND)
    return rows.select("chr", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "v1", "v2")


@query("n11_coverage_scale", f"WITH {T_AX}, {T_COUNT}, s AS (SELECT dataset, count(*)::DOUBLE AS total FROM t GROUP BY ALL) SELECT dataset, idx, n::DOUBLE AS dont, round(1e6 * n / total, 6) AS rpm, round(1e3 * n / total, 6) AS rpk, round(1e6 * n / index_size, 6) AS rpmb, round(1e3 * n / index_size, 6) AS rpkb FROM tc JOIN s USING (dataset) JOIN ax USING (idx)")
def _coverage(spark, sf_dir):
    reads = views.track_reads(spark, sf_dir)
    rows = count.track_counts(reads, _axis(spark)).join(ingest.totals(reads), "dataset").join(_axis(spark).bins().select("idx", "index_size"), "idx")
    return rows.select("dataset", "idx", *[F.round(diagnostics.coverage_scaled(F.col("n"), how, F.col("total"), F.col("index_size")), 6).alias(how) for how in ("dont", "rpm", "rpk", "rpmb", "rpkb")])


@query("a21_viewpoint_sum", f"WITH {AB} SELECT yi AS idx, round(sum(a) / 30, 9) AS v FROM v JOIN ax ON xi = idx WHERE chr = 'chr0' AND index_pos < 30 GROUP BY ALL")
def _viewpoint(spark, sf_dir):
    bins = _axis(spark).bins().filter("chr = 'chr0' and index_pos < 30").select(F.col("idx").alias("xi"), F.col("index_size").alias("size"))
    return tracks.viewpoint(_groups(spark, sf_dir).withColumn("v", F.col("va")), bins).select("idx", F.round("v", 9).alias("v"))


@query("a14_annotation_hits", f"WITH {SWEEP}, {CONTIGS}, {axis_sql(SIZE)} SELECT type, idx, count(*) AS hits FROM sw JOIN ax ON sw.chr = ax.chr AND i_s < index_pos + index_size AND i_e > index_pos GROUP BY ALL")
def _hits(spark, sf_dir):
    return tracks.annotation_hits(ingest.line_sweep(views.annotations(spark, sf_dir), views.DIVIDEND), _axis(spark).bins())


@query("j10_overlapping_annotations", f"WITH {ANNOTATIONS} SELECT DISTINCT type, chr, desc_id, info FROM an WHERE chr IN ('chr1', 'chr2') AND start_bp < 500000 AND end_bp > 200000")
def _overlapping(spark, sf_dir):
    regions = spark.createDataFrame([("chr1", 200_000, 500_000), ("chr2", 200_000, 500_000)], "chr string, low long, high long")
    return tracks.overlapping(views.annotations(spark, sf_dir), regions).select("type", "chr", "desc_id", "info")


@query(
    "w6_packed_rows",
    f"""WITH RECURSIVE {ANNOTATIONS}, q AS (SELECT *, row_number() OVER (PARTITION BY type, chr ORDER BY start_bp, end_bp, desc_id) AS nth FROM an),
pk AS (SELECT type, chr, 0::BIGINT AS nth, NULL::BIGINT AS desc_id, []::BIGINT[] AS ends, NULL::BIGINT AS row FROM q GROUP BY type, chr
  UNION ALL SELECT type, chr, nth, desc_id, CASE WHEN row = len(ends) THEN list_append(ends, end_bp) ELSE list_concat(list_append(ends[:row], end_bp), ends[row + 2:]) END, row FROM (
    SELECT q.type, q.chr, q.nth, q.desc_id, q.end_bp, ends, coalesce(list_position(list_transform(ends, lambda e: e + 20000 <= q.start_bp), true) - 1, len(ends)) AS row FROM pk JOIN q ON q.type = pk.type AND q.chr = pk.chr AND q.nth = pk.nth + 1))
SELECT type, chr, desc_id, row::INT AS row FROM pk WHERE nth > 0""",
)
def _packed(spark, sf_dir):
    return tracks.packed_rows(views.annotations(spark, sf_dir), 20_000)


COVERAGE = f"{CONTACTS}, {CONTIGS}, {axis_sql(SIZE)}, {axis_sql(SIZE, 'ay')}, n AS ({counts_sql()})"
RANKS = f"{COVERAGE}, sx AS (SELECT xi AS idx, sum(n)::BIGINT AS coverage FROM n GROUP BY ALL)"


@query("a18_axis_coverage", f"WITH {RANKS} SELECT * FROM sx")
def _axis_coverage(spark, sf_dir):
    return tracks.axis_coverage(_counted(spark, sf_dir), "xi")


@query("w3_ranked_slices", f"WITH {RANKS} SELECT idx, coverage, row_number() OVER (ORDER BY coverage, idx) - 1 AS place FROM sx WHERE coverage > 0")
def _ranked(spark, sf_dir):
    return tracks.ranked(tracks.axis_coverage(_counted(spark, sf_dir), "xi"))


LEAVES = [(0, 6), (6, 12), (12, 18), (18, 25), (25, 31), (31, 38), (38, 44), (44, 51), (51, 57), (57, 63), (63, 69), (69, 76), (76, 82), (82, 89), (89, 95), (95, 102)]


@query("a19_max_tile_coverage", f"WITH {CONTACTS}, l(a, b) AS (VALUES {', '.join(map(str, LEAVES))}), q AS (SELECT chr_x, chr_y, x_s // 20 AS sample, a, sum(cnt) AS n FROM c JOIN l ON y_s >= a AND y_e < b WHERE dataset = 'rep0' AND x_s // 20 = x_e // 20 GROUP BY ALL) SELECT chr_x, sample, max(n)::BIGINT AS coverage FROM q GROUP BY ALL")
def _tiles(spark, sf_dir):
    return tracks.max_tile_coverage(views.contacts(spark, sf_dir).filter("dataset = 'rep0'"), views.contigs(spark), 20, 7)


ASSOC = f"{COVERAGE}, sx AS (SELECT dataset, xi, sum(n) AS s FROM n GROUP BY ALL), k AS (SELECT xi, min(s) AS lo, count(*) AS m FROM sx GROUP BY ALL HAVING min(s) >= 400)"


@query("a20_coverage_over_datasets", f"WITH {COVERAGE}, sx AS (SELECT dataset, xi, sum(n) AS s FROM n GROUP BY ALL) SELECT xi AS idx, min(s)::BIGINT AS lowest, max(s)::BIGINT AS highest FROM sx GROUP BY ALL")
def _over(spark, sf_dir):
    return tracks.over_datasets(_counted(spark, sf_dir), "xi", views.DATASETS)


EMPTY = "rep9"  # active, but without a read


@query("a20_with_an_empty_dataset", f"WITH {COVERAGE}, sx AS (SELECT dataset, xi, sum(n) AS s FROM n GROUP BY ALL), d AS (SELECT unnest(['rep0', 'rep1', 'rep2', '{EMPTY}']) AS dataset), k AS (SELECT xi, d.dataset FROM (SELECT DISTINCT xi FROM sx) CROSS JOIN d) SELECT xi AS idx, min(coalesce(s, 0))::BIGINT AS lowest, max(coalesce(s, 0))::BIGINT AS highest FROM k LEFT JOIN sx USING (xi, dataset) GROUP BY ALL")
def _over_empty(spark, sf_dir):
    return tracks.over_datasets(_counted(spark, sf_dir), "xi", [*views.DATASETS, EMPTY])


@query("j11_background_of_the_union", f"WITH {COVERAGE}, sx AS (SELECT dataset, xi, sum(n) AS s FROM n GROUP BY ALL), k AS (SELECT xi FROM sx GROUP BY ALL HAVING max(s) >= 460), x AS (SELECT idx, chr FROM ax) SELECT n.yi AS idx, sum(n.n)::BIGINT AS background FROM n JOIN k USING (xi) JOIN x xa ON xa.idx = n.xi JOIN x ya ON ya.idx = n.yi WHERE xa.chr <> ya.chr GROUP BY ALL")
def _background_of_union(spark, sf_dir):
    """With an empty dataset no slice is full in all, but some are in one."""
    return tracks.background(_counted(spark, sf_dir), _axis(spark).bins(), 460, [*views.DATASETS, EMPTY], intersection=False)


@query("j11_associated_background", f"WITH {ASSOC}, x AS (SELECT idx, chr FROM ax) SELECT n.yi AS idx, sum(n.n)::BIGINT AS background FROM n JOIN k USING (xi) JOIN x xa ON xa.idx = n.xi JOIN x ya ON ya.idx = n.yi WHERE xa.chr <> ya.chr GROUP BY ALL")
def _background(spark, sf_dir):
    return tracks.background(_counted(spark, sf_dir), _axis(spark).bins(), 400, views.DATASETS, ignore_cis=True)


@query("n6_associated_slices", f"WITH {ASSOC}, bg AS (SELECT n.yi, sum(n.n) AS b FROM n JOIN k USING (xi) JOIN ax xa ON xa.idx = n.xi JOIN ax ya ON ya.idx = n.yi WHERE xa.chr <> ya.chr GROUP BY ALL) SELECT dataset, xi, yi, round(n / greatest(1, coalesce(b, 0)), 9) AS v FROM n LEFT JOIN bg USING (yi)")
def _associated(spark, sf_dir):
    counts = _counted(spark, sf_dir)
    bg = tracks.background(counts, _axis(spark).bins(), 400, views.DATASETS, ignore_cis=True)
    return tracks.over_background(counts, bg).select("dataset", "xi", "yi", F.round("v", 9).alias("v"))


@query("f14_slice_filter", f"WITH {COVERAGE}, a AS (SELECT xi AS idx, sum(n) AS c0 FROM n GROUP BY ALL), b AS (SELECT yi AS idx, sum(n) AS c1 FROM n GROUP BY ALL) SELECT idx, c0::BIGINT AS c0, c1::BIGINT AS c1 FROM a JOIN b USING (idx) WHERE c0 >= 1000 AND c1 >= 900")
def _filter(spark, sf_dir):
    return tracks.full_slices(_counted(spark, sf_dir), 1000, 900)


@query("j12_shown_on_both", f"WITH {CUSTOMER_CONTIGS} SELECT chr, len FROM g WHERE len >= 25 AND ord % 2 = 0")
def _both(spark, sf_dir):
    c = views.customer_contigs(spark, sf_dir)
    return axis.shown_on_both(c.filter("len >= 25"), c.filter("ord % 2 = 0")).select("chr", "len")


@query("w9_polylines", f"WITH {T_AX}, {T_COUNT} SELECT dataset, chr, count(*) AS points, sum(n)::BIGINT AS total, list(n ORDER BY idx)[1] AS first_n FROM tc JOIN ax USING (idx) GROUP BY ALL")
def _lines(spark, sf_dir):
    lines = tracks.polylines(count.track_counts(views.track_reads(spark, sf_dir), _axis(spark)), _axis(spark).bins())
    return lines.select("dataset", "chr", F.size("points").cast("long").alias("points"), F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("total"), F.get("points", F.lit(0))["n"].alias("first_n"))


HALF = "a AS (SELECT dataset, xi, yi, n FROM n WHERE dataset = 'rep0'), b AS (SELECT dataset, xi, yi, n FROM n WHERE dataset = 'rep1')"


@query("a24_export_difference", f"WITH {COVERAGE}, {HALF} SELECT round(avg(abs(a.n - b.n)), 9) AS deviation, round(corr(a.n, b.n), 9) AS r FROM a JOIN b USING (xi, yi)")
def _difference(spark, sf_dir):
    rows = _counted(spark, sf_dir)
    return tracks.compared(rows.filter("dataset = 'rep0'"), rows.filter("dataset = 'rep1'"), ["xi", "yi"], "n")


@query("u5_export_keys", f"WITH {COVERAGE}, {HALF} SELECT (SELECT count(*) FROM a JOIN b USING (xi, yi)) AS shared, (SELECT count(*) FROM a ANTI JOIN b USING (xi, yi)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (xi, yi)) AS only_b")
def _keys(spark, sf_dir):
    rows = _counted(spark, sf_dir)
    return tracks.key_overlap(rows.filter("dataset = 'rep0'"), rows.filter("dataset = 'rep1'"), ["xi", "yi"])


@query("u1_active_datasets", f"WITH {CONTACTS} SELECT dataset, count(*) AS reads FROM c WHERE cnt > 0 GROUP BY ALL")
def _active(spark, sf_dir):
    """The datasets of both groups, each once, with their reads."""
    h = Heatmap(views.contacts(spark, sf_dir), views.contigs(spark), views.DIVIDEND, [*views.GROUP_A, "rep2"], views.GROUP_B)
    return ingest.totals(h.filtered()).withColumnRenamed("total", "reads")


@query("u4_window_tiles", f"WITH {COVERAGE} SELECT * FROM n WHERE xi < 20")
def _window_tiles(spark, sf_dir):
    rows = views.contacts(spark, sf_dir)
    part = lambda w: count.bin_counts(rows, axis.genome_axis(views.contigs(spark), SIZE, window=w), _axis(spark))
    return part((0, 102)).unionByName(part((102, 204)).withColumn("xi", F.col("xi") + 10))


@query("k8_decay_export", f"WITH {CONTACTS}, d AS (SELECT chr_x, chr_y, (x_s - y_s + 102) // 17 AS band, count(*) AS n FROM c GROUP BY ALL) SELECT chr_x, chr_y, band, round(1e6 * n / (17 * 10000.0 * 17 * 10000.0), 12) AS per_mbp2 FROM d")
def _decay(spark, sf_dir):
    d = views.contacts(spark, sf_dir).groupBy("chr_x", "chr_y", F.expr("(x_s - y_s + 102) div 17").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("chr_x", "chr_y", "band", F.round(1e6 * F.col("n") / (17 * views.DIVIDEND * 17.0 * views.DIVIDEND), 12).alias("per_mbp2"))
