"""The toy matrix, metamorphic properties, text files, sessions, places and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.operators import combine, count, decay, ingest, normalize, tracks
from gridspan.plans import axis
from gridspan.plans.heatmap import Heatmap
from gridspan.plans.locus import Places, number
from gridspan.session import Session
from gridspan.sources import export, text, views
from gridspan.streaming import contacts as stream

TOY = np.array([[7, 4, 12, 8], [21, 24, 54, 48], [35, 20, 60, 40], [14, 3, 12, 16]])


@pytest.fixture(scope="module")
def toy(spark):
    rows = [("m", x * 4 + y, "Chr1", "Chr1", x, x, y, y, 1, 0, 0, int(TOY[x, y])) for x in range(4) for y in range(4)]
    return spark.createDataFrame(rows, "dataset string, read_id long, chr_x string, chr_y string, x_s long, x_e long, y_s long, y_e long, bucket int, same_strand int, y_strand int, cnt long")


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([("Chr1", 0, 4)], "chr string, ord int, len long")


def matrix(rows, value="v"):
    out = np.zeros((4, 4))
    for r in rows.collect():
        out[r["xi"], r["yi"]] = r[value]
    return out


@pytest.mark.parametrize(("symmetry", "want"), [("all", TOY), ("mirror", TOY + TOY.T), ("sym", np.minimum(TOY, TOY.T)), ("asym", np.maximum(TOY - TOY.T, 0))])
def test_toy_symmetry(toy, one, symmetry, want):
    h = Heatmap(toy, one, 1, ["m"], symmetry=symmetry, scale="dont")
    assert (matrix(h.values()) == want).all()


def test_toy_normalisation(toy, one):
    total = 16  # reads, not counts
    h = Heatmap(toy, one, 1, ["m"], normalize="rpk", scale="dont")
    assert np.allclose(matrix(h.values()), 1000 * TOY / total)
    assert (matrix(Heatmap(toy, one, 1, ["m"], normalize="rpm", symmetry="asym", scale="dont").values()) == 0).all()


def test_toy_balance():
    ones = np.ones(4, bool)
    bx, by, done = normalize.balance_matrix(TOY.astype(float), ones, ones)
    balanced = TOY * bx[:, None] * by[None, :]
    assert done
    assert np.allclose(balanced.sum(0), 0.5, atol=2e-3) and np.allclose(balanced.sum(1), 0.5, atol=2e-3)
    none = np.zeros(4, bool)
    assert normalize.balance_matrix(TOY.astype(float), none, none)[2] is False


def test_coarse_bins_sum_fine_ones(spark, sf_dir):
    rows = views.contacts(spark, sf_dir).filter("x_s = x_e and y_s = y_e")
    fine, coarse = (axis.genome_axis(views.contigs(spark), b) for b in (1, 34))
    total = lambda a: count.bin_counts(rows, a, a).agg(F.sum("n")).first()[0]
    assert total(fine) == total(coarse) == rows.count()


def test_axis_rejects_unknown_rule(one):
    with pytest.raises(ValueError):
        axis.genome_axis(one, 2, "other")


@pytest.mark.parametrize(("how", "sizes"), [("smaller", [3, 1]), ("larger", [4]), ("skip", [3]), ("fit_chrom_larger", [3, 3])])
def test_small_axis(one, how, sizes):
    assert [r["index_size"] for r in axis.genome_axis(one, 3, how).bins().orderBy("idx").collect()] == sizes


def test_contig_smaller_than_a_bin(one):
    assert axis.genome_axis(one, 9).bins().count() == 0
    assert axis.genome_axis(one, 9, show_small=True).bins().count() == 1


def test_empty_tables(spark, toy, one):
    a = axis.genome_axis(one, 2)
    assert count.bin_counts(toy.limit(0), a, a).count() == 0
    assert Heatmap(toy.limit(0), one, 1, ["m"]).export().count() == 0
    assert ingest.line_sweep(spark.createDataFrame([], "type string, chr string, start_bp long, end_bp long, desc_id long, forw boolean"), 10).count() == 0


def test_binomial_tail():
    from math import comb

    for n, p in ((30, 0.2), (7, 0.5)):
        for x in range(n + 2):
            want = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x, n + 1))
            assert normalize._upper_tail(x, n, p) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_trimmed_mean(spark):
    values = F.array(*[F.lit(float(v)) for v in (9, 1, 5, 3, 100)])
    one = spark.range(1)
    assert one.select(normalize.trimmed_mean(values, 60.0)).first()[0] == pytest.approx((3 + 5 + 9) / 3)
    assert one.select(normalize.trimmed_mean(values, 0.0)).first()[0] == 5
    assert one.select(normalize.trimmed_mean(F.array(F.lit(4.0)), 80.0)).first()[0] == 4


def test_decay_of_a_diagonal(spark):
    contigs = spark.createDataFrame([("c", 0, 8)], "chr string, ord int, len long")
    rows = spark.createDataFrame([("d", "c", "c", k, k, k, k, 1) for k in range(8)], "dataset string, chr_x string, chr_y string, x_s long, x_e long, y_s long, y_e long, cnt long")
    grid = decay.bands(spark.createDataFrame([("c", "c", 0, 1, 0, 1)], "chr_x string, chr_y string, x_pos long, x_size long, y_pos long, y_size long"))
    assert decay.decay(grid, contigs, rows, most=None).first()["decay"] > 0


def test_in_group_of_few(spark):
    v = lambda *xs: [F.lit(x) for x in xs]
    row = spark.range(1).select(combine.in_group([], "max").alias("none"), combine.in_group(v(3), "dif").alias("one"), combine.in_group(v(3, 5), "mean").alias("upper")).first()
    assert tuple(row) == (0.0, 0.0, 5.0)


def test_islands_without_names(spark):
    rows = spark.createDataFrame([("f", n, name) for n, name in enumerate(["a", "a", ".", ".", None, "-", "b", "a"])], "file string, line long, name string")
    got = [r["island"] for r in ingest.read_islands(rows, "name", ["line"], ["file"]).orderBy("line").collect()]
    assert got == [1, 1, 2, 3, 4, 5, 6, 7]


PAIRS = """#columns: [readid] chr1 pos1 chr2 pos2 [strand1] [strand2] [mapq1] [mapq2]
r1\tchr1\t10\tchr2\t20\t+\t-\t5\t60

chr1\t30\tchr1\t40
r3\tchr9\t1\tchr1\t2\t-\t-\t*\t255
"""


def test_pairs_file(spark, tmp_path):
    (tmp_path / "a.pairs").write_text(PAIRS)
    rows = text.read_table(spark, str(tmp_path / "a.pairs")).orderBy("pos1").collect()
    assert [(r["readid"], r["chr1"], r["mapq2"]) for r in rows] == [("r3", "chr9", "255"), ("r1", "chr1", "60"), ("-", "chr1", "*")]
    with pytest.raises(Exception, match="too few"):
        text.parse_table(spark.createDataFrame([("chr1 1",)], "value string")).collect()
    for layout in ("chr1 pos1", "chr1 pos1 chr2 pos2 chr1", "chr1 pos1 chr2 [pos2]", "chr1 pos1 chr2 pos2 other"):
        with pytest.raises(ValueError):
            text.parse_table(spark.createDataFrame([("x",)], "value string"), layout=layout)


def test_stream_equals_batch(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.pairs").write_text("".join(f"r{n}{k} chr{k} {k * 100} chr1 {n * 50}\n" for k in range(4)))
        stream.follow(spark, str(folder), table, str(tmp_path / "state"), "rep", 10).awaitTermination()
    got = spark.read.parquet(table)
    want = stream.parsed(spark.read.text(str(folder)), "rep", 10)
    assert got.count() == 12
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_heatmap_file_round_trip(toy, one, spark, tmp_path):
    rows = Heatmap(toy, one, 100, ["m"]).export()
    export.write_heatmap(rows, str(tmp_path / "map"))
    back = export.read_heatmap(spark, str(tmp_path / "map"))
    assert back.count() == 16
    assert tracks.compared(rows, back, ["chr_x", "start_x", "chr_y", "start_y"], "score").first()["deviation"] == 0


def test_session():
    s = Session()
    s.set("replicates.in_group", "min")
    s.set("normalization.ddd", "yes")
    s.set("filters.mapping_q", "[3, 254]")
    assert s.get("normalization.ddd") is True and s.get("filters.mapping_q") == [3, 254]
    assert s.undo() and s.get("filters.mapping_q") == [0, 254]
    assert s.redo() and s.get("filters.mapping_q") == [3, 254]
    with pytest.raises(ValueError):
        s.set("replicates.in_group", "median")
    assert Session.from_json(s.to_json()).values == s.values
    for n in range(40):
        s.set("interface.max_num_bins", n + 100)
    assert len(s.before) == 25


def test_places():
    p = Places([("chr1", 1000), ("chr2", 500)])
    assert number("1.5 kbp") == 1500 and number("2da") == 20 and number("x") is None
    assert p.interval("*") == (0, 1500) and p.interval("CHR2") == (1000, 1500)
    assert p.interval("chr2:0.1k+-10") == (1090, 1110) and p.interval("[chr1:100 .. chr2:end]") == (100, 1500)
    assert p.area("x=chr1; y=chr2") == (0, 1000, 1000, 1500) and p.area("chr1") == (0, 1000, 0, 1000)
    assert p.readable(1100) == "chr2:100"
    with pytest.raises(ValueError):
        p.interval("chr9:5")


def test_names():
    assert axis.longest_common_suffix(["chr1_x", "chr2_x"]) == "_x"
    assert axis.longest_common_suffix([]) == ""
    assert axis.snap_up(11.2, (1, 1.25, 2.5, 5)) == 12
    assert axis.render_area((100, 200, 0, 50), (10, 10), 20.0, 1000) == (80, 220, -10, 60)
