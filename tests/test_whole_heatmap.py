"""Balancing by joins, absent bins and datasets, packing and settings, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.operators import combine, normalize, tracks
from gridspan.plans.heatmap import Heatmap, check_capabilities


def grid(spark, a):
    rows = [(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]]
    return spark.createDataFrame(rows, "xi long, yi long, v double")


def test_balance_equals_the_dense_loop(spark):
    r = np.random.default_rng(4)
    a = r.poisson(3, (14, 9)) * (r.random((14, 9)) < 0.7)
    a[3] = 0
    bias_x, bias_y, done = normalize.balance(grid(spark, a), a.shape, min_nz=3, mad_max=0.0, rounds=25, tolerance=1e-4)
    keep_x, keep_y = (a > 0).sum(1) >= 3, (a > 0).sum(0) >= 3
    want_x, want_y = np.where(keep_x, 1.0, 0.0), np.where(keep_y, 1.0, 0.0)
    for _ in range(25):
        p = a * want_x[:, None] * want_y
        margins = [2 * p.sum(1), 2 * p.sum(0)]
        means = [m[m != 0].mean() for m in margins]
        spread = [((m[m != 0] - mean) ** 2).mean() for m, mean in zip(margins, means, strict=True)]
        want_x, want_y = (b / np.where(m == 0, 1, m / mean) for b, m, mean in zip((want_x, want_y), margins, means, strict=True))
        if sum(spread) / 2 < 1e-4:
            break
    assert done == (sum(spread) / 2 < 1e-4)
    got_x, got_y = {r.xi: r.bx for r in bias_x.collect()}, {r.yi: r.by for r in bias_y.collect()}
    assert np.allclose([got_x.get(i, 0.0) for i in range(14)], want_x / np.sqrt(means[0]) * (a.sum(1) > 0))
    assert np.allclose([got_y.get(i, 0.0) for i in range(9)], want_y / np.sqrt(means[1]))


def test_balance_of_nothing(spark):
    bias_x, bias_y, done = normalize.balance(grid(spark, np.eye(3)), (3, 3), min_nz=5)
    assert not done and {r.bx for r in bias_x.collect()} == {1.0} == {r.by for r in bias_y.collect()}
    assert normalize.balance(grid(spark, np.zeros((2, 2)) + np.eye(2)).limit(0), (2, 2))[2] is False


def test_a_dataset_without_a_slice_counts_as_zero(spark):
    counts = spark.createDataFrame([("a", 0, 0, 9), ("a", 1, 0, 4), ("b", 1, 0, 6)], "dataset string, xi long, yi long, n long")
    assert sorted(tuple(r) for r in tracks.over_datasets(counts, "xi").collect()) == [(0, 0, 9), (1, 4, 6)]
    assert sorted(tuple(r) for r in tracks.over_datasets(counts, "xi", ["a", "b", "c"]).collect()) == [(0, 0, 9), (1, 0, 6)]


def test_absent_bins_count_in_ranges(spark):
    values = spark.createDataFrame([(0, 0, 4.0), (1, 1, 10.0)], "xi long, yi long, v double")
    nine = spark.createDataFrame([(9,)], "bins long")
    assert [round(r.scaled, 9) for r in combine.scaled(values, "minmax", "v", nine).orderBy("xi").collect()] == [0.4, 1.0]
    assert tuple(combine.value_range(values.limit(0), "v", nine, 1.0).first()) == (1.0, 1.0)


def test_unknown_normalizations_and_unequal_axes(spark):
    contacts = spark.createDataFrame([("m", "c", "c", 0, 0, 1, 1, 1, 0, 0, 1)], "dataset string, chr_x string, chr_y string, x_s long, x_e long, y_s long, y_e long, bucket int, same_strand int, y_strand int, cnt long")
    contigs = spark.createDataFrame([("c", 0, 4)], "chr string, ord int, len long")
    with pytest.raises(ValueError, match="normalize"):
        Heatmap(contacts, contigs, 1, ["m"], normalize="icecream")
    with pytest.raises(ValueError, match="equal size"):
        Heatmap(contacts, contigs, 1, ["m"], bin_size=(1, 2), normalize="cool-ice").normalized()
    assert Heatmap(contacts, contigs, 1, ["m"], dense=True, scale="dont").values().count() == 16
    assert check_capabilities(contacts, contigs, {"map_q": True, "multi": True}) == [
        "m has no mapping qualities: the filter lets all of its reads through",
        "m has no reads of several loci: the filter lets all of its reads through",
    ]


def test_packed_rows_equal_one_pass(spark):
    r = np.random.default_rng(5)
    starts = np.sort(r.integers(0, 3000, 200))
    rows = [("t", "c", int(s), int(s + r.integers(1, 60)), n) for n, s in enumerate(starts)] + [("u", "c", 5, 9, 1000), ("t", "d", 1, 2, 1001)]
    got = {x.desc_id: x.row for x in tracks.packed_rows(spark.createDataFrame(rows, "type string, chr string, start_bp long, end_bp long, desc_id long"), 10).collect()}
    want, ends = {}, {}
    for t, c, s, e, n in sorted(rows, key=lambda x: (x[2], x[3], x[4])):
        lane = ends.setdefault((t, c), [])
        row = next((k for k, x in enumerate(lane) if x + 10 <= s), len(lane))
        lane[row : row + 1] = [e]
        want[n] = row
    assert got == want


def test_mirrored_bins_exchange_annotation_filters(spark):
    reads = spark.createDataFrame([("m", "c", "c", 0, 0, 2, 2, [0], [1], 1)], "dataset string, chr_x string, chr_y string, x_s long, x_e long, y_s long, y_e long, cat_x array<int>, cat_y array<int>, cnt long")
    contigs = spark.createDataFrame([("c", 0, 4)], "chr string, ord int, len long")
    h = Heatmap(reads, contigs, 1, ["m"], symmetry="mirror", kinds=("gene",), absent=(("gene",), ()), scale="dont")
    assert [(r.xi, r.yi, r.n) for r in h.counts().filter("n > 0").orderBy("xi").collect()] == [(0, 2, 1)]
    both = Heatmap(reads, contigs, 1, ["m"], symmetry="mirror", filters=[F.expr("cat_x[0] = 0")], scale="dont")
    assert both.counts().filter("n > 0").count() == 2


def test_nested_sessions_and_reset():
    from gridspan.session import Session

    old = Session.from_json('{"settings": {"interface": {"max_undo": {"val": 3, "val_max": 9}, "squared_bins": false}, "filters": {"mapping_q": {"val_min": 1, "val_max": 7}, "symmetry": "sym"}}, "dividend": 10}')
    assert (old.get("interface.max_undo"), old.get("interface.squared_bins"), old.get("filters.mapping_q"), old.get("filters.symmetry"), old.get("dividend")) == (3, False, [1, 7], "sym", 10)
    assert old.get("filters.directionality") == "all" and not old.can_save()
    old.set("filters.symmetry", "mirror")
    assert old.can_save()
    old.to_json()
    assert not old.can_save()
    old.reset("filters.")
    assert old.get("filters.symmetry") == "all" and old.get("interface.max_undo") == 3
    assert old.undo() and old.get("filters.symmetry") == "mirror"


def test_runs_of_lines_over_blocks(spark):
    from gridspan.plans.files import file_islands

    names = ["a", "a", "b", "b", "b", ".", ".", "a", "c", "c", "c", "c"]
    blocks = [0, 0, 0, 10, 10, 10, 20, 20, 20, 30, 40, 40]
    rows = [("f", b, n, x) for n, (b, x) in enumerate(zip(blocks, names, strict=True))] + [("g", 0, 100, "c")]
    got = file_islands(spark.createDataFrame(rows, "file string, block long, line long, readid string"), "readid")
    assert [r.island["line"] for r in got.orderBy("line").collect()] == [0, 0, 2, 2, 2, 5, 6, 7, 8, 8, 8, 8, 100]


def test_each_file_has_its_own_columns(spark, tmp_path):
    from gridspan.plans.files import contacts_of_files

    (tmp_path / "one.tsv").write_text("#columns: chr2 pos2 chr1 pos1 readid\nd 5 c 2 r\n")
    (tmp_path / "two.tsv").write_text("r\tc\t1\td\t7\n\nq\tc\t3\tx\t7\n")
    contigs = spark.createDataFrame([("c", 0, 10), ("d", 1, 10)], "chr string, ord int, len long")
    rows = contacts_of_files(spark, str(tmp_path), "m", contigs, 1).orderBy("x_s").collect()
    assert [(r.chr_x, r.x_s, r.chr_y, r.y_s) for r in rows] == [("c", 1, "d", 7), ("c", 2, "d", 5)]


def test_heatmap_of_a_session(spark):
    from gridspan.plans.from_session import heatmap_of
    from gridspan.session import Session

    rows = [("m", "c", "c", x, x, y, y, b, 0, 0, 1) for x, y, b in [(0, 1, 2), (0, 1, 0), (5, 6, 3), (9, 9, 1)]]
    contacts = spark.createDataFrame(rows, "dataset string, chr_x string, chr_y string, x_s long, x_e long, y_s long, y_e long, bucket int, same_strand int, y_strand int, cnt long")
    contigs = spark.createDataFrame([("c", 0, 10)], "chr string, ord int, len long")
    s = Session({"interface.fixed_bin_size": True, "interface.fixed_bin_size_x": 5, "interface.fixed_bin_size_y": 5, "interface.add_draw_area": 0.0, "normalization.scale": "dont", "filters.incomplete_alignments": False, "filters.symmetry": "mirror"})
    h = heatmap_of(s, contacts, contigs, 1, ["m"], [], (0, 10, 0, 10))
    assert (h.bin_size, h.window) == ((5, 5), (0, 10, 0, 10))
    assert sorted((r.xi, r.yi, r.v) for r in h.values().collect()) == [(0, 0, 2.0), (1, 1, 4.0)]
