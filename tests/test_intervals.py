"""Interval joins against all pairs, at lengths from one unit to a contig, and what they cost."""

import random

import pytest
from pyspark.sql import functions as F

from gridspan.operators import decay, intervals


def spans(r, n, longest):
    out = []
    for k in range(n):
        length = int(2 ** r.uniform(0, longest))
        low = r.randrange(0, 1 << longest)
        out.append((k, r.choice("ab"), low, low + length))
    return [*out, (n, "a", 5, 5), (n + 1, "a", 0, 1 << longest), (n + 2, "b", 7, 8), (n + 3, "b", 7, 8)]


@pytest.mark.parametrize("longest", [4, 30])
def test_joins_equal_all_pairs(spark, longest):
    r = random.Random(longest)
    a, b = spans(r, 150, longest), spans(r, 80, longest)
    left = spark.createDataFrame(a, "id long, chr string, low long, high long")
    right = spark.createDataFrame(b, "other long, chr string, low long, high long")
    got = sorted((x.id, x.other) for x in intervals.overlaps(left, right, ["other"]).collect())
    assert got == sorted((i, j) for i, c, l, h in a for j, d, s, e in b if c == d and l < e and s < h and l < h and s < e)
    rows = spark.createDataFrame([(i, c, l, max(l, h - 1)) for i, c, l, h in a], "id long, chr_x string, x_s long, x_e long")
    got = sorted((x.id, x.place) for x in intervals.inside(rows, "chr_x", "x_s", "x_e", right, {"other": "place"}).collect())
    assert got == sorted((i, j) for i, c, l, h in a for j, d, s, e in b if c == d and l >= s and max(l, h - 1) < e)


def test_an_index_has_two_rows_for_an_interval_at_most(spark):
    rows = spark.createDataFrame([(k, "a", 3 * k, 3 * k + 7**k) for k in range(1, 20)], "id long, chr string, low long, high long")
    counts = intervals.indexed(rows, "low", "high").groupBy("id").count().collect()
    assert len(counts) == 19 and max(x["count"] for x in counts) <= 2
    assert [x.n for x in spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 1 << 40, (1 << 40) + 1)], "v long").select(intervals.level(F.col("v")).alias("n")).collect()] == [0, 1, 2, 2, 3, 40, 41]


def test_boxes_along_a_long_diagonal_equal_their_definition(spark):
    """A band of a contig of 300,000 units: what is counted grows with contacts and boxes, not with the area of the boxes."""
    r = random.Random(6)
    contigs = spark.createDataFrame([("a", 300_000), ("b", 200_000)], "chr string, len long")
    grid = spark.createDataFrame([("a", "a", -6000, 6000), ("a", "b", 0, 12_000), ("a", "a", 5, 6), ("a", "a", 5, 8), ("b", "b", -9, -4)], "chr_x string, chr_y string, lo long, hi long")
    rows = []
    for _ in range(400):
        x = r.randrange(0, 200_000)
        y = max(0, x + r.choice([0, 3, -5, -6, -7, r.randrange(-4000, 4000)]))
        rows.append((r.choice("ab"), r.choice("ab"), x, x + r.choice([0, 0, 1, 900]), y, y + r.choice([0, 0, 2, 700]), r.randint(1, 3)))
    contacts = spark.createDataFrame(rows, "chr_x string, chr_y string, x_s long, x_e long, y_s long, y_e long, cnt long")
    for most in (40, 4000):
        bands = decay.sampled_bands(grid, contigs, most)
        got = {(x.chr_x, x.chr_y, x.lo, x.at): x.n for x in decay.sample_counts(bands, contacts).collect()}
        boxes = decay.sample_boxes(bands).collect()
        want = {(b.chr_x, b.chr_y, b.lo, b["at"]): sum(c[6] for c in rows if c[:2] == (b.chr_x, b.chr_y) and b.x0 <= c[2] and c[3] < b.x1 and b.y0 <= c[4] and c[5] < b.y1) for b in boxes}
        assert len(want) > 100 and sum(want.values()) > 50
        assert got.keys() == want.keys() and {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}


def test_ranges_without_extent_or_value(spark):
    from gridspan.operators import tracks

    of = lambda *v: tuple(tracks.display_range(spark.createDataFrame([(x,) for x in v], "n double")).first())
    assert of(0.0, 3.0, 7.0) == (0, 7, 3, 7)
    assert of(5.0, 5.0) == (5, 6, 5, 6)
    assert of(0.0) == (0, 1, 1, 1) and of() == (0, 1, 1, 1)


def test_no_more_filterable_annotations_than_codes(spark):
    from gridspan.operators import diagnostics

    rows = spark.createDataFrame([(t,) for t in "abcd"], "type string")
    assert diagnostics.filterable(rows, ["x", "c", "a", "c"]) == ["c", "a"] and diagnostics.filterable(rows, []) == []
    with pytest.raises(ValueError):
        diagnostics.filterable(rows, list("dcba"))
