"""What shows only on more rows, files or partitions than sf0.01 has."""

import duckdb
from pyspark.sql import functions as F

from gridspan import catalog
from gridspan.operators import ingest
from gridspan.sources import views

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_line_numbers_keep_the_order_of_the_table(spark, tmp_path):
    """Numbers of lines repeat within an order; the first row of the table counts, as in SQL."""
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("l_linenumber", F.col("l_linenumber") * 0 + 1)
    for n in range(6):
        rows.filter(f"l_suppkey % 6 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "parts"))
    files = sorted(str(p) for p in (tmp_path / "parts").glob("*.parquet"))
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view lineitem as select * from read_parquet({files})")
    (tmp_path / "parts").rename(tmp_path / "lineitem.parquet")
    con.execute(f"create or replace view lineitem as select * from read_parquet({[f.replace('/parts/', '/lineitem.parquet/') for f in files]})")
    got = QUERIES["i4_file_first_loci"](spark, str(tmp_path))
    want = con.execute(SQL["i4_file_first_loci"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def test_contigs_are_broadcast(spark, sf_dir):
    """Contigs are few: rows dealt by them would be a few tasks, however many rows there are."""
    rows, contigs = views.raw_contacts(spark, sf_dir), views.contigs(spark)
    for made in (ingest.known_contigs(rows, contigs, "chr_x", "chr_y"), ingest.upper_triangle(rows, contigs), ingest.diagnostics(views.contacts(spark, sf_dir), contigs)):
        assert "SortMergeJoin" not in plan_of(made)


def test_each_annotation_is_shown_however_many(spark, sf_dir, tmp_path):
    """With over 5000 sub-intervals in view the detailed tables were bins instead."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.crossJoin(spark.range(20)).withColumn("p_partkey", (F.col("p_partkey") + F.col("id") * 2000).cast(part.schema["p_partkey"].dataType)).drop("id").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    rows = lambda names, found: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in map(dict(zip(names, r, strict=True)).get, sorted(names))]) for r in found)
    got = QUERIES["k7_annotations_in_detail"](spark, str(tmp_path))
    want = con.execute(SQL["k7_annotations_in_detail"])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert len(want) > 5000
    assert rows(names, got.select(names).collect()) == rows(names, want)


def test_first_fit_equals_a_plain_search():
    from random import Random

    from gridspan.plans.annotation_table import FirstFit

    draw, tree, ends = Random(1), FirstFit(), []
    for _ in range(3000):
        start = draw.randrange(400)
        row = next((n for n, e in enumerate(ends) if start >= e), len(ends))
        end = start + draw.randrange(1, 60)
        ends[row : row + 1] = [end]
        assert tree.place(start, end) == row


def test_samples_of_one_interval_are_met_once(spark, sf_dir, monkeypatch):
    """Reads were met by every sample that holds them, and samples grow with the annotations."""
    from gridspan.operators import tracks

    asked, plain = [], tracks.in_samples
    monkeypatch.setattr(tracks, "in_samples", lambda rows, samples, side: asked.append(samples) or plain(rows, samples, side))
    contacts, lengths = views.contacts(spark, sf_dir).filter("read_id % 50 = 1"), views.contigs(spark).select("chr", "len")
    bins = spark.createDataFrame([(0, "chr1", "chr1", 0, 50)], "idx long, chr string, actual string, index_pos long, index_size long")
    background = lambda times: tracks.associated_background(contacts, contacts, spark.range(times).selectExpr("id AS sample", "'chr2' AS chr", "10L AS low", "30L AS high"), bins, (lengths, lengths), ["rep0", "rep1", "rep2"], intersection=False).first()["background"]
    one = background(1)
    asked.clear()
    assert background(40) == 40 * one
    assert max(s.filter("chr = 'chr2' and low = 10 and high = 30").count() for s in asked) == 1


def test_axes_are_broadcast(spark, sf_dir):
    """A planned axis is a row for each contig: contacts aren't dealt by contig to meet it."""
    from gridspan.operators import count
    from gridspan.plans.axis import genome_axis

    axis = genome_axis(views.contigs(spark), 10)
    assert "SortMergeJoin" not in plan_of(count.bin_counts(views.contacts(spark, sf_dir), axis, axis))


def test_islands_are_numbered_in_ranges(spark, monkeypatch):
    """A whole dataset was one window. Islands go on over ranges, datasets end within them,
    and no range holds a dataset."""
    from pyspark.sql import Window

    held, plain = [], ingest.staged
    monkeypatch.setattr(ingest, "staged", lambda df, name: held.append(plain(df, name)) or held[-1])
    long_runs = "CASE WHEN id % 11 = 0 THEN '.' WHEN id % 13 = 0 THEN NULL WHEN id < 3000 THEN 'a' ELSE concat('r', id div 7) END"
    rows = spark.range(20000).selectExpr("id AS line", "nullif(if(id < 700, 'x', if(id % 2 = 0, 'y', 'z')), 'z') AS file", f"if(id > 5000, {long_runs}, 'a') AS name")
    got = ingest.read_islands(rows, "name", ["line"], ["file"], parts=16)
    w = Window.partitionBy("file").orderBy("line")
    starts = F.col("name").isNull() | F.col("name").isin("", ".", "-", "/") | F.lag("name").over(w).isNull() | (F.lag("name").over(w) != F.col("name"))
    want = rows.withColumn("island", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert got.columns == want.columns
    assert sorted(got.collect(), key=lambda r: r.line) == sorted(want.collect(), key=lambda r: r.line)
    assert max(r["count"] for r in held[0].groupBy("_range").count().collect()) < 4000
