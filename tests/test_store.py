"""A store's manifest, warnings and choice of summaries."""

import warnings

import pytest

from gridspan.checks import storing
from gridspan.plans.heatmap import Decay
from gridspan.sources import views
from gridspan.store import Store


@pytest.fixture(scope="module")
def store(spark, sf_dir):
    return storing.built(spark, sf_dir)


def test_the_coarsest_summary_that_answers_is_read(spark, sf_dir, store):
    def steps(**settings):
        h = store.heatmap(["rep0"], ["rep2"], **{"bin_size": (20, 20), "scale": "dont"} | settings)
        return {f.rsplit("/", 2)[1] for f in h.values().inputFiles() if "/data/" in f}

    assert steps() == {"10"}
    assert steps(bin_size=(20, 15)) == {"5"}
    assert steps(bin_size=(20, 7)) == {"1"}
    assert steps(mode="encloses") == {"1"} and steps(ddd=Decay()) == {"1"}
    assert steps(window=(20, 100, 0, 408)) == {"10"}
    assert steps(window=(25, 100, 0, 408)) == {"5"}
    assert steps(window=(20, 93, 0, 408), cut_off="smaller") == {"10"}  # bins run on to 100
    few = store.contacts(["rep0"], 10)
    assert few.count() < store.contacts(["rep0"]).count()


def test_filters_warn_of_what_datasets_lack(store):
    with pytest.warns(UserWarning) as seen:
        store.heatmap(["rep0", "flat"], ["empty"], map_q=(0, 254, True), direction="same", mode="enclosed_only")
    lines = [x for x in (str(w.message) for w in seen) if " has no " in x]
    assert len(lines) == 6 and not any("rep0" in x for x in lines)
    assert any(x.startswith("flat has no mapping qualities") for x in lines)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        store.heatmap(["rep0"], ["flat"])
        store.heatmap(["rep0"], ["rep1"], map_q=(0, 254, True), direction="same")


def test_only_what_the_manifest_names_is_there(spark, sf_dir, store):
    again = Store.open(spark, store.folder.removesuffix(".store"))
    assert again.factors == (1, 5, 10) and again.dividend == views.DIVIDEND
    before = again.contacts(["rep1"]).count()
    views.contacts(spark, sf_dir).write.parquet(f"{again.folder}/data/half-written/1")
    assert again.contacts(["rep1"]).count() == before
    with pytest.raises(ValueError):
        again.contacts(["rep1", "nothing"])
    with pytest.raises(FileNotFoundError):
        Store.open(spark, f"{store.folder}-other")
    assert again.contacts(["empty"]).count() == 0
    assert again.heatmap(["empty"], bin_size=(20, 20), scale="dont").values().count() == 0


def test_a_stream_of_files_equals_their_batch_ingest(spark, tmp_path):
    """Reads of several lines, files that arrive in turn, and a batch that runs twice."""
    from pyspark.sql import functions as F

    from gridspan.plans import files
    from gridspan.store import summary
    from gridspan.streaming import contacts as stream

    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    contigs = spark.createDataFrame([("chr0", 0, 50), ("chr1", 1, 50)], "chr string, ord int, len long")
    into = Store.create(spark, str(tmp_path / "all.store"), contigs, 10, (1, 5))
    head = ["#columns: readid chr1 pos1 chr2 pos2 strand1 strand2 mapq1 mapq2\n", "", "#columns: chr1 pos1 chr2 pos2 readid\n"]
    line = [lambda r, x, y: f"{r} chr0 {x} chr1 {y} + - {x % 40} 9\n", lambda r, x, y: f"{r} chr0 {x} chr0 {y}\n", lambda r, x, y: f"chr1 {x} chr0 {y} {r}\n"]
    for n in range(6):
        kind = n % 3
        rows = [line[kind](f"r{k // (1 + n % 4)}", (7 * k + n) % 400, (31 * k) % 400) for k in range(40)]
        (folder / f"{n}.pairs").write_text(head[kind] + "".join(rows) + "r99 nowhere 1 chr0 2\n" * (kind == 1))
        if n % 2:
            stream.follow_into(into, str(folder), state, "rep", files_per_batch=1).awaitTermination()
    want = summary(files.contacts_of_files(spark, str(folder), "rep", contigs, 10), 1)
    got = into.contacts(["rep"]).groupBy(*[c for c in want.columns if c not in ("cnt", "reads")]).agg(F.sum("cnt").alias("cnt"), F.sum("reads").alias("reads"))
    assert want.agg(F.sum("reads")).first()[0] > 100
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    assert into.datasets().first()["batches"] == 6
    name = into._batches().first()["batch"]
    assert into.add("rep", into.contacts(["rep"]), name) == name and into.datasets().first()["batches"] == 6
