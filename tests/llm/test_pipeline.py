"""The pipeline, stage by stage, against plain Python."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from gridspan.llm import pieces, quality

from .test_near_copies import brute_kept
from .test_secrets import brute


def words(text):
    return " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "


def test_stages_match_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "duplicates", "benchmark", "secrets", "tokens"]
    read = lambda df: {r.doc_id: r.asDict() for r in df.collect()}
    step = lambda name, df: spark.createDataFrame(stages[name](spark, df, sf_dir).toPandas(), df.schema)

    kept = step("quality", docs)
    assert kept.columns == columns
    all_rows, good = read(docs), read(kept)
    junk = lambda t: bool(re.search(r"!!|%%%|\*\*\*|\$\$\$|###|&&&| \| ", t))
    shares = [np.mean([d in good for d, r in all_rows.items() if junk(r["text"]) == j]) for j in (False, True)]
    assert shares[0] > 0.95 and shares[1] < 0.2

    once = step("duplicates", kept)
    assert set(read(once)) == brute_kept([(d, r["text"]) for d, r in good.items()])

    clean = step("benchmark", once)
    items = [words(i["text"]) for i in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    planted = {d for d, r in read(once).items() if any(i in words(r["text"]) for i in items)}
    assert set(read(once)) - set(read(clean)) == planted

    hidden = step("secrets", clean)
    before, after = read(clean), read(hidden)
    assert set(before) == set(after)
    for d, r in after.items():
        assert sum(brute(r["text"])[:3]) == 0
        assert r["n_chars"] == len(r["text"])
        if sum(brute(before[d]["text"])[:3]) == 0 and "-----BEGIN" not in before[d]["text"]:
            assert r["text"] == before[d]["text"]

    own = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    tokens = {r.doc_id: r for r in stages["tokens"](spark, hidden, sf_dir).collect()}
    assert set(tokens) == set(after)
    for d, r in tokens.items():
        assert list(r.ids) == own.library.encode(after[d]["text"]) and r.n_tokens == len(r.ids) and r.round_trip


def test_quality_edges(spark):
    r = random.Random(3)
    prose = lambda: " ".join(r.choice(["sun", "moon", "rain", "tree", "hill", "lake"]) for _ in range(60))
    noise = lambda: " ".join(r.choice(["BUY!!", "WIN!!", "FREE!!", "CASH!!"]) for _ in range(60))
    rows = [(n, prose(), "en") for n in range(60)] + [(100 + n, noise(), "en") for n in range(20)] + [(200, None, None), (201, "", "en"), (None, prose(), "en"), (0, "x " * 50000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"gumbel_key": F.lit("own"), "key": F.lit(1)})
    labels = spark.createDataFrame([(n, 1) for n in range(30)] + [(100, 0), (101, 0), (102, 1), (102, 0), (None, 1), (3, None)], "doc_id long, quality int")
    kept = quality.resample(docs, labels)
    got = [x.doc_id for x in kept.collect()]
    assert sum(x is not None and x < 100 for x in got) >= 57 and sum(x is not None and 100 <= x < 120 for x in got) <= 2
    assert quality.resample(docs, labels, k=10).count() == 10
    assert quality.resample(docs, labels, k=0).count() == 0
    assert quality.resample(docs, labels.limit(0)).count() == len(rows)
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    r = random.Random(4)
    values = [r.gauss(0, 1) for _ in range(500)] + [0.25] * 300 + [1e300, -1e300, 5e-324]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 3, 100, 250, 500, 802, 803):
        assert quality.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(keys, 5000) == -1e300


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names; then no rows at all."""
    r = random.Random(8)
    prose = [" ".join(r.choice(["sun", "moon", "rain", "tree", "hill", "lake", "river", "stone"]) for _ in range(40)) for _ in range(12)]
    item = "what is the name of the longest river that runs through all of these seven countries"
    rows = [(n, t, "en") for n, t in enumerate(prose)] + [(3, prose[3], "en"), (50, prose[4], None), (51, prose[5].replace("sun", "SUN"), "en")]
    rows += [(60, None, None), (61, "", "en"), (None, " ", "en"), (70, f"{prose[6]} {item} {prose[7]}", "en"), (80, f"{prose[8]} {prose[9]} password = hunter2hunter2", "en"), (90, "long " * 60000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    clashing = ["_hash", "_spans", "_blob", "log_weight", "gumbel_key", "bad_id", "fp", "ids", "n_tokens"]
    docs.withColumns({c: F.lit("own") for c in clashing}).write.parquet(str(tmp_path / "full/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    for part in ("full", "none"):
        spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / part / "labels.parquet"))
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / part / "benchmark.parquet"))
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path / "full")).collect()}
    assert set(out) == {*range(12), 60, 80, 90}
    own = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {d: t for d, t, _ in reversed(rows)} | {60: "", 80: f"{prose[8]} {prose[9]} [SECRET]"}
    assert {d: list(x.ids) for d, x in out.items()} == {d: own.library.encode(texts[d]) for d in out}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
