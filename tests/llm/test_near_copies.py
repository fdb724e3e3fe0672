"""Near copies against brute-force Jaccard."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from gridspan.llm import near_copies


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """The smallest id of each class under links of 0.8 or more."""
    sets = {d: brute_shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders = {}
    for d, s in sets.items():
        for x in s or {()}:
            holders.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in holders.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {d for d in sets if find(d) == d}


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    kept = dict(corpus_pipeline.STAGES)["duplicates"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute_kept(rows))


def test_edited_copies_around_the_threshold(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    rows = []
    for n in (6, 30, 100, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            rows.append(base)
            for share in (0.01, 0.02, 0.02, 0.03, 0.05):
                rows.append([word() if r.random() < share else w for w in base])
    dense = [word() for _ in range(200)]
    rows += [dense[:k] + [word()] + dense[k + 1 :] for k in range(0, 200, 4)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == sorted(brute_kept(rows))


def test_edges(spark):
    rows = [(3, "one two three"), (2, "ONE two\tthree "), (5, None), (4, ""), (None, " \n"), (3, "one two three"), (9, "w " * 60000), (8, "w w w w w"), (None, "alone in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fingerprint": F.lit("x"), "id": F.lit(1), "h": F.lit(2), "n": F.lit(3)})
    kept = near_copies.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "alone in here"), (2, "ONE two\tthree "), (4, ""), (8, "w w w w w")]
    assert near_copies.deduplicate(docs.limit(0)).count() == 0


def test_texts_that_share_passages_are_no_candidates(spark):
    """Texts of a dense group that share rare passages, but not SHARE, were all paired; copies still are."""
    r = random.Random(8)
    some = lambda n: ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]
    passages = [some(70) for _ in range(5)]
    texts = [passages[k % 5] + some(60) for k in range(200)]
    copies = [t[:-k] for k, t in zip(range(1, 9), texts, strict=False)] + [some(2) + t for t in texts[20:24]]
    long = [p + some(1500) for p in passages for _ in range(4)]
    rows = [(k, k, " ".join(t)) for k, t in enumerate(texts + copies + long + [t[5:] for t in long])]
    docs = spark.createDataFrame(rows, "id long, h long, text string")
    sketched = near_copies._sketches(docs, 2, 12).withColumns({"u": F.col("id"), "a": F.col("id")}).localCheckpoint()
    sets = spark.createDataFrame([(k, near_copies.shingles(t).view("i8").tolist()) for k, _, t in rows], "node long, shingles array<long>")
    got = {(p.u, p.v) for p in near_copies._dense_pairs(sketched.select("u", "a", "check", "more", "odd"), sets).collect()}
    known = {k: brute_shingles(t) for k, _, t in rows}
    alike = {(a, b) for a in known for b in known if a < b and len(known[a] & known[b]) >= 0.8 * len(known[a] | known[b])}
    assert len(alike) == 32 and alike <= got
    assert len(got) < 2 * len(alike)


def test_a_dense_pair_is_met_once(spark, monkeypatch):
    """A pair of a dense group was made once for every rare shingle that it shares."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    base, edits = [word() for _ in range(300)], [(k, word()) for k in range(5, 300, 20)]
    texts = [list(base) for _ in range(80)]
    for k, text in enumerate(texts):
        for at, new in r.sample(edits, 1 + k % 6):
            text[at] = new
        del text[: k % 3 * 20]
    long = texts[0] + [word() for _ in range(60)]
    rows = [(k, k, " ".join(t)) for k, t in enumerate([*texts, long, long[4:]])]
    docs = spark.createDataFrame(rows, "id long, h long, text string")
    sketched = near_copies._sketches(docs, 2, 12).withColumns({"u": F.col("id"), "a": F.col("id")}).localCheckpoint()
    sets = spark.createDataFrame([(k, near_copies.shingles(t).view("i8").tolist()) for k, _, t in rows], "node long, shingles array<long>")
    monkeypatch.setattr(type(docs), "distinct", lambda df: df)
    met = [(p.u, p.v, p.a, p.b) for p in near_copies._dense_pairs(sketched.select("u", "a", "check", "more", "odd"), sets).collect()]
    known = {k: brute_shingles(t) for k, _, t in rows}
    alike = {(a, b, a, b) for a in known for b in known if a < b and len(known[a] & known[b]) >= 0.8 * len(known[a] | known[b])}
    assert 500 < len(alike) < 82 * 81 / 2 - 500 and alike <= set(met)
    assert len(met) < 1.2 * len(set(met)) < 2 * len(alike)


def test_exploded_sides_are_not_broadcast(spark, monkeypatch):
    """Spark sizes both joins far too low, and would send a side through the driver."""
    asked, plain = [], near_copies.staged
    monkeypatch.setattr(near_copies, "staged", lambda df, name: asked.append(df) or plain(df, name))
    rows = [(k, k, " ".join(f"w{n}" for n in range(k, k + 40))) for k in range(8)]
    docs = spark.createDataFrame(rows, "id long, h long, text string")
    sketched = near_copies._sketches(docs, 2, 12).withColumns({c: F.col("id") for c in ("u", "a", "fp", "chain")}).localCheckpoint()
    near_copies._index_pairs(plain(sketched.select("fp", "chain", F.lit(1).alias("size"), "check", "more", "parts"), "known"), 12)
    sets = spark.createDataFrame([(k, near_copies.shingles(t).view("i8").tolist()) for k, _, t in rows], "node long, shingles array<long>")
    dense = near_copies._dense_pairs(sketched.select("u", "a", "check", "more", "odd"), sets)
    for df, key in ((asked[0], "key"), (dense, "x")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"SortMergeJoin [{key}#" in plan and f"BroadcastHashJoin [{key}#" not in plan
