"""Quality, decontamination and languages against plain versions of their methods."""

import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from gridspan.llm import decontaminate, language, quality, topk


def spark_xxhash64(*values):
    """Spark's xxhash64(): each value's bytes with the hash so far as the seed; nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, h)
    return h


def test_quality_weights_keys_and_choice(spark):
    r = random.Random(9)
    word = lambda lang, good: lang + r.choice("abcdefgh" if good else "efghijkl")
    rows = []
    for n in range(120):
        good, lang = n % 3 > 0, r.choice(["en", "de", None])
        rows.append((n, " ".join(word(lang or "x", good) for _ in range(r.randint(0, 40))), lang))
    rows += [(200, None, "en"), (201, "", "de"), rows[5], rows[5]]
    labels = [(n, int(n % 3 > 0)) for n in range(0, 120, 2)] + [(2, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {(x.doc_id, round(x.log_weight, 9), round(x.gumbel_key, 9)) for x in quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    stated = defaultdict(set)
    for d, q in labels:
        stated[d].add(q)
    target = {d for d, q in stated.items() if q == {1}}
    raw, good, raw_total, good_total = Counter(), Counter(), Counter(), Counter()
    grams = [(d, t, lang, quality._grams(t, lang).tolist()) for d, t, lang in rows]
    for d, _, lang, g in grams:
        raw.update(g)
        raw_total[lang] += len(g)
        if d in target:
            good.update(g)
            good_total[lang] += len(g)
    scored = []
    for d, t, lang, g in grams:
        scale, own = good_total[lang] / max(1, raw_total[lang]), Counter(g)
        weight = sum(n * math.log((good[x] - n * (d in target) + quality.PRIOR) / (max(0, (raw[x] - n) * scale) + quality.PRIOR)) for x, n in own.items())
        bits = spark_xxhash64(struct.pack("<i", quality.SEED), struct.pack("<q", d), t) >> 12
        scored.append((d, weight, weight - math.log(-math.log((bits + 0.5) / 2**52))))
    share = len(target) / len(stated)
    k = sum(w + math.log(share) >= math.log(0.5) for _, w, _ in scored)
    least = sorted((key for *_, key in scored), reverse=True)[k - 1]
    assert 0 < k < len(rows)
    assert kept == {(d, round(w, 9), round(key, 9)) for d, w, key in scored if key >= least}


def brute_contaminated(docs, items, share, shortest):
    """Every diagonal of every document and item."""
    tokens = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    places = defaultdict(list)
    spelled = {i: tokens(t) for i, t in items}
    for i, ws in spelled.items():
        if len(ws) >= shortest:
            for at, w in enumerate(ws):
                places[w].append((i, at))
    out = set()
    for d, t in docs:
        ws, diagonals = tokens(t), defaultdict(set)
        for at, w in enumerate(ws):
            for i, p in places.get(w, ()):
                diagonals[i, p - at].add(at)
        for (i, shift), same in diagonals.items():
            size = min(decontaminate.WINDOW, len(spelled[i]))
            least = share * size if size >= decontaminate.SPAN else size
            low, high = max(0, -shift), min(len(ws), len(spelled[i]) - shift)
            if len(same) >= least and any(sum(x in same for x in range(a, a + size)) >= least - 1e-9 for a in range(low, high - size + 1)):
                out.add((d, i))
    return out


def test_decontamination_of_all_documents(spark, sf_dir):
    docs = [(x["doc_id"], x["text"]) for x in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    items = [(x["item_id"], x["text"]) for x in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    want = brute_contaminated(docs, items, decontaminate.SHARE, decontaminate.SHORTEST)
    assert want and {(x.doc_id, x.item_id) for x in decontaminate.op7_decontaminate(spark, sf_dir).collect()} == want


def test_decontamination_of_repeats_and_short_items(spark):
    r = random.Random(2)
    few = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(1, "w " * 30), (2, few(12)), (3, few(7)), (4, few(40)), (5, "a b c d"), (6, "q r s t u"), (7, "Q r s t u v w x")]
    docs = [(1, "w " * 20000), (2, few(400)), (3, few(9)), (4, "q r s t u v"), (5, "q r s u t"), (6, "x w " * 300), (7, few(3000)), (8, few(3000)), (9, "q r s t u v w x " * 500)]
    make = lambda rows, k: spark.createDataFrame(rows, f"{k} long, text string")
    found = decontaminate.contaminated(make(docs, "doc_id"), make(items, "item_id"), shortest=decontaminate.SHORTEST)
    assert {(x.doc_id, x.item_id) for x in found.collect()} == brute_contaminated(docs, items, decontaminate.SHARE, decontaminate.SHORTEST)


def test_languages_by_explicit_kernel_regression(spark):
    r = random.Random(5)
    syllables = {"aa": ["ka", "to", "mi", "ne"], "bb": ["stra", "plo", "mi", "gr"], "cc": ["eau", "oi", "ne", "ka"]}
    text = lambda lang: " ".join("".join(r.choices(syllables[lang], k=r.randint(2, 4))) for _ in range(r.randint(3, 30)))
    rows = [(n, text(lang := r.choice(list(syllables))), lang) for n in range(150)]
    rows += [(200, None, "aa"), (201, "12 !!", "bb"), (202, "", None), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((x.doc_id, x.held_out, x.lang_pred, round(x.score, 6)) for x in language.identify(docs).collect())

    out = {x.doc_id: x.h for x in docs.select("doc_id", language.held_out().alias("h")).collect()}
    has_letter = lambda t: bool(t and re.search(r"[^\W\d_]", t))
    langs = sorted(syllables)
    train = {lang: sorted({t for d, t, x in rows if x == lang and not out[d] and has_letter(t)}, key=spark_xxhash64) for lang in langs}
    vector = lambda t: set(language.present(t).tolist())
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    samples = [(lang, vector(t)) for lang in langs for t in train[lang][: language.TRAIN_TEXTS // 3]]
    marks = [vector(t) for lang in langs for t in train[lang][: language.LANDMARKS // 3]]
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    whiten = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    feature = lambda v: np.append(np.array([kernel(v, m) for m in marks]) @ whiten, 1.0)
    x = np.array([feature(v) for _, v in samples])
    y = np.array([[1.0 if lang == other else -1.0 for other in langs] for lang, _ in samples])
    w = np.array([len(samples) / len(langs) / sum(a == lang for a, _ in samples) for lang, _ in samples])
    ridge = language.RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 0
    beta = np.linalg.solve(x.T @ (x * w[:, None]) + ridge, x.T @ (y * w[:, None]))
    want = []
    for d, t, _ in rows:
        answers = feature(vector(t)) @ beta if has_letter(t) else None
        want.append((d, out[d], langs[answers.argmax()], answers.max() / 2 + 0.5) if answers is not None else (d, out[d], "und", 0.0))
    assert [g[:3] for g in got] == [x[:3] for x in sorted(want)]
    assert np.allclose([g[3] for g in got], [np.clip(x[3], 0, 1) for x in sorted(want)], atol=1e-3)


def test_languages_beyond_any_sample(spark):
    """Three hundred languages of one document each are all learned."""
    rows = [(n, f"{chr(0x4E00 + n)}{chr(0x5E00 + n)} " * 20, f"l{n:03}") for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {x.lang_pred for x in language.identify(docs).filter("not held_out").collect()}
    assert len(learned) > 0.7 * 300 * 0.75


def test_the_bound_stops_structured_searches(spark):
    r = np.random.default_rng(3)
    spread = r.normal(size=(4000, 24)) * 0.5 ** np.arange(24)
    v = np.round(200 * spread @ np.linalg.qr(r.normal(size=(24, 24)))[0]).astype(np.int64)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<long>")
    axes, ids, asked, tally = topk.principal_axes(frame), np.arange(len(v)), np.arange(0, len(v), 40), []
    got = topk.threshold_topk(ids[asked], v[asked], ids, v, 10, axes, tally)
    want = [(int(q), int(i), int(v[q] @ v[i])) for q in asked for i in sorted(set(ids) - {q}, key=lambda i: (-(v[q] @ v[i]), i))[:10]]
    assert got == want
    assert np.mean(tally) < 0.5 * len(v)


def test_topk_of_repeated_rows(spark):
    rows = [(20, [1.0, 0.5]), (20, [1.0, 0.5]), (1, [0.5, 0.5])]
    e = topk.numbered(topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), repeats=True))
    got = sorted(tuple(x) for x in topk.exact_topk(e, e.filter("id % 20 = 0"), 5).collect())
    assert got == [(20, 1, 20, 5120), (20, 1, 20, 5120), (20, 2, 1, 3072), (20, 2, 1, 3072)]


def test_clashing_names(spark):
    names = ["_hash", "hash", "HASH_", "_blob", "blob", "spans", "_spans", "bad_id", "bad_hash", "log_weight", "gumbel_key", "kept_id", "copies", "fp", "node"]
    docs = spark.createDataFrame([(1, "token = abcdefgh12", "en"), (2, None, "en"), (3, "plain words", None)], "doc_id long, text string, lang string").withColumns({n: F.lit(n) for n in names})
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(1, "some words that no document has, ever and ever again")], "item_id long, text string")
    from gridspan.llm import near_copies, secrets, simhash

    kept = quality.resample(docs, labels, k=3)
    assert kept.columns == [*docs.columns, "_log_weight", "_gumbel_key"]
    for out in (simhash.deduplicate(docs), near_copies.deduplicate(docs), secrets.redact(docs), decontaminate.decontaminate(docs, benchmark), kept.select(docs.columns)):
        assert out.columns == docs.columns
        assert {x.doc_id for x in out.collect()} == {1, 2, 3}
        assert all(x[n] == n for x in out.collect() for n in names)
