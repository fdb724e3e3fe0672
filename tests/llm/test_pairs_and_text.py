"""URL rules, WARC, top-k, SimHash, decontamination, language and pieces against brute force."""

import hashlib
import base64
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from gridspan.llm import components, decontaminate, language, pieces, simhash, topk, url_filter, warc

# url filters


def judge(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = ["http://A.Net/x", "http://a.net", "https://net/", "x.net/", None, "", "http://m.EXAMPLE.net/en/1?q#f", "http://example.com/de/", "http://example.com.net/de/", "ftp://u@b.org/fr/a://c", "http://org?x", "http://.org/fr/", "http://a\n.net/é", "http://notnet/"]


def test_url_rules(spark):
    rules = [*url_filter.DEFAULT_RULES, ("b.org", "/fr/a", "block"), ("net", "", "allow")]
    rows = [(n, u) for n, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[0]), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("x", None, "block"), ("y", "/", "maybe")], url_filter.RULES_SCHEMA)
    got = sorted(map(repr, [tuple(r) for r in url_filter.judge_urls(pages, table).collect()]))
    assert got == sorted(repr((n, *judge(u, rules))) for n, u in rows)
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, table.limit(0)).collect()} == {"allow"}


# warc


def test_warc(spark, tmp_path):
    html = ["<a>", "", None, "<a>", "é\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "<a>"]
    rows = [(n + 1, f"http://h/{n}\r\nX: y", h) for n, h in enumerate(html)] + [(None, None, "<a>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(0), "first_id": F.lit(0)})
    path = str(tmp_path / "w")
    warc.write_warc(pages, path, records_per_file=5)
    captures = warc.assemble(warc.read_records(spark, path, with_payload=True)).collect()
    assert len(captures) == len(rows)
    by = {c.capture_id: c for c in captures}
    for page_id, _, h in rows:
        c = by[f"<urn:capture:{'' if page_id is None else page_id}:response>"]
        data = (h or "").encode()
        first = min((p for p, _, x in rows if (x or "") == (h or "") and p is not None), default=None)
        assert c.response.payload_bytes == len(data)
        assert c.response.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (c.response.record_type == "response") == (page_id == first)
        assert c.response.payload == (data if page_id == first else None)
        assert c.request.block.startswith("GET ") and c.metadata.block.strip() == f"payload-bytes: {len(data)}"
    orphan = spark.createDataFrame([("a", "request", "gone", None, None, None, None, None, "GET", None)], warc.RECORD_SCHEMA)
    lone = warc.assemble(orphan).collect()
    assert [(c.capture_id, c.response, c.n_concurrent) for c in lone] == [("gone", None, 1)]
    none = str(tmp_path / "none")
    warc.write_warc(pages.limit(0), none)
    assert warc.assemble(warc.read_records(spark, none)).count() == 0


# top-k


def brute_topk(ids, v, asked, k):
    out = []
    for q in asked:
        scores = [(-int(sum(int(a) * int(b) for a, b in zip(v[q], v[i], strict=True))), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q]]
        out += [(int(ids[q]), i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_threshold_algorithm(seed):
    r = np.random.default_rng(seed)
    n = [5, 60, 300, 300, 300, 1][seed]
    v = r.integers(-3, 4, (n, 4)) if seed != 3 else r.integers(-(2**40), 2**40, (n, 4))
    if seed == 4:
        v[: n // 2] = v[0]
    ids = np.arange(n) * 3
    asked = list(range(0, n, 7))
    got = sorted(topk.threshold_topk(ids[asked], v[asked], ids, v, 10), key=lambda x: (x[0], -x[2], x[1]))
    assert got == brute_topk(ids, v, asked, 10)


def test_topk_edges(spark):
    rows = [(20, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [-1.0, 2.0]), (6, [-1.0, 2.0]), (40, [0.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("id", F.lit(1))
    q = topk.quantised(e)
    got = [tuple(r) for r in topk.exact_topk(q, q.filter("id % 20 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 64 * 64 + 32 * 32), (20, 2, 6, -64 * 64 + 128 * 32), (40, 1, 1, 0), (40, 2, 6, 0)]
    assert topk.exact_topk(q.limit(0), q.limit(0), 2).count() == 0


# simhash


def brute_fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_query(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    fps = [brute_fingerprint(d["text"]) for d in docs]
    want = {d["doc_id"]: (f"{f:016x}", c) for d, f, c in zip(docs, fps, brute_components([d["doc_id"] for d in docs], fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, sf_dir).collect()}
    assert got == want


def test_index_join_finds_every_link(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = simhash.near_components(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    got = {r["node"]: r["root"] for r in rows}
    want = brute_components(list(range(len(fps))), fps)
    groups = lambda f: sorted(sorted(i for i in range(len(fps)) if f(i) == g) for g in {f(i) for i in range(len(fps))})
    assert groups(lambda i: got[signed[i]]) == groups(lambda i: want[i])


def test_exploded_index_is_not_broadcast(spark, monkeypatch):
    """Spark sizes the index by its rows before the explode, and sent it all to the driver."""
    met, plain = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda links: met.append(links) or plain(links))
    simhash.near_components(spark.range(2000).select(F.xxhash64("id").alias("fp")))
    plan = met[-1]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and all(got[i] == 100 for i in range(101, 140))
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_edges(spark):
    rows = [(3, "one two three"), (2, "ONE two\tthree "), (5, None), (4, ""), (None, " \n"), (3, "one two three"), (9, "w " * 60000), (None, "alone in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fingerprint": F.lit("x"), "id": F.lit(1), "root": F.lit(2), "fp": F.lit(3)})
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 4), (2, 2), (3, 2), (3, 2), (4, 4), (5, 4), (9, 9)]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "alone in here"), (2, "ONE two\tthree "), (4, ""), (9, "w " * 60000)]
    same = spark.createDataFrame([(1, "a b c d e")] * 5 + [(2, "a b c d e")] * 3, "doc_id long, text string")
    assert [tuple(r) for r in simhash.deduplicate(same).collect()] == [(1, "a b c d e")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# decontamination


def test_decontamination(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    items = [[word() for _ in range(n)] for n in (30, 45, 16, 9, 10)]
    clean = [[word() for _ in range(80)] for _ in range(20)]
    inside = lambda w: " ".join(clean[0][:20]) + " " + " ".join(w).upper() + ", " + " ".join(clean[1][:20])
    swapped = list(items[1])
    for k in range(4, 45, 9):
        swapped[k] = word()
    rows = [(1, inside(items[0])), (2, inside(swapped)), (3, inside(items[2])), (4, inside(items[3])), (5, inside(items[4])), (6, inside(items[0][7:])), (None, inside(items[0])), (8, None), (9, "")]
    rows += [(20 + n, " ".join(w)) for n, w in enumerate(clean)] + [(1, inside(items[0]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(1), "tokens": F.lit(1), "at": F.lit(2)})
    table = [(k, " ".join(w)) for k, w in enumerate(items)] + [(50, " ".join(items[0]).upper()), (None, "x"), (60, None)]
    benchmark = spark.createDataFrame(table, "item_id long, text string")
    got = sorted((x.doc_id or 0, x.item_id) for x in decontaminate.contaminated(docs, benchmark).collect())
    assert got == [(0, 0), (0, 50), (1, 0), (1, 50), (2, 1), (3, 2), (5, 4), (6, 0), (6, 50)]
    left = decontaminate.decontaminate(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(x.doc_id for x in left.collect()) == [4, 8, 9, *range(20, 40)]
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


def test_planted_passages(spark, sf_dir):
    import re

    words = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    planted = {(d["doc_id"], i["item_id"]) for i in items for d in docs if words(i["text"]) in words(d["text"])}
    assert planted
    assert planted <= {(r.doc_id, r.item_id) for r in decontaminate.op7_decontaminate(spark, sf_dir).collect()}


# language


def test_language(spark, sf_dir):
    rows = language.op8_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    en, de = "the cat and the dog went home ", "der hund und die katze gehen heim "
    rows = [(n, en * (1 + n % 3), "en") for n in range(20)] + [(100 + n, de * (1 + n % 3), "de") for n in range(20)]
    rows += [(200, None, "en"), (201, "123 !?", "en"), (202, "", None), (203, "the dog", None), (None, "die katze und der hund", "de"), (204, en * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert [got[k] for k in (200, 201, 202, 203, None, 204)] == ["und", "und", "und", "en", "de", "en"]
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


# pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts(n):
    r = random.Random(2)
    return ["".join(r.choice("abcdefthein ▁ \n\té日本語ABC.!%$ 0 1 😀") for _ in range(r.randint(0, 50))) for _ in range(n)] + ["", "  ", " a", "a ", "\0x", "x" * 700, "the" * 300]


def test_merge_model_equals_the_library():
    own, rows = pieces.codec(MODEL), texts(1500)
    for got, want in zip(own.encode(rows), own.library.encode(rows, num_threads=1), strict=True):
        assert got.tolist() == want
        assert own.decode(got) == own.library.decode(want)


def unigram_model():
    """The same pieces as a unigram model: field 3 of the trainer's message set to 1."""
    data = open(MODEL, "rb").read()
    out = bytearray()
    at = 0
    while at < len(data):
        start, key, shift = at, 0, 0
        while True:
            byte = data[at]
            key |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                break
        assert key & 7 == 2
        size, shift = 0, 0
        while True:
            byte = data[at]
            size |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                break
        body = data[at : at + size]
        at += size
        if key >> 3 == 2:
            body += b"\x18\x01"
            length, n = bytearray(), len(body)
            while n > 127:
                length.append(n & 127 | 128)
                n >>= 7
            length.append(n)
            out += bytes([18]) + length + body
        else:
            out += data[start:at]
    return bytes(out)


def test_unigram_model_reaches_the_library_score():
    own = pieces.Codec(unigram_model())
    assert not own.bpe
    rows = texts(600)
    score = lambda ids: sum(own.scores[i] for i in ids if not own.library.is_byte(i))
    for got, want in zip(own.encode(rows), own.library.encode(rows, num_threads=1), strict=True):
        assert own.decode(got) == own.library.decode(want)
        assert score(got.tolist()) == pytest.approx(score(want), rel=1e-6)


def test_pieces_query_and_edges(spark, sf_dir):
    rows = pieces.op1_sentencepiece(spark, sf_dir).collect()
    assert all(r.round_trip for r in rows)
    import zlib

    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    own = pieces.codec(MODEL)
    want = {d["doc_id"]: x for d, x in zip(docs, own.library.encode([d["text"] or "" for d in docs], num_threads=1), strict=True)}
    assert all(r.n_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id], "<u2").tobytes()) for r in rows)
    edge = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, "x" * 5000 + " é"), (3, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = pieces.encode_documents(edge)
    assert sorted((r.doc_id or 0, len(r.ids) == 0) for r in got.collect()) == [(0, False), (1, True), (1, True), (2, False), (3, True)]
    back = pieces.decode_documents(got)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == [(0, "a b"), (1, ""), (1, ""), (2, "x" * 5000 + " é"), (3, "")]
    assert pieces.encode_documents(edge.limit(0)).count() == 0
