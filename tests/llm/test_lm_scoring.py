"""The language model against a plain one over dictionaries, and its trie against sorted lists."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridspan.llm import lm_scoring, ngram_trie


def test_elias_fano_finds_and_gives_back():
    r = np.random.default_rng(2)
    for n, bound in ((0, 10), (1, 1), (1, 1 << 40), (5, 5), (1000, 1200), (1000, 1 << 50), (3000, 1 << 20), (64, 1 << 63)):
        values = np.unique(r.integers(0, bound, n))
        file = ngram_trie._File()
        level = ngram_trie.EliasFano(file, values, bound)
        level.open(file.map())
        assert level[np.arange(len(values))].tolist() == values.tolist()
        asked = np.unique(np.concatenate([values, r.integers(0, bound, 500), values[values > 0] - 1]))
        places = {v: k for k, v in enumerate(values.tolist())}
        assert level.find(asked).tolist() == [places.get(v, -1) for v in asked.tolist()]
    several = np.sort(r.integers(0, 50, 300))  # pointers repeat
    file = ngram_trie._File()
    level = ngram_trie.EliasFano(file, several, 50)
    assert level.open(file.map())[np.arange(300)].tolist() == several.tolist()


def test_codes_are_within_a_thousandth():
    p = np.concatenate([[0.0, 1.0], np.random.default_rng(1).random(1000) ** 9])
    got = ngram_trie.probabilities(ngram_trie.quantised(p))
    assert got[0] == 0 and (np.abs(got - p)[p > 1e-18] / p[p > 1e-18]).max() < 1e-3


def test_trie_is_smaller_than_its_lists():
    r = np.random.default_rng(3)
    rows = np.unique(np.column_stack([r.zipf(1.3, 100_000) % 2000, r.zipf(1.3, 100_000) % 2000, r.zipf(1.3, 100_000) % 2000]), axis=0)
    trie = ngram_trie.Trie(*rows.T, np.ones(len(rows)))
    assert trie.bytes < 8 * len(rows)


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) by the stated formulas."""
    texts = []
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        held = doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0
        texts.append((doc_id, held, [*re.findall(r"[^\x20\x09-\x0D]+", low), None]))
    one, two, three = Counter(), Counter(), Counter()
    for _, held, words in texts:
        if not held:
            w = ["<s>", "<s>", *words]
            one.update(words)
            two.update(zip(w[1:], w[2:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    total, distinct = sum(one.values()), len(one)
    left = Counter()
    for (a, b, _), n in three.items():
        left[a, b] += n
    single = lambda c: (one[c] + 0.1) / (total + 0.1 * (distinct + 1))
    n_of = lambda b: one[None] if b == "<s>" else one[b]
    pair = lambda b, c: (two[b, c] + ngram_trie.MU_WORD * single(c)) / (n_of(b) + ngram_trie.MU_WORD)
    triple = lambda a, b, c: (three[a, b, c] + ngram_trie.MU_PAIR * pair(b, c)) / (left[a, b] + ngram_trie.MU_PAIR)
    out = []
    for doc_id, held, words in texts:
        w = ["<s>", "<s>", *words]
        out.append((doc_id, held, len(words), sum(one[c] > 0 for c in words), total, sum(math.log10(single(c)) for c in words), sum(math.log10(triple(*w[i : i + 3])) for i in range(len(words)))))
    return out


def corpus():
    r = random.Random(4)
    words = [f"w{k}" for k in range(40)] + ["The", "the", "é", "x-1"] + ["the"] * 30
    rows = [(k, r.choice([" ", "\n"]).join(r.choices(words, k=r.randint(0, 50)))) for k in range(250)]
    return [*rows, rows[3], rows[3], (300, None), (301, ""), (302, "unseen words only"), (None, "the w1 w2"), (303, "w1 " * 3000), (304, "the the \n the\t")]


def compare(got, want):
    key = lambda x: (x[0] is None, x[0] or 0)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9), (g, w)
        assert abs(g[6] - w[6]) <= 1e-3 * w[2], (g, w)


def test_query_equals_plain_model(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS held", "'x' AS part").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    compare(lm_scoring.op11_lm_scoring(spark, str(tmp_path)).collect(), plain(corpus()))


def test_many_blocks_and_spread_words(spark):
    """Blocks of a few documents, few parts, and words that are spread over them."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(2)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    compare(lm_scoring.score_texts(docs, held, block_tokens=500, least_parts=3, part_tokens=1500, spread=1).collect(), plain(corpus()))


def test_tables_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = lm_scoring.score_texts(docs, F.lit(True)).collect()
    assert sorted((x.doc_id, x.n_tokens, x.n_known, x.train_tokens, x.base_score, round(x.score, 6)) for x in rows) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert lm_scoring.score_texts(docs.limit(0), F.lit(False)).collect() == []
