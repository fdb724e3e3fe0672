"""Collocations against their definition in plain Python."""

import random
import re
from collections import Counter, defaultdict

from gridspan.llm import phrases


def plain(rows, least, longest, top, share=100):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = [p for p, c in f.items() if len(p) > 1 and c >= least]
        inside = defaultdict(int)
        for p in found:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], f[p])
        scored = []
        for p in found:
            score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < share * f[p]:
                scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def rows():
    r = random.Random(3)
    words = ["the", "of", "The", "é", "new", "york", "x-1", "Ünder", "in", "to"]
    out = []
    for k in range(300):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "? "]) for _ in range(r.randint(0, 60)))
        out.append((r.choice(["en", "de", None, "und"]), text + r.choice(["", " in the new york of to in"])))
    return [*out, out[0], out[0], ("en", None), ("en", ""), (None, "...\n"), ("fr", "a " * 400 + "b"), ("fr", "a " * 30)]


def compare(spark, given, **settings):
    docs = spark.createDataFrame(given, "lang string, text string").selectExpr("*", "1 AS weight", "'q' AS phrase", "2 AS rank", "3 AS dealt").repartition(3)
    got = sorted(map(tuple, phrases.collocations(docs, **settings).collect()))
    assert got == plain(given, settings["least"], settings["longest"], settings["top"], settings.get("share", 100))
    return got


def test_equals_the_definition(spark):
    assert len(compare(spark, rows(), least=8, longest=5, top=2000)) > 100
    assert compare(spark, rows(), least=5, longest=5, top=7, share=50)
    assert compare(spark, rows(), least=8, longest=3, top=2000)


def test_more_frequent_phrases_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LISTED", 3)
    monkeypatch.setattr(phrases, "LEAST_BITS", 64)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    assert compare(spark, rows(), least=8, longest=5, top=2000)


def test_tables_without_phrases(spark):
    docs = spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(docs.limit(0)).collect() == []
    levels, totals = phrases.frequent_phrases(docs, least=1, longest=2)
    assert sorted(tuple(x) for x in levels.collect()) == [("en", "a", 1, 1), ("en", "a b", 2, 1), ("en", "b", 1, 1)]


def test_large_numbers_are_exact(spark):
    """Products beyond 64 bits, through the expression that scores cuts."""
    a, n, left, right = 10**12 + 7, 10**15 + 3, 10**13 + 1, 10**12 + 9
    docs = spark.createDataFrame([("en", "a b " * 3)], "lang string, text string")
    levels = spark.createDataFrame([("en", "a", 1, left), ("en", "b", 1, right), ("en", "a b", 2, a)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    found = phrases.scored_cuts(levels, totals).collect()
    assert [(x.low.score, x.low.l, x.low.r) for x in found] == [(1000 * a * n // (left * right), left, right)] and docs.count() == 1
