"""Periodic runs against a definition tried at every place and period."""

import hashlib
import random
import zlib

import numpy as np

from gridspan.llm import periodic


def plain_runs(words):
    """Every maximal stretch with its smallest period, by looking at all periods."""
    n, out = len(words), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i < n - p and words[i] == words[i + p]:
                i += 1
            stretch = words[start : i + p]
            smallest = next(q for q in range(1, p + 1) if all(stretch[k] == stretch[k + q] for k in range(len(stretch) - q)))
            if smallest == p and len(stretch) >= max(24, 3 * p):
                out.append((start, len(stretch), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts():
    r = random.Random(5)
    for n in range(0, 120):
        yield [r.choice("ab") for _ in range(n)]
    for _ in range(150):
        words = [r.choice("abcdefgh") for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            unit = [r.choice("abc") for _ in range(r.randint(1, 30))]
            words += unit * r.randint(2, 6) + unit[: r.randint(0, len(unit))] + [r.choice("abcd") for _ in range(r.randint(0, 9))]
        yield words
    yield ["a"] * 400
    yield ["a", "b"] * 200
    yield (["a"] * 30 + ["b"]) * 7
    yield ["a", *"bcdefg"] * 3 + ["a", "b", "c"]
    yield [w for k in range(300) for w in ("x", f"w{k}")]


def test_runs_equal_the_definition():
    for words in texts():
        ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
        assert periodic.runs_of(np.array([ids[w] for w in words], np.uint64)) == plain_runs(words), words


def test_long_texts_take_no_quadratic_time():
    assert periodic.runs_of(np.zeros(300_000, np.uint64)) == [(0, 300_000, 1)]
    alternating = np.arange(300_000, dtype=np.uint64)
    alternating[::2] = 0  # half of all probes agree and no run is there
    assert periodic.runs_of(alternating) == []
    assert periodic.runs_of(np.tile(np.arange(50_000, dtype=np.uint64), 4)[:170_000]) == [(0, 170_000, 50_000)]


def plain_row(doc_id, text):
    words = "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{size},{p}\n" for s, size, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_equals_plain_python(spark, tmp_path):
    r = random.Random(8)
    rows = [(k, r.choice([" ", "\n", " \t"]).join(r.choice(["the", "of", "é", "a-b", f"w{k}", "x y"]) for _ in range(r.randint(0, 90)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "a " * 50), (203, "a " * 50), (None, "b c " * 20), (204, " a " * 30), (205, "A a " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS runs", "2 AS n_runs")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain_row(*x) for x in rows), key=repr)
    assert sum(x[1] > 0 for x in got) > 10
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_text_and_spans_come_back(spark):
    rows = periodic.periodic_runs(spark.createDataFrame([(1, "x " + "a b " * 20 + "c")], "doc_id long, text string")).collect()
    assert rows[0].collapsed == "x a b c" and rows[0].runs[0].asDict() == {"start": 1, "length": 40, "period": 2}
