"""The seeds of the decontamination against all placements of substitutions."""

import itertools
import random

from gridspan.llm import decontaminate


def test_no_placement_is_missed():
    for n in range(decontaminate.SPAN, decontaminate.WINDOW + 1):
        spots = [{at + p for p in places} for places in decontaminate.SEEDS for at in range(n - places[-1])]
        most = max(k for k in range(n) if (n - k) / n >= decontaminate.SHARE)
        assert not [c for c in itertools.combinations(range(n), most) if not any(s.isdisjoint(c) for s in spots)], n


def test_substitutions_anywhere(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    items = {n: [word() for _ in range(n)] for n in (10, 15, 16)}
    cut = {10: [(0,), (4, 5), (0, 9)], 15: [(5, 6), (2, 5, 6), (4, 9, 10)], 16: [(5, 6), *itertools.combinations(range(3, 13), 3)]}
    want, rows = [], []
    for n, places in cut.items():
        for c in places:
            want.append((len(rows), n))
            rows.append((len(rows), " ".join([word(), *(word() if i in c else w for i, w in enumerate(items[n])), word()])))
    too_many = [word() if i in (1, 6, 9, 14) else w for i, w in enumerate(items[16])]
    rows += [(1000, " ".join(too_many)), (1001, " ".join(items[16][:8])), (1002, " ".join(items[16][8:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, benchmark).collect()) == want
