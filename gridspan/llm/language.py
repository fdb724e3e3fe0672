"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts is the number of character n-grams, of
1 to 4 characters, that both hold, over the root of the product of the numbers that each
holds (n-grams are hashed to SLOTS slots). Nystroem landmarks make it a finite feature
map, on which kernel ridge regression tells each language from the rest. Landmark
kernels, whitening and regression are all linear in a text's presence vector, so a batch
is scored by one sparse product with a SLOTS x languages matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .hashing import BASE, mix

SLOTS = 1 << 17
LONGEST = 4
#: Bounds of the labelled sample that training and landmarks come from, for all languages together.
TRAIN_TEXTS = 2048
LANDMARKS = 256
RIDGE = 0.1
UNDETERMINED = "und"
#: Weights (slots times languages) that are gathered together, if one text hasn't more.
TOGETHER = 1 << 21


def present(text: str) -> np.ndarray:
    """The slots of all n-grams of a whole text in lower case, each once."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    chars = mix(codes.astype(np.uint64) + np.uint64(1))
    seen = np.zeros(SLOTS, bool)
    h = chars
    for n in range(1, LONGEST + 1):
        if n > 1:
            h = h[:-1] * np.uint64(BASE) + chars[n - 1 :]
        seen[(mix(h) >> np.uint64(64 - 17)).astype(np.int64)] = True
        if len(h) < 2:
            break
    return np.flatnonzero(seen)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int = TRAIN_TEXTS) -> dict[str, list[np.ndarray]]:
    """Presence vectors by language: of each language the distinct texts with a letter of
    the smallest hashes, texts / languages of them at most. Copies count as one text. Only
    hashes and these vectors reach the driver."""
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    hashed = staged(rows.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("hash")).distinct(), "labelled")
    counts = {r[0]: r[1] for r in hashed.groupBy("lang").agg(F.count(F.lit(1))).collect()}
    if not counts:
        return {}
    each = max(1, texts // len(counts))
    uniform = F.shiftrightunsigned("hash", 11).cast("double") / float(1 << 53)
    wanted: dict[str, list[int]] = {}
    # of twice the share that is needed; of languages where chance leaves too few, of more
    open_langs, factor = dict(counts), 1
    while open_langs:
        shares = [(lang, min(1.0, factor * (2 * each + 16) / n)) for lang, n in open_langs.items()]
        part = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, part double"))
        drawn: dict[str, list[int]] = {}
        for r in hashed.join(part, "lang").filter((F.col("part") >= 1) | (uniform < F.col("part"))).select("lang", "hash").collect():
            drawn.setdefault(r["lang"], []).append(r["hash"] & 0xFFFFFFFFFFFFFFFF)
        for lang, hs in drawn.items():
            if len(hs) >= min(each, open_langs[lang]):
                wanted[lang] = [h - (1 << 64) if h >> 63 else h for h in sorted(hs)[:each]]
        open_langs, factor = {lang: n for lang, n in open_langs.items() if lang not in wanted}, 2 * factor
    keys = {(lang, h) for lang, hs in wanted.items() for h in hs}

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = set()
        for some in parts:
            found = []
            for lang, h, text in zip(some["lang"], some["hash"], some["text"], strict=True):
                if (lang, h) in keys and (lang, h) not in met and has_letter(text):
                    met.add((lang, h))
                    found.append((lang, h, present(text).astype(np.int32).tobytes()))
            yield pd.DataFrame(found, columns=["lang", "hash", "slots"])

    chosen = [h for hs in wanted.values() for h in hs]
    few = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).filter(F.col("hash").isin(chosen))
    got = {(r["lang"], r["hash"]): r["slots"] for r in few.mapInPandas(vectors, "lang string, hash long, slots binary").groupBy("lang", "hash").agg(F.min("slots").alias("slots")).collect()}
    return {lang: [np.frombuffer(got[lang, h], np.int32) for h in hs if (lang, h) in got] for lang, hs in sorted(wanted.items())}


def fit(sample: dict[str, list[np.ndarray]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, weights by slot, constants): a text's scores are the sum of the weights
    of its slots over the root of their number, plus the constants."""
    langs = [lang for lang, xs in sample.items() if xs]
    if not langs:
        return [], np.zeros((SLOTS, 0), np.float32), np.zeros(0)
    each = max(1, LANDMARKS // len(langs))
    marks = [x for lang in langs for x in sample[lang][:each]]
    table = np.zeros((SLOTS, len(marks)), np.float32)
    for j, x in enumerate(marks):
        table[x, j] = 1 / np.sqrt(len(x))
    kernel = lambda xs: np.array([table[x].sum(0, dtype=np.float64) / np.sqrt(len(x)) for x in xs])
    values, vectors = np.linalg.eigh(kernel(marks))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    rows = kernel([x for lang in langs for x in sample[lang]]) @ whiten
    answers = np.array([[1.0 if lang == other else -1.0 for other in langs] for lang in langs for _ in sample[lang]])
    # every language weighs the same, however many texts it has
    weight = np.array([1 / len(sample[lang]) for lang in langs for _ in sample[lang]]) * len(rows) / len(langs)
    rows = np.hstack([rows, np.ones((len(rows), 1))])
    penalty = RIDGE * np.eye(rows.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.solve(rows.T @ (rows * weight[:, None]) + penalty, rows.T @ (answers * weight[:, None]))
    return langs, (table @ (whiten @ solved[:-1]).astype(np.float32)), solved[-1]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row, from its whole text alone.

    Languages are the non-null values of lang_col among documents that aren't held out;
    lang_pred is one of them, or `und` with score 0 if the text is null, empty or without
    a letter, or if nothing could be learned. score is the regression's answer for the
    language, moved from -1..1 to 0..1. Ties go to the language first in order. Repeated
    rows and null ids stay (a null id isn't held out unless an empty one would be).
    """
    langs, weights, constants = fit(training_sample(docs, id_col, text_col, lang_col))
    model = docs.sparkSession.sparkContext.broadcast((langs, weights, constants))

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, table, base = model.value
        for part in parts:
            lang, score = np.full(len(part), UNDETERMINED, object), np.zeros(len(part))
            able = [i for i, t in enumerate(part) if names and has_letter(t)]
            while able:
                some, slots, n = [], [], 0
                while able and n * len(names) < TOGETHER:
                    some.append(able.pop())
                    slots.append(present(part.iloc[some[-1]]))
                    n += len(slots[-1])
                sizes = np.array([len(x) for x in slots])
                sums = np.add.reduceat(table[np.concatenate(slots)], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0, dtype=np.float64)
                answers = sums / np.sqrt(sizes)[:, None] + base
                best = answers.argmax(1)
                lang[some] = np.array(names, object)[best]
                score[some] = np.clip((answers[np.arange(len(some)), best] + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang": lang, "score": score})

    rows = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return rows.select(id_col, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
