"""Quality by importance resampling: hashed n-gram models of target and raw text.

Xie et al., "Data Selection for Language Models via Importance Resampling" (2023). The
weight of a document is the ratio of its probabilities under a bag-of-hashed-n-grams
model of good text and under one of all text; Gumbel top-k draws the kept documents
without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, staged
from .hashing import PRINTED, mix, token_hashes

#: Buckets of the n-gram models of one language.
BUCKETS = 1 << 15
#: At most so many documents with a good label make the target model; those of the smallest hash.
TARGET_DOCS = 50_000
#: Slots of languages; those whose hashes meet in one share a model.
SLOTS = 1 << 12
#: Pseudo-counts that draw every bucket's ratio towards 1.
PRIOR = 50
SEED = 7


def _slot(stratum: str | None) -> int:
    """A null stratum is one by itself."""
    return zlib.crc32(b"" if stratum is None else b"." + stratum.encode("utf-8", "surrogatepass")) % SLOTS


def _grams(text: str | None, stratum: str | None) -> np.ndarray:
    """Buckets of the words and pairs of neighbouring words of a whole text, behind those of
    the slots before its own."""
    words = token_hashes((text or "").encode("utf-8", "surrogatepass"), PRINTED)
    pairs = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])
    return (np.concatenate((words, pairs)) >> np.uint64(7)).astype(np.int64) % BUCKETS + _slot(stratum) * BUCKETS


@dataclass
class Model:
    """Counts of the n-grams of all documents and of the target documents, by bucket (in
    order, where there is one), and the ids of the target documents in order."""

    buckets: np.ndarray
    raw: np.ndarray
    target: np.ndarray
    ids: np.ndarray

    def __post_init__(self) -> None:
        totals = [np.bincount(self.buckets // BUCKETS, x, SLOTS) for x in (self.raw, self.target)]
        self.scale = totals[1] / np.maximum(1, totals[0])

    def log_weight(self, text: str | None, stratum: str | None, is_target: bool) -> float:
        """Sum over the n-grams of log target / raw probability. A document's own counts are
        left out of both models, or its rare n-grams would tell whether it was sampled."""
        grams, times = np.unique(_grams(text, stratum), return_counts=True)
        if not len(grams) or not len(self.buckets):
            return 0.0
        at = np.minimum(np.searchsorted(self.buckets, grams), len(self.buckets) - 1)
        known = self.buckets[at] == grams
        expected = (np.where(known, self.raw[at], 0) - times) * self.scale[_slot(stratum)]
        seen = np.where(known, self.target[at], 0) - times * is_target
        return float((times * np.log((seen + PRIOR) / (np.maximum(0, expected) + PRIOR))).sum())

    def chosen(self, ids: pd.Series) -> np.ndarray:
        return np.isin(ids.fillna(0).to_numpy().astype(np.int64), self.ids) & ids.notna().to_numpy()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", target_docs: int = TARGET_DOCS) -> tuple[Model, float]:
    """(model, share of good labels).

    The raw model counts every n-gram of every document. The target model counts those
    of the documents labelled quality 1 (of several labels all must agree), up to
    target_docs of them. Both are kept apart for every value of stratum_col, null too:
    else a language that the sample happens to have less of would look bad. Only these
    sums, at most BUCKETS for a language, and the sampled ids reach the driver. Without good labels all
    weights are 1.
    """
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    share = good.agg(F.avg(F.when(F.col("q") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    picked = good.filter("q = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs).select("doc_id")
    none = np.zeros(0, np.int64)
    model = Model(none, none, none, np.sort(np.array([r[0] for r in picked.collect()], np.int64)))
    if not len(model.ids):
        return model, 0.0

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for text, stratum, is_target in zip(part["text"], part["stratum"], model.chosen(part["id"]), strict=True):
                grams, slot = _grams(text, stratum), _slot(stratum)
                if slot not in held:
                    held[slot] = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
                for table in held[slot] if is_target else held[slot][:1]:
                    np.add.at(table, grams - slot * BUCKETS, 1)
            for slot, (raw, target) in held.items():
                seen = np.flatnonzero(raw)
                yield pd.DataFrame({"bucket": seen + slot * BUCKETS, "raw": raw[seen], "target": target[seen]})

    counts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(stratum_col).cast("string").alias("stratum")).mapInPandas(count, "bucket long, raw long, target long")
    sums = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas().sort_values("bucket")
    return Model(*(sums[c].to_numpy(np.int64) for c in ("bucket", "raw", "target")), model.ids), float(share)


def with_log_weight(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", name: str = "log_weight") -> DataFrame:
    """docs and the logarithm of the importance weight; 0 for a text without words."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def weight(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, texts, strata in parts:
            own = held.value
            yield pd.Series([own.log_weight(t, s, c) for t, s, c in zip(texts, strata, own.chosen(ids), strict=True)], dtype="float64")

    return docs.withColumn(name, weight(F.col(id_col).cast("long"), F.col(text_col), F.col(stratum_col).cast("string")))


def gumbel(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Standard Gumbel noise, the same for the same id and text in every run."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)), 12)
    return -F.log(-F.log((bits.cast("double") + 0.5) / float(1 << 52)))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest of the column key (doubles), exactly; the least key if there are
    at most k, None if k is 0. Every pass cuts the range that holds it into 65536 parts
    and brings a count for each to the driver."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return None
    left = keys.filter("key is not null")
    n = left.count()
    if n <= k:
        return float(low)
    while low < high:  # between low and high lies the key; 65536 equal parts of what is left
        width = (high - low) / 65536
        if width == 0 or low + width == low:
            break
        part = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(65535)).cast("int")
        counts = left.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("part")).collect()
        for row in counts:
            if row["n"] >= k:
                break
            k -= row["n"]
        low, high = row["low"], row["high"]
        left = left.filter(F.col("key").between(low, high))
    return float(high) if low == high else _within(left, k)


def _within(left: DataFrame, k: int) -> float:
    """Keys too close for equal parts: their distinct values, largest first."""
    for row in left.groupBy("key").count().orderBy(F.desc("key")).toLocalIterator():
        k -= row["count"]
        if k <= 0:
            return float(row["key"])
    raise ValueError("fewer rows than k")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The drawn rows of docs: the columns keep (all by default), then the log weight and
    the Gumbel key, named log_weight and gumbel_key or, where docs has such columns, with
    underscores before.

    k documents are drawn; by default as many as are good rather than not: those whose
    weight times the share of good labels is 1/2 or more. Equal keys (repeated rows)
    stay or go together. Without good labels, or if k isn't below the rows, all stay.
    Two passes over the texts, for the counts and for the weights, which are a table
    without the texts; the k-th key of it picks the rows, which all of docs is joined to
    if more than keep is asked for.
    """
    weight, key, mine, hashed = (fresh(docs, name) for name in ("log_weight", "gumbel_key", "kept_id", "kept_hash"))
    model, share = fit(docs, labels, id_col, text_col, stratum_col)
    noisy = with_log_weight(docs, model, id_col, text_col, stratum_col, weight).withColumn(key, gumbel(id_col, text_col))
    mark = F.xxhash64(F.struct(F.col(text_col), F.col(stratum_col)))
    named = [F.col(id_col).alias(mine), mark.alias(hashed)] if keep is None else keep
    scored = staged(noisy.select(*named, weight, (F.col(weight) + F.col(key)).alias(key)), "weighed")
    chosen = scored
    if k is not None or share > 0:
        if k is None:
            k = scored.filter(F.col(weight) + math.log(share) >= math.log(0.5)).count()
        least = kth_largest(scored.select(F.col(key).alias("key")), k)
        chosen = scored.filter(F.col(key) >= F.lit(least)) if least is not None else scored.limit(0)
    if keep is not None:
        return chosen
    # equal rows have equal keys
    rows = chosen.dropDuplicates([mine, hashed]).hint("shuffle_hash")
    return docs.join(rows, F.col(id_col).eqNullSafe(F.col(mine)) & (mark == F.col(hashed))).select(*docs.columns, weight, key)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
