"""Benchmark decontamination with spaced seeds.

A seed is a mask over a span of tokens; tokens it ignores may differ. Masked hashes of
the benchmark and of the corpus meet in an equi-join, and every hit is verified on its
alignment: a window of tokens around it must agree up to a share of substitutions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, staged
from .hashing import WORDS, mix, token_hashes

#: Places that each seed looks at, within a span of 10 tokens. However up to 20 % of the
#: tokens of a stretch of 10 to 16 differ, one of these seeds lies somewhere in it on equal ones.
SEEDS = [(0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 7, 8), (0, 1, 2, 4, 8, 9), (0, 2, 4, 6, 7, 9), (0, 1, 3, 4, 5, 7), (0, 1, 3, 7, 8, 9)]
#: The longest seed's span. Shorter items, if asked for, are seeds as a whole: they only
#: match unchanged. Fewer tokens than SHORTEST are a phrase that anyone may use.
SPAN = 10
SHORTEST = 5
#: Tokens of the verified window (a shorter item counts whole) and the share that must agree.
WINDOW = 16
SHARE = 0.8
#: Bits for each benchmark hash in the filter that every task holds, and its size at least
#: and at most (32 MB); beyond that more places pass it, and the join finds the same.
BITS_EACH, LEAST_BITS, MOST_BITS = 128, 1 << 20, 1 << 28
#: A hash has a bit of the filter for each of these shifts.
PROBES = (0, 32)
#: Tokens of documents that a task looks at together, if one isn't longer.
TOGETHER = 1 << 17
#: Places of hits in one stretch.
STRETCH = 64


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of the runs of letters and digits of a whole text in lower case."""
    return token_hashes((text or "").lower().encode("utf-8", "surrogatepass"), WORDS)


def seed_hashes(tokens: np.ndarray, seeds: list[tuple[int, ...]] = SEEDS) -> list[np.ndarray]:
    """For each seed the hashes at every place where its own span fits."""
    weighted = [tokens * np.uint64(pow(0x9E3779B97F4A7C15, p + 1, 1 << 64)) for p in range(SPAN)]
    out = []
    for places in seeds:
        n = max(0, len(tokens) - places[-1])
        h = np.full(n, sum(1 << p for p in places), np.uint64)
        for p in places:
            h += weighted[p][p : p + n]
        out.append(mix(h).view(np.int64))
    return out


def seeds_for(size: int) -> list[tuple[int, ...]]:
    """The seeds of an item of so many tokens."""
    return SEEDS if size >= SPAN else [tuple(range(size))]


def benchmark_tables(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shortest: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items (item_class, tokens), seeds (hash, item_class, item_at), and members
    (item_class, item_id): items with equal tokens are one class, named by its smallest id.

    Null ids and items of fewer than shortest tokens take no part.
    """

    @F.pandas_udf("array<long>")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([tokens_of(t).view(np.int64) for t in texts], dtype=object)

    @F.pandas_udf("array<struct<at:long,hash:long>>")
    def seeds(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"at": at, "hash": x} for h in seed_hashes(np.asarray(t, np.int64).view(np.uint64), seeds_for(len(t))) for at, x in enumerate(h.tolist())] for t in lists], dtype=object)

    named = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), tokens(F.col(text_col)).alias("tokens"))
    named = staged(named.filter(F.size("tokens") >= shortest).withColumn("key", F.sha2(F.concat_ws(",", F.transform("tokens", lambda x: x.cast("string"))), 256)), "items")
    classes = named.groupBy("key").agg(F.min("item_id").alias("item_class"), F.first("tokens").alias("tokens"))
    items = staged(classes, "item-classes")
    members = named.select("key", "item_id").join(items.select("key", "item_class"), "key").select("item_class", "item_id")
    seeds_at = items.select("item_class", F.inline(seeds("tokens")).alias("item_at", "hash")).select("hash", "item_class", "item_at")
    return items.select("item_class", "tokens"), staged(seeds_at, "seeds"), members


def _filter(seeds: DataFrame) -> np.ndarray:
    """The bits of every hash that occurs, in words of 64."""
    wanted = BITS_EACH * max(1, seeds.count())
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length()))
    probes = F.array(*[F.pmod(F.shiftrightunsigned("hash", p), F.lit(size)) for p in PROBES])
    bit = F.col("bit")
    bits = seeds.select(F.explode(probes).alias("bit")).select(F.shiftrightunsigned(bit, 6).alias("word"), (bit % 64).cast("int").alias("nth"))
    words = bits.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, nth))").alias("bits")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[words["word"]] = words["bits"]
    return out.view(np.uint64)


RUN_SCHEMA = "doc_id long, text_hash long, name binary, tokens array<long>, hits array<struct<at:long,hash:long>>"


def _runs(docs: DataFrame, filter_words: np.ndarray, seeds: list[tuple[int, ...]]) -> DataFrame:
    """Stretches of documents around places that pass the filter, of bounded length, with
    what a verification needs of their tokens; most documents have none. Stretches of equal
    tokens and hits share a name."""
    held = docs.sparkSession.sparkContext.broadcast(filter_words)

    def passes(h: np.ndarray) -> np.ndarray:
        at, last = np.arange(len(h)), len(held.value) * 64 - 1
        for p in PROBES:
            bit = (h[at] >> p) & last
            at = at[(held.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0]
        return at

    def runs(some: list[tuple]) -> Iterator[tuple]:
        """Of documents (id, text hash, tokens), whose tokens are looked at in one row."""
        ends = np.cumsum([len(tokens) for *_, tokens in some])
        row = np.concatenate([tokens for *_, tokens in some])
        found = []
        for places, h in zip(seeds, seed_hashes(row, seeds), strict=True):
            at = passes(h)
            doc = np.searchsorted(ends, at, "right")
            inside = at + places[-1] < ends[doc]  # a seed doesn't reach into the next document
            found.append((doc[inside], at[inside], h[at[inside]]))
        doc, at, h = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((h, at, doc))
        doc, at, h = doc[order], at[order], h[order]
        apart = np.flatnonzero((np.diff(at) > SPAN) | (np.diff(doc) > 0)) + 1
        begins = np.repeat(at[[0, *apart]], np.diff([0, *apart, len(at)])) if len(at) else at
        cuts = np.flatnonzero((np.diff(begins) > 0) | (np.diff((at - begins) // STRETCH) > 0)) + 1
        for k in np.split(np.arange(len(at)), cuts) if len(at) else []:
            doc_id, text_hash, tokens = some[doc[k[0]]]
            begin = int(ends[doc[k[0]]]) - len(tokens)
            first, last = int(at[k[0]]) - begin, int(at[k[-1]]) - begin
            a, b = max(0, first - WINDOW), min(len(tokens), last + SPAN + WINDOW)
            places, hashes = at[k] - begin - a, h[k]
            name = xxhash.xxh3_128_digest(tokens[a:b].tobytes() + b"|" + places.tobytes() + hashes.tobytes())
            hits = [{"at": int(x), "hash": int(y)} for x, y in zip(places, hashes, strict=True)]
            yield None if pd.isna(doc_id) else int(doc_id), int(text_hash), name, tokens[a:b].view(np.int64), hits

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows, some, n = [], [], 0
            for doc_id, text_hash, text in zip(part["doc_id"], part["text_hash"], part["text"], strict=True):
                some.append((doc_id, text_hash, tokens_of(text)))
                n += len(some[-1][2])
                if n >= TOGETHER:
                    rows += runs(some)
                    some, n = [], 0
            rows += runs(some) if some else []
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "name", "tokens", "hits"])

    return docs.mapInPandas(find, RUN_SCHEMA)


def agreement(doc: np.ndarray, item: np.ndarray, shift: int) -> float:
    """The best share of equal tokens over windows of WINDOW tokens (all of a shorter
    item) where doc[i] lies on item[i + shift]."""
    a, b = max(0, -shift), min(len(doc), len(item) - shift)
    size = min(WINDOW, len(item))
    if b - a < size:
        return 0.0
    same = np.concatenate(([0], np.cumsum(doc[a:b] == item[a + shift : b + shift])))
    return float((same[size:] - same[:-size]).max() / size)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, shortest: int = SPAN) -> DataFrame:
    """(doc_id, text_hash, item_id, agreement) for each document and benchmark item of
    which they share WINDOW tokens (or all of a shorter item) up to 1 - share of substitutions.

    text_hash tells apart documents that share an id or have none; equal rows count once.
    Null and empty texts, and items under shortest tokens, match nothing; items under SPAN
    tokens match unchanged. The seeds hit every such passage, wherever its substitutions
    are. Documents are read once. Only stretches around hits move on, what meets in the
    join are hashes, and each distinct stretch is verified once, however many documents
    or places have it.
    """
    items, seeds, members = benchmark_tables(benchmark, shortest=shortest)
    sizes = [r[0] for r in items.filter(F.size("tokens") < SPAN).select(F.size("tokens")).distinct().collect()]  # fewer than SPAN
    used = [*SEEDS, *[s for n in sorted(sizes) for s in seeds_for(n)]]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    runs = staged(_runs(rows, _filter(seeds), used), "runs")
    stretches = runs.groupBy("name").agg(F.first("tokens").alias("doc"), F.first("hits").alias("hits"))
    hits = stretches.select("name", F.inline("hits").alias("hit_at", "hash"))
    met = hits.join(seeds, "hash").select("name", "item_class", (F.col("item_at") - F.col("hit_at")).alias("shift")).distinct()
    both = met.join(stretches.select("name", "doc"), "name").join(items, "item_class")

    @F.pandas_udf("double")
    def agree(doc: pd.Series, item: pd.Series, shift: pd.Series) -> pd.Series:
        return pd.Series([agreement(np.asarray(d), np.asarray(i), int(s)) for d, i, s in zip(doc, item, shift, strict=True)], dtype="float64")

    verified = both.select("name", "item_class", agree("doc", "tokens", "shift").alias("agreement")).filter(F.col("agreement") >= share)
    best = staged(verified.groupBy("name", "item_class").agg(F.max("agreement").alias("agreement")), "verified")
    of_docs = runs.select("doc_id", "text_hash", "name").join(best, "name").groupBy("doc_id", "text_hash", "item_class").agg(F.max("agreement").alias("agreement"))
    return of_docs.join(members, "item_class").select("doc_id", "text_hash", "item_id", "agreement")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SPAN) -> DataFrame:
    """docs without those that share a passage with a benchmark item; all columns stay."""
    bad_id, bad_hash = fresh(docs, "bad_id"), fresh(docs, "bad_hash")
    bad = contaminated(docs, benchmark, id_col, text_col, shortest=shortest).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    bad = staged(bad, "contaminated").hint("shuffle_hash")
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.col(text_col)) == F.col(bad_hash)), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=SHORTEST)
    return found.select("doc_id", "item_id", F.round("agreement", 6).alias("agreement"))
