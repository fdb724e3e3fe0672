"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Of four differing bits at most one falls
into some segment, so two linked fingerprints agree in a whole segment or differ in just
one bit of it. Each segment is indexed once as it is and once for every bit wildcarded;
index entries meet in equality joins, and the joined pair is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, staged
from .components import connected_components

#: (lowest bit, bits) of the segments: floor(MAX_BITS / len(SEGMENTS)) is 1.
SEGMENTS = [(0, 21), (21, 21), (42, 22)]
MAX_BITS = 4
SEED = 42


def _fingerprint(text: str | None, words: int) -> int:
    if text is None or not (data := b" ".join(text.encode("utf-8", "surrogatepass").lower().split())):
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(gaps) + 1 < words:
        hashes = [digest(data, SEED)]
    else:
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(data)]
        hashes = [digest(data[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for any length
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id_col, fingerprint as a signed long): majority bits of the XXH64 of word shingles.

    Words are what ASCII white space parts, A-Z in lower case; shingles count as often as
    they occur. Fewer words than a shingle make one shingle; no word (or null) gives 0.
    """

    @F.pandas_udf("long")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([_fingerprint(t, words) for t in part], dtype="int64")

    return docs.select(F.col(id_col), fingerprint(F.col(text_col)).alias("fingerprint"))


def _bits(x: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << n) - 1))


def _key(segment: int, place: int, value: Column) -> Column:
    return value.bitwiseOR(F.lit((segment << 40) | (place << 32)))


def _exact_keys(fp: Column) -> Column:
    return F.array(*[_key(s, 63, _bits(fp, low, n)) for s, (low, n) in enumerate(SEGMENTS)])


def _variants(fp: Column, bit: int) -> Column:
    """Keys of the segments as they are, and with each bit wildcarded that has this value."""
    out = []
    for s, (low, n) in enumerate(SEGMENTS):
        value = _bits(fp, low, n)
        for i in range(n):
            wild = _key(s, i, value.bitwiseAND(F.lit(((1 << n) - 1) & ~(1 << i))))
            out.append(F.when(F.shiftrightunsigned(value, i).bitwiseAND(F.lit(1)) == bit, wild))
    return F.concat(_exact_keys(fp), F.array_compact(F.array(*out)))


def _chained(fps: DataFrame) -> DataFrame:
    """Links between neighbours in the order of fingerprints that share a whole segment:
    at most three a fingerprint, which already join most of a dense group."""
    keyed = fps.select("fp", F.explode(_exact_keys(F.col("fp"))).alias("key"))
    linked = keyed.withColumn("next", F.lead("fp").over(Window.partitionBy("key").orderBy("fp")))
    return linked.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("next"))) <= MAX_BITS).select(F.col("fp").alias("u"), F.col("next").alias("v"))


def near_components(fps: DataFrame) -> DataFrame:
    """(fp) distinct longs to (node, root): classes under links of up to MAX_BITS bits.

    Chains along whole segments come first; the index join then only looks for links
    between fingerprints whose chains differ, so a group of n close fingerprints doesn't
    give n * n pairs. A pair is met under one key: in the first segment that allows it,
    whole if equal there, else under the differing bit, which one side has and the other
    has not.
    """
    chains = staged(connected_components(_chained(fps)), "chains")
    known = fps.join(chains, fps["fp"] == chains["node"], "left").select("fp", F.coalesce("root", "fp").alias("chain"))
    known = staged(known, "fingerprints")
    side = lambda bit, a: known.select(F.col("fp").alias(f"{a}_fp"), F.col("chain").alias(f"{a}_chain"), F.explode(_variants(F.col("fp"), bit)).alias("key"))
    x = F.col("l_fp").bitwiseXOR(F.col("r_fp"))
    whole = _bits(F.col("key"), 32, 8) == 63
    segment = _bits(F.col("key"), 40, 8)
    first = F.lit(True)
    for s, (low, n) in enumerate(SEGMENTS):
        first &= (segment <= s) | (F.bit_count(_bits(x, low, n)) > 1)
    meet = (F.bit_count(x) <= MAX_BITS) & (F.col("l_chain") != F.col("r_chain")) & (~whole | (F.col("l_fp") < F.col("r_fp"))) & first
    # exploded rows are some 35 times what Spark takes them for, which it would broadcast
    met = side(0, "l").hint("merge").join(side(1, "r"), "key").filter(meet).select(F.col("l_chain").alias("u"), F.col("r_chain").alias("v"))
    roots = connected_components(met)
    top = known.join(roots, known["chain"] == roots["node"], "left")
    return top.select(F.col("fp").alias("node"), F.coalesce("root", "chain").alias("root"))


def _classes(fps: DataFrame) -> DataFrame:
    """(id, fingerprint, ...) to (fp, least, root): each distinct fingerprint, its smallest
    id and its class."""
    distinct = staged(fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("least")), "distinct")
    return staged(distinct.join(near_components(distinct.select("fp")), F.col("fp") == F.col("node")).select("fp", "least", "root"), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs; component_id is the
    smallest id reachable over links of up to MAX_BITS differing bits, the own included.

    Null and wordless texts share the fingerprint 0 and are linked like others. Repeated
    rows stay; null ids get the component's smallest id and are never one. Other columns
    aren't read. Copies meet as one fingerprint with its smallest id before any join.
    """
    fps = staged(fingerprints(docs, id_col, text_col, words).toDF("id", "fingerprint"), "simhash")
    roots = _classes(fps)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.join(least, "root").select("fp", "component_id")
    out = fps.join(classes, F.col("fingerprint") == F.col("fp"))
    return out.select(F.col("id").alias(id_col), F.col("fingerprint"), "component_id")


def one_per_class(marked: DataFrame, fps: DataFrame, roots: DataFrame, id_col: str, mark: str) -> DataFrame:
    """Of marked (docs with a hash of the text in the column mark) the first row of each
    class, without mark; fps (id, h, fingerprint) names the rows, roots (fp, root) the classes."""
    member = fps.groupBy("fingerprint").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("best"))
    best = member.join(roots, F.col("fingerprint") == F.col("fp")).groupBy("root").agg(F.min("best").alias("best"))
    copies = fps.groupBy("id", "h").agg(F.count(F.lit(1)).alias("copies"))
    named = best.select(F.col("best.id").alias("b"), F.col("best.h").alias("bh"))
    kept = named.join(copies, F.col("b").eqNullSafe(F.col("id")) & (F.col("bh") == F.col("h")))
    mine, hashed = fresh(marked, "kept_id"), fresh(marked, "kept_hash")
    kept = staged(kept.select(F.col("b").alias(mine), F.col("bh").alias(hashed), "copies"), "kept")
    same = F.col(id_col).eqNullSafe(F.col(mine)) & (F.col(mark) == F.col(hashed))
    alone = marked.join(kept.filter("copies = 1").drop("copies").hint("shuffle_hash"), same, "left_semi")
    repeated = marked.join(kept.filter("copies > 1").drop("copies").hint("shuffle_hash"), same, "left_semi").dropDuplicates([id_col, mark])
    return alone.unionByName(repeated).drop(mark)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row of docs, with all its columns, for each class of near-duplicates: that of
    the smallest id (nulls last; then the smallest hash of the text). Of rows that share
    both, one stays. Texts without a word, and null texts, are one class."""
    mark = fresh(docs, "hash")
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    rows = marked.select(F.struct(F.col(id_col).alias("id"), F.col(mark).alias("h")).alias("row"), F.col(text_col).alias("text"))
    fps = staged(fingerprints(rows, "row", "text", words).select("row.id", "row.h", "fingerprint"), "simhash")
    return one_per_class(marked, fps, _classes(fps), id_col, mark)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
