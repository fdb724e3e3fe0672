"""Near copies by SimHash: five-word shingles, deletion-variant signatures, exact similarity.

The index is that of simhash.py over longer signatures. A bit of two sets of shingles
differs with the probability arccos(cosine) / pi, which is 0.151 for sets of one size and a
Jaccard similarity of SHARE. Signatures are cut into few segments; texts are candidates if
some segment agrees or differs by one bit, which variants with one more bit find by equality.
Every candidate pair is then verified on the whole sets, so no pair below SHARE is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, staged
from .components import connected_components
from .hashing import BASE, PRINTED, mix, token_hashes
from .simhash import one_per_class

WORDS = 5
SHARE = 0.8
#: Smaller sets are as similar as SHARE only if equal.
LEAST = math.ceil(SHARE / (1 - SHARE) - 1e-9)
#: A pair of similarity SHARE is left unfound with this probability, at any number of texts.
MISS = 0.01
#: Unlike texts differ in 64 of 128 further bits, at SHARE 19 differ; beyond so many a candidate isn't verified.
CHECK_BITS = 36
#: Keys under which more pairs meet are dense, and entries that differ in so few further
#: bits from one of the largest chain under such a key are the group that makes it dense.
DENSE, CORE_BITS = 512, 42
#: Parities of shingles by hash: two sets differ in as many shingles at least as in parities.
PARITIES = 512
#: So many earlier shingles go with one of a dense text; pairs that share one of them aren't met again.
BEFORE = 16
#: Lists of so many candidate texts (16 bytes each) are broadcast; longer ones are joined by a shuffle.
SMALL = 1 << 19

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_MASKS = _random.integers(0, 1 << 64, 256, np.uint64)


def plan_segments(texts: int) -> tuple[int, int]:
    """(segments, bits of one). A segment's bits follow the number of texts, so that a text
    meets about 30 others by chance in one however many there are, and there are as many
    segments as MISS asks for."""
    bits = max(12, math.ceil(math.log2(max(1, texts))) - 2)
    differ = math.acos(2 * SHARE / (1 + SHARE)) / math.pi
    hit = (1 - differ) ** bits + bits * differ * (1 - differ) ** (bits - 1)
    return math.ceil(math.log(MISS) / math.log(1 - hit)), bits


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of a whole text, in order. Words are what ASCII white
    space parts, A-Z in lower case; fewer than WORDS make one shingle, none makes none."""
    tokens = token_hashes((text or "").encode("utf-8", "surrogatepass").lower(), PRINTED)
    if not len(tokens):
        return tokens
    width = min(WORDS, len(tokens))
    n = len(tokens) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(BASE) + tokens[k : k + n])
    return np.unique(h)


def majority(found: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits: each is 1 if it is set in more than half of the hashes made of found;
    of two halves that of the first hash counts."""
    ones = np.zeros(64 * words, np.int64)
    first = np.unpackbits(mix((found[:1, None] ^ _MASKS[:words]) * _FACTORS[:words]).view(np.uint8), bitorder="little")
    for at in range(0, len(found), 1 << 12):  # bounded memory for any length
        some = found[at : at + (1 << 12), None]
        bits = np.unpackbits(mix((some ^ _MASKS[:words]) * _FACTORS[:words]).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # as many as a byte can count
            ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    return (2 * ones + (first if len(found) else 0) > len(found)).astype(np.int64)


def _sketches(docs: DataFrame, segments: int, bits: int) -> DataFrame:
    """(id, h, text) to (id, h, fingerprint, n, check, more, odd, parts): texts with equal sets of n
    shingles share a fingerprint, odd are the PARITIES, and parts are the values of the
    signature's segments."""
    words = 2 + -(-segments * bits // 64)
    values = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("struct<fingerprint:long,n:long,check:long,more:long,odd:array<long>,parts:array<long>>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            rows = []
            for text in part:
                found = shingles(text)
                name = mix(mix(found).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(found)))
                signature = majority(found, words)
                check, more = np.packbits(signature[:128].astype(np.uint8), bitorder="little").view("<i8").tolist()
                parts = signature[128 : 128 + segments * bits].reshape(segments, bits) @ values if len(found) else values[:0]
                odd = np.packbits(np.bincount((found >> np.uint64(7)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1, bitorder="little").view("<i8")
                rows.append((int(name.view(np.int64)[0]), len(found), check, more, odd, parts))
            yield pd.DataFrame(rows, columns=["fingerprint", "n", "check", "more", "odd", "parts"])

    return docs.select("id", "h", sketch(F.col("text")).alias("s")).select("id", "h", "s.*")


def _sizes(n: str, m: str) -> Column:
    """Whether sets of these sizes can be as similar as SHARE."""
    return (F.col(n) >= SHARE * F.col(m) - 1e-9) & (F.col(m) >= SHARE * F.col(n) - 1e-9)


def _differ(check: str, more: str, other: str, other_more: str) -> Column:
    """How many further bits differ; the lowest doesn't count."""
    return F.bit_count(F.col(check).bitwiseXOR(F.col(other)).bitwiseAND(F.lit(~1))) + F.bit_count(F.col(more).bitwiseXOR(F.col(other_more)))


def _near(n: str, m: str, odd: str, other: str) -> Column:
    """False only if so many parities differ that sets of these sizes aren't as similar as SHARE."""
    apart = [F.bit_count(F.col(odd)[i].bitwiseXOR(F.col(other)[i])) for i in range(PARITIES // 64)]
    return reduce(add, apart) <= (F.col(n) + F.col(m)) * ((1 - SHARE) / (1 + SHARE)) + 1e-9


def _keys(part: Column, value: Column, bits: int) -> Column:
    """Keys of one segment as it is, and with each bit set that isn't."""
    of = lambda v: F.shiftleft(part.cast("long"), 48).bitwiseOR(v)
    more = [F.when(F.shiftrightunsigned(value, i).bitwiseAND(F.lit(1)) == 0, of(value.bitwiseOR(F.lit(1 << i)))) for i in range(bits)]
    return F.array_compact(F.array(of(value), *more))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (u, v, ...) those whose sets (node, shingles) have a similarity of SHARE or more."""

    u = sets.select(F.col("node").alias("u"), F.col("shingles").alias("_u"))
    v = sets.select(F.col("node").alias("v"), F.col("shingles").alias("_v"))
    both = F.size(F.array_intersect("_u", "_v"))
    alike = both >= SHARE * (F.size("_u") + F.size("_v") - both) - 1e-9
    return pairs.join(u, "u").join(v, "v").filter(alike).drop("_u", "_v")


def _sets(pairs: DataFrame, distinct: DataFrame, texts: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
    """(node, shingles) of the texts in pairs; those of known aren't read again."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    if known is not None:
        nodes = nodes.join(known.select(F.col("node").alias("fp")), "fp", "left_anti")
    wanted = staged(distinct.join(nodes, "fp", "left_semi").select("fp", F.col("h").alias("_h")), name)
    wanted = F.broadcast(wanted) if wanted.count() <= SMALL else wanted.hint("shuffle_hash")

    @F.pandas_udf("array<long>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([shingles(t).view(np.int64) for t in part], dtype=object)

    held = texts.join(wanted, F.col("h") == F.col("_h")).select(F.col("fp").alias("node"), found("text").alias("shingles"))
    new = staged(held.groupBy("node").agg(F.first("shingles").alias("shingles")), f"{name}-shingles")
    return new if known is None else known.unionByName(new)


def _index_pairs(known: DataFrame, bits: int) -> DataFrame:
    """(fp, chain, size, check, more, parts) to rows (u, v, a, b): texts u < v of the chains a and
    b that meet under a key; and to rows with no v: u is one of the group of a dense key.

    One side lies under its values, the other also under those with one more bit.
    Keys that one chain alone holds are dropped, and groups of dense ones set apart, behind
    the same shuffle that joins the others. Whoever lies under a dense key without being
    like the group meets all of it here. Spark would size a side by its rows before they are
    exploded, and broadcast it.
    """
    each = known.select("fp", "chain", "size", "check", "more", F.posexplode("parts").alias("part", "value"))

    def side(bit: int) -> DataFrame:  # the lowest bit of check tells the sides apart
        check = F.col("check").bitwiseAND(F.lit(~1)).bitwiseOR(F.lit(bit))
        keys = _keys(F.col("part"), F.col("value"), 0 if bit else bits)
        return each.select("fp", "chain", "size", check.alias("check"), "more", F.explode(keys).alias("key"))

    w = Window.partitionBy("key")
    marks = {"a": F.min("chain").over(w), "b": F.max("chain").over(w), "all": F.count(F.lit(1)).over(w), "ones": F.sum(F.col("check").bitwiseAND(F.lit(1))).over(w), "lead": F.max(F.struct("size", "chain", "check", "more")).over(w)}
    shared = side(0).union(side(1)).withColumns(marks).filter("a < b")
    alike = _differ("check", "more", "lead.check", "lead.more") <= CORE_BITS
    shared = shared.withColumn("core", (F.col("ones") * (F.col("all") - F.col("ones")) > DENSE) & alike)
    half = lambda bit, x: shared.filter(F.col("check").bitwiseAND(F.lit(1)) == bit).select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("fp", "chain", "check", "more", "core")])
    met = half(0, "l").hint("merge").join(half(1, "r"), "key").filter((F.col("l_chain") != F.col("r_chain")) & ~(F.col("l_core") & F.col("r_core")) & (_differ("l_check", "l_more", "r_check", "r_more") <= CHECK_BITS))
    low = F.col("l_fp") < F.col("r_fp")
    of = lambda x, y, name: F.when(low, F.col(x)).otherwise(F.col(y)).alias(name)
    pairs = met.select(F.least("l_fp", "r_fp").alias("u"), F.greatest("l_fp", "r_fp").alias("v"), of("l_chain", "r_chain", "a"), of("r_chain", "l_chain", "b"))
    none = F.lit(None).cast("long")
    dense = shared.filter("core").select(F.col("fp").alias("u"), none.alias("v"), F.col("chain").alias("a"), none.alias("b"))
    return staged(pairs.union(dense).distinct(), "met")


def _dense_pairs(dense: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, a, check, more, odd) texts of dense groups and their chains to (u, v, a, b): the pairs
    of different chains that can be as similar as SHARE, by an exact prefix filter and exact
    parities. Of so many shingles that parities tell nothing CHECK_BITS holds as well.

    Two such sets share one of the n - ceil(SHARE n) + 1 rarest shingles of each, in any
    fixed order; the smaller set needs fewer. Shingles of one text, or one chain, give no pair,
    and a text that has too many of its own drops out, so many strays around a group cost no
    more than themselves. The first shingle that two sets share leaves only those after it
    to be shared, so its places bound what they share; where one of the BEFORE earlier ones is
    shared too, it isn't the first, and the pair is met there.
    """
    held = dense.join(sets, F.col("u") == F.col("node")).select("u", "a", F.struct("check", "more", "odd").alias("s"), F.size("shingles").alias("n"), F.explode("shingles").alias("x"))
    use = held.groupBy("x").agg(F.count(F.lit(1)).alias("uses"), F.min("a").alias("low"), F.max("a").alias("high"))
    w = Window.partitionBy("u").orderBy("uses", "x")
    ranked = held.join(use, "x").withColumn("place", F.row_number().over(w))
    within = lambda share: F.col("place") <= F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1
    first = ranked.filter(within(SHARE) & (F.col("low") < F.col("high"))).withColumn("before", F.collect_list("x").over(w.rowsBetween(-BEFORE, -1)))
    rare = staged(first.select("u", "a", "n", "x", "s", "place", "before"), "rare")
    side = lambda rows, x: rows.select("x", *[F.col(c).alias(f"{x}_{c}") for c in ("u", "a", "n", "s", "place", "before")])
    ordered = (F.col("l_n") < F.col("r_n")) | ((F.col("l_n") == F.col("r_n")) & (F.col("l_u") < F.col("r_u")))
    left_to_share = 1 + F.least(F.col("l_n") - F.col("l_place"), F.col("r_n") - F.col("r_place"))
    enough = left_to_share >= (F.col("l_n") + F.col("r_n")) * (SHARE / (1 + SHARE)) - 1e-9
    told = (F.col("l_n") + F.col("r_n") < 4 * PARITIES) | (_differ("l_s.check", "l_s.more", "r_s.check", "r_s.more") <= CHECK_BITS)
    # a text's columns stand beside each of its shingles, which Parquet packs to a twentieth
    met = side(rare.filter(within(2 * SHARE / (1 + SHARE))), "l").hint("merge").join(side(rare, "r"), "x")
    met = met.filter((F.col("l_a") != F.col("r_a")) & ordered & enough & _sizes("l_n", "r_n") & _near("l_n", "r_n", "l_s.odd", "r_s.odd") & told & ~F.arrays_overlap("l_before", "r_before"))
    low = F.col("l_u") < F.col("r_u")
    of = lambda x, y, name: F.when(low, F.col(x)).otherwise(F.col(y)).alias(name)
    return met.select(F.least("l_u", "r_u").alias("u"), F.greatest("l_u", "r_u").alias("v"), of("l_a", "r_a", "a"), of("r_a", "l_a", "b")).distinct()


def _roots(fps: DataFrame, texts: DataFrame, bits: int) -> DataFrame:
    """(id, h, fingerprint, n, check, more, odd, parts) to (fp, root); texts (h, text) holds the texts.

    In each whole segment neighbours in the order of sizes are tested first. What these
    links join needs no other test, so the index only gives pairs of different chains, and
    a group of n near copies doesn't give n * n pairs.
    """
    columns = [F.first(c).alias(c) for c in ("n", "check", "more", "odd", "parts")]
    distinct = staged(fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("h").alias("h"), *columns), "distinct")
    able = distinct.filter(F.col("n") >= LEAST)
    cut = able.select("fp", "n", "check", "more", F.posexplode("parts").alias("part", "value"))
    w = Window.partitionBy("part", "value").orderBy("n", "fp")
    after = [F.lead(c).over(w).alias(name) for c, name in (("fp", "v"), ("n", "m"), ("check", "other"), ("more", "other_more"))]
    linked = cut.select(F.col("fp").alias("u"), "n", "check", "more", *after).filter(_sizes("n", "m") & (_differ("check", "more", "other", "other_more") <= CHECK_BITS))
    pairs = staged(linked.select("u", "v").distinct(), "neighbours")
    sets = _sets(pairs, distinct, texts, "neighbours-of")
    chains = staged(connected_components(_alike(pairs, sets)), "chains")

    known = distinct.join(chains, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("chain"), "n", "check", "more", "parts")
    sizes = known.groupBy("chain").agg(F.count(F.lit(1)).alias("size"))
    known = staged(known.join(sizes, "chain"), "chained")
    met = _index_pairs(known.filter(F.col("n") >= LEAST), bits)
    dense = met.filter("v is null").select("u", "a")
    found = met.filter("v is not null")
    of_dense = _sets(dense.select("u", F.col("u").alias("v")), distinct, texts, "dense", sets)
    found = found.union(_dense_pairs(dense.join(distinct.select(F.col("fp").alias("u"), "check", "more", "odd"), "u"), of_dense)).distinct()
    tested = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    left = found.join(tested, ["u", "v"], "left_anti")
    for side, n, odd in (("u", "_n", "_odd"), ("v", "_m", "_other")):
        left = left.join(distinct.select(F.col("fp").alias(side), F.col("n").alias(n), F.col("odd").alias(odd)), side)
    left = staged(left.filter(_sizes("_n", "_m") & _near("_n", "_m", "_odd", "_other")).select("u", "v", "a", "b"), "pairs")
    links = _alike(left, _sets(left, distinct, texts, "pairs-of", of_dense))
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    top = known.select("fp", "chain").join(roots, F.col("chain") == F.col("node"), "left")
    return staged(top.select("fp", F.coalesce("root", "chain").alias("root")), "roots")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each class under links of SHARE or more:
    that of the smallest id (nulls last; then the smallest hash of the text). Of rows that
    share both, one stays. Texts without a word, and null texts, are one class. Of pairs at
    SHARE all but MISS are found, of more similar ones almost all."""
    segments, bits = plan_segments(docs.count())
    mark = fresh(docs, "hash")
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    named = marked.select(F.col(id_col).alias("id"), F.col(mark).alias("h"), F.col(text_col).alias("text"))
    fps = staged(_sketches(named, segments, bits), "sketches")
    return one_per_class(marked, fps.select("id", "h", "fingerprint"), _roots(fps, named.select("h", "text"), bits), id_col, mark)
