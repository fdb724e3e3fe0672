"""Phrase collocations by level-wise passes.

Pass k counts phrases of k words. Only those go out to be counted whose first and whose
last k - 1 words are both frequent phrases, which the tasks know from a broadcast of the
pass before. Pairs, by far the most, go out as hashes first; from then on, only the
stretches of text are read that frequent pairs cover. Cuts of a phrase are scored from the tables of the levels, as all parts of a
frequent phrase are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, slices, staged, text_or_empty
from .hashing import BASE, hashed_spans, mix

LONGEST = 5
LEAST = 100
TOP = 2000
#: A phrase is dropped for a longer one around it that has this percentage of its occurrences.
SHARE = 100
#: Bytes of text that a task holds at a time beside one that is longer.
TEXT_BYTES = 1 << 21
#: The broadcast of frequent phrases: bits of a filter for each, at least and at most (32 MB),
#: and their hashes if there are so few (16 MB). With more of them some phrases go out whose
#: parts aren't frequent; they are counted like others and are as rare as their parts.
BITS_EACH, LEAST_BITS, MOST_BITS, LISTED = 64, 1 << 20, 1 << 28, 1 << 21
#: The best of a language are taken within so many shares of it first.
SHARES = 64

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\v\f\r")] = True
_INSIDE = ~_BREAKS
_INSIDE[list(b" \t")] = False


class _Frequent:
    """Which phrases of one length are frequent, in a size that doesn't grow with them."""

    def __init__(self, level: DataFrame) -> None:
        n = level.count()
        size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length()))
        self.bits = np.zeros(size // 64, np.uint64)
        place = F.pmod("h", F.lit(size))
        words = level.select(F.shiftrightunsigned(place, 6).alias("word"), (place % 64).cast("int").alias("nth")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, nth))").alias("bits"))
        for part in words.toArrow().to_batches():
            self.bits[part.column("word").to_numpy()] = part.column("bits").to_numpy().view(np.uint64)
        self.listed = np.sort(level.select("h").toArrow().column("h").to_numpy()).view(np.int64) if n <= LISTED else None

    def __call__(self, h: np.ndarray) -> np.ndarray:
        place = h % np.uint64(64 * len(self.bits))
        out = (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        if self.listed is not None and len(self.listed):
            at = np.flatnonzero(out)
            mine = h[at].view(np.int64)
            out[at] = self.listed[np.minimum(np.searchsorted(self.listed, mine), len(self.listed) - 1)] == mine
        return out


class _Words:
    """The words of some texts: their hashes, which of them follow one in the same piece, and
    their places in the texts with one space between words."""

    def __init__(self, langs: list[str], texts: list[bytes]) -> None:
        data = b"\n".join(texts).lower()
        starts, ends, self.hashes = hashed_spans(data, _INSIDE)
        raw = np.frombuffer(data, np.uint8)
        breaks = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_BREAKS[raw], out=breaks[1:])
        self.joined = breaks[starts[1:]] == breaks[ends[:-1]]
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        known = {lang: xxhash.xxh64_intdigest(lang) for lang in set(langs)}
        self.lang = np.array([known[x] for x in langs], np.uint64)[self.text]
        spaced, keep = raw.copy(), _INSIDE[raw]
        behind = ends[ends < len(raw)]
        spaced[behind], keep[behind] = 32, True
        self.spaced = spaced[keep].tobytes()
        sizes = ends - starts
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the phrases of k words from every word on, and whether they lie in one piece."""
        n = max(0, len(self.hashes) - k + 1)
        h, whole = self.lang[:n], np.ones(n, bool)
        for j in range(k):
            h = mix(h * np.uint64(BASE) + self.hashes[j : j + n])
            if j:
                whole &= self.joined[j - 1 : j - 1 + n]
        return h, whole

    def phrases(self, at: np.ndarray, k: int) -> list[str]:
        spaced = self.spaced
        return [spaced[a:b].decode("utf-8", "surrogatepass") for a, b in zip(self.start[at].tolist(), self.end[at + k - 1].tolist(), strict=True)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, _Words]]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 16, TEXT_BYTES):
            langs = part.column("lang").to_pylist()
            yield langs, part.column("weight").to_numpy(), _Words(langs, [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()])


_COUNTED = "lang string, phrase string, h long, f long"
_STRETCH = "lang string, text string, weight long"


def _summed(langs: list[str], weights: np.ndarray, words: _Words, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of phrases that begin at these words: one place of each distinct key, its language, and the weights of all."""
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    text = words.text[at]
    sums = np.bincount(of, weights=weights[text], minlength=len(first)).astype(np.int64)
    return first, [langs[i] for i in text[first].tolist()], sums


def _pass(texts: DataFrame, k: int, frequent: _Frequent | None) -> DataFrame:
    """(lang, phrase, h, f) of phrases of k words whose parts are frequent (None: whatever they
    are); for single words also a row without a phrase, with all words of a language."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, weights, words in _read(batches):
            h, whole = words.grams(k)
            if held.value is not None:
                parts, fits = words.grams(k - 1)
                fits[fits] = held.value(parts[fits])
                whole &= fits[:-1] & fits[1:]
            at = np.flatnonzero(whole)
            h = h[at]
            first, names, sums = _summed(langs, weights, words, at, h)
            columns = [names, words.phrases(at[first], k), h[first].view(np.int64), sums]
            if k == 1:
                total: dict[str, int] = {}
                for name, n in zip(names, sums.tolist(), strict=True):
                    total[name] = total.get(name, 0) + n
                columns = [[*names, *total], [*columns[1], *[None] * len(total)], np.append(columns[2], np.zeros(len(total), np.int64)), np.append(sums, np.fromiter(total.values(), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["lang", "phrase", "h", "f"])

    return texts.mapInArrow(count, _COUNTED).groupBy("lang", "phrase").agg(F.max("h").alias("h"), F.sum("f").alias("f"))


def _pairs(texts: DataFrame, frequent: _Frequent) -> DataFrame:
    """(h, f) of pairs of frequent words, by their hash alone."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, weights, words in _read(batches):
            h, whole = words.grams(2)
            fits = held.value(words.grams(1)[0])
            at = np.flatnonzero(whole & fits[:-1] & fits[1:])
            first, _, sums = _summed(langs, weights, words, at, h[at])
            yield pa.RecordBatch.from_arrays([pa.array(h[at[first]].view(np.int64)), pa.array(sums)], ["h", "f"])

    return texts.mapInArrow(count, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def _stretches(texts: DataFrame, pairs: _Frequent) -> DataFrame:
    """(lang, text, weight): the longest parts of texts in which all neighbours are frequent pairs."""
    held = texts.sparkSession.sparkContext.broadcast(pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, weights, words in _read(batches):
            h, whole = words.grams(2)
            whole[whole] = held.value(h[whole])
            edges = np.flatnonzero(np.diff(whole.astype(np.int8), prepend=0, append=0))
            start, size = edges[::2], edges[1::2] - edges[::2]
            key = words.lang[start] + size.astype(np.uint64)
            for j in range(int(size.max(initial=0)) + 1):
                some = np.flatnonzero(size >= j)
                key[some] = mix(key[some] * np.uint64(BASE) + words.hashes[start[some] + j])
                if len(some) < 16:  # a few long ones aren't worth merging
                    key[some] += start[some].astype(np.uint64)
                    break
            first, names, sums = _summed(langs, weights, words, start, key)
            ends = words.end[start[first] + size[first]].tolist()
            out = [words.spaced[a:b].decode("utf-8", "surrogatepass") for a, b in zip(words.start[start[first]].tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string()), pa.array(sums, pa.int64())], ["lang", "text", "weight"])

    return texts.mapInArrow(cut, _STRETCH)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """levels (lang, phrase, words, f) of all phrases of up to longest words that occur least
    times or more in a language, and totals (lang, n) with the words of each language.

    Phrases lie within pieces of text between . , ; : ! ? and line ends; words are parted by
    blanks and tabs, A-Z in lower case. Null languages are und, null texts empty; repeated
    rows count as often as they occur, other columns aren't read.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"), F.lit(1).cast("long").alias("weight"))
    found = staged(_pass(texts, 1, None).filter((F.col("f") >= least) | F.col("phrase").isNull()), "words")
    totals = found.filter("phrase is null").select("lang", F.col("f").alias("n"))
    level = found.filter("phrase is not null")
    out = level.select("lang", "phrase", F.lit(1).alias("words"), "f")
    if longest > 1:
        pairs = staged(_pairs(texts, _Frequent(level)).filter(F.col("f") >= least), "pairs")
        texts = staged(_stretches(texts, _Frequent(pairs)), "stretches")
    for k in range(2, longest + 1):
        level = staged(_pass(texts, k, _Frequent(level) if k > 2 else None).filter(F.col("f") >= least), f"phrases-{k}")
        out = out.unionByName(level.select("lang", "phrase", F.lit(k).alias("words"), "f"))
    return out, totals


def scored_cuts(levels: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, low, a, n) of every phrase of two words or more; low (score, k, l, r) is
    its lowest cut, after k words: floor(1000 a n / (l r)) in decimals, exact to 38 digits."""
    parts = F.split("phrase", " ", -1)
    cut = levels.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", parts.alias("p"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("p", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("p", F.col("k") + 1, F.col("words")), " ").alias("right"))
    of = lambda side, name: levels.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cut = cut.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))")
    return cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"), F.first("a").alias("a"), F.first("n").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, share: int = SHARE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first top phrases (None:
    all, without a rank) by the score of their lowest cut, then a, then phrase.

    Phrases inside a longer one that has share percent of their occurrences are dropped.
    """
    levels, totals = frequent_phrases(docs, least, longest, text_col, lang_col)
    scored = scored_cuts(levels, totals)
    longer = levels.filter("words > 2").select("lang", F.col("f").alias("a"), "words", F.split("phrase", " ", -1).alias("p"))
    inner = longer.select("lang", "a", "p", "words", F.explode(F.expr("sequence(2, words - 1)")).alias("m")).select("lang", "a", "p", "m", F.explode(F.expr("sequence(1, words - m + 1)")).alias("at"))
    around = inner.select("lang", "a", F.array_join(F.slice("p", F.col("at"), F.col("m")), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("around") < share * F.col("a"), F.lit(True)))
    rows = kept.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    if top is None:
        return rows
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    dealt = fresh(rows, "dealt")
    some = rows.withColumn(dealt, F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    for part in (["lang", dealt], ["lang"]):
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return some.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op12_collocations": r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY ALL),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS p FROM f WHERE k > 1),
u AS (SELECT lang, phrase, a, k, p, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, x.f AS l, y.f AS r, n, 1000 * u.a * n // (x.f * y.f) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(p[1 : cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(p[cut + 1 :], ' ') JOIN n ON n.lang = u.lang),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
v AS (SELECT lang, array_to_string(p[i : i + m - 1], ' ') AS phrase, max(a) AS around FROM (SELECT lang, a, p, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
z AS (SELECT o.*, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank FROM o LEFT JOIN v ON v.lang = o.lang AND v.phrase = o.phrase WHERE nth = 1 AND (around IS NULL OR 100 * around < 100 * a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z WHERE rank <= 2000""",
}
