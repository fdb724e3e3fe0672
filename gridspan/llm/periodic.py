"""Periodic runs of words by harmonic grid probing.

A run of period p that is 3p words long or longer holds three grid points jp, (j+1)p and
(j+2)p whose words are equal. All grids of a text have n / 1 + n / 2 + n / 3 + ... points,
so n log n probes find every run. What survives is compared word by word, in chunks of
growing length, and then extended to both sides; grid points within runs that are already
known aren't looked at again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .hashing import PRINTED, hashed_spans

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Probes, and words compared for all survivors, at a time.
TOGETHER = 1 << 20
#: Bytes of text that a task holds beside one that is longer.
TEXT_BYTES = 1 << 22

Run = tuple[int, int, int]


def _grid(n: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(at, period) of all grid points of the periods low to high - 1 with two more behind
    them, TOGETHER at a time or those of one period."""
    periods = np.arange(low, min(high, (n - 1) // 2 + 1))
    points = (n - 1) // periods - 1
    cuts = np.searchsorted(np.cumsum(points), np.arange(TOGETHER, points.sum() + TOGETHER, TOGETHER), side="left") + 1
    for a, b in zip([0, *cuts], cuts, strict=False):
        p, c = periods[a:b], points[a:b]
        if len(p):
            each = np.repeat(p, c)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(c) - c, c)
            yield nth * each, each


def _reach(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How far from at, in steps of 1 or -1, each word equals the one a period on."""
    n, done, chunk = len(words), 0, 64
    room = n - period - at if step > 0 else at + 1
    while done < room:
        size = min(chunk, room - done)
        low = at + done if step > 0 else at - done - size + 1
        differ = np.flatnonzero(words[low : low + size] != words[low + period : low + period + size])
        if len(differ):
            return done + int(differ[0] if step > 0 else size - 1 - differ[-1])
        done += size
        chunk = min(4 * chunk, 1 << 16)
    return done


def _squares(words: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid points from which a whole period is repeated, tested a chunk at a time."""
    done, chunk = 0, 8
    while len(at) and done < period.max():
        keep = np.ones(len(at), bool)
        for k in range(0, len(at), max(1, TOGETHER // chunk)):
            part = slice(k, k + max(1, TOGETHER // chunk))
            place = at[part, None] + np.minimum(np.arange(done, done + chunk), period[part, None])
            keep[part] = (words[place] == words[place + period[part, None]]).all(1)
        at, period = at[keep], period[keep]
        done += chunk
        chunk *= 4
    return at, period


def runs_of(words: np.ndarray) -> list[Run]:
    """(start, length, period) of every run, by start, then period. words are numbers, equal
    for equal words; a period is the smallest that its stretch has.

    Periods go up by octaves. A stretch whose period is a multiple of a smaller one lies
    within that one's run: it is passed over where that run is known, and of one octave no
    period is a multiple of another.
    """
    n, found = len(words), []
    if n < LEAST_WORDS:
        return found
    low = 1
    while LEAST_PERIODS * low <= n:
        starts = np.array([s for s, *_ in found], np.int64)
        reach = np.maximum.accumulate(np.array([s + size for s, size, _ in found], np.int64)) if found else starts
        for at, period in _grid(n, low, min(2 * low, n // LEAST_PERIODS + 1)):
            same = (words[at] == words[at + period]) & (words[at + period] == words[at + 2 * period])
            at, period = at[same], period[same]
            if found and len(at):
                nth = np.searchsorted(starts, at, side="right") - 1
                inside = (nth >= 0) & (reach[np.maximum(nth, 0)] > at + 2 * period) if len(starts) else np.zeros(len(at), bool)
                at, period = at[~inside], period[~inside]
            at, period = _squares(words, at, period)
            known = (0, 0)
            for i, p in zip(at.tolist(), period.tolist(), strict=True):
                if p == known[0] and i + 2 * p < known[1]:
                    continue
                start = i - _reach(words, i - 1, p, -1) if i else 0
                end = i + _reach(words, i, p, 1) + p
                known = (p, end)
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
                    found.append((start, end - start, p))
        found.sort(key=lambda r: (r[0], r[2]))
        low *= 2
    return found


def best_run(runs: list[Run]) -> Run | None:
    """The run of the greatest length over period; of equals the first, then that of the smallest period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """For each word whether no run repeats it: those of a run's first period stay."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word each word of a text of n words becomes, for the tenth of the texts
    whose tail is made periodic; None for all others. A null doc_id counts as empty text."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % p
    return order


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """For each row of docs id_col (long), n_runs, start, length, period, exponent_milli (of
    the run with the greatest exponent; null without one), runs (an array of them all) and
    collapsed (the text without repetitions, its words joined by one space), both whole.

    Null texts are empty: no runs, an empty collapsed text. Null ids, repeated rows and
    other columns of any name do no harm; an empty table gives an empty one. One text is
    looked at by one task, with some 100 bytes a word. plant changes texts as planted() says.
    Words are compared by 64-bit hashes of their bytes.
    """
    schema = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    kind = pa.schema([("id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4096, TEXT_BYTES):
                rows = []
                for doc_id, text in zip(part.column("id").to_pylist(), part.column("text"), strict=True):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    words, hashes = data.split(), hashed_spans(data, PRINTED)[2]
                    order = planted(doc_id, len(words)) if plant else None
                    runs = runs_of(hashes if order is None else hashes[order])
                    if order is not None or runs:
                        order = np.arange(len(words)) if order is None else order
                        words = [words[i] for i in order[kept_words(len(words), runs)]]
                    top = best_run(runs) or (None, None, None)
                    rows.append((doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(words).decode("utf-8", "surrogatepass")))
                columns = zip(*rows, strict=True) if rows else [[]] * len(kind)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    found = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(look, schema)
    return found.withColumnRenamed("id", id_col)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
