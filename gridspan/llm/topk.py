"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks. A task takes one block of queries and one block of
vectors, keeps the block's components as one sorted list per dimension and reads these
lists from the end that a query favours, deeper and deeper. What no list has shown yet
scores at most the sum of the last components seen; when the k-th best score beats that
bound, the block is done. A ranked window merges the blocks.

The lists are those of the principal axes of all vectors, on which the first few
components hold most of what a score can be, if the data have any structure at all.
Scores are always made of the whole-number components; the rotated ones only bound them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

QUERY_BLOCK = 2048
VECTOR_BLOCK = 4096
#: Entries read from each list before the first test of the bound; each next test reads four times as deep.
FIRST_DEPTH = 16
#: A query reads the lists that hold so much of what its score can vary by; the others count
#: with their greatest component.
FOCUS = 0.9
#: What rounding may take off a bound, relative to the greatest score that could be.
ROUNDING = 1e-9


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, repeats: bool = False) -> DataFrame:
    """(id, v): floor(scale * x) of every component x as a long.

    Null ids, null vectors and vectors that hold null or a non-finite component take no
    part. With repeats, repeated ids and rows stay; else of rows with the same id the
    smallest vector counts.
    """
    x = F.col(vector_col)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & sound)
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))
    return found if repeats else found.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows of one width; a shorter vector counts as ended by zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _exact(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In a type that holds every inner product: doubles (fast) below 2 ** 53, else Python's integers."""
    most = lambda m: float(np.abs(m.astype(float)).max(initial=0))
    kind = np.float64 if most(queries) * most(vectors) * max(1, queries.shape[1]) < 2**53 else object
    return queries.astype(kind), vectors.astype(kind)


def principal_axes(vectors: DataFrame) -> np.ndarray:
    """Columns are the axes of the vectors' second moments, the longest first. Tasks sum
    products of components, and one matrix of their number squared reaches the driver."""

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((0, 0))
        for part in parts:
            width = max([len(total), *part["v"].map(len)])
            m = _matrix(part["v"], width).astype(float)
            total = np.pad(total, (0, width - len(total))) + m.T @ m
        at = np.indices(total.shape).reshape(2, -1)
        yield pd.DataFrame({"i": at[0], "j": at[1], "m": total.ravel()})

    sums = vectors.select("v").mapInPandas(moments, "i long, j long, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).toPandas()
    width = int(sums["i"].max()) + 1 if len(sums) else 0
    table = np.zeros((width, width))
    table[sums["i"], sums["j"]] = sums["m"]
    return np.linalg.eigh(table)[1][:, ::-1] if np.isfinite(table).all() else np.eye(width)


def threshold_topk(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, axes: np.ndarray | None = None, tally: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best among vectors; a row never meets its own
    id, and ties go to the row that comes first. tally, if given, gets the number of rows
    scored for each query."""
    n, found = len(ids), []
    axes = np.eye(queries.shape[1]) if axes is None else axes
    turned, asked = vectors @ axes, queries @ axes
    lists = np.argsort(turned, axis=0, kind="stable")
    values = np.take_along_axis(turned, lists, 0)
    depths = [n]
    while depths[0] > FIRST_DEPTH:
        depths.insert(0, max(FIRST_DEPTH, depths[0] // 4))
    up, down = np.maximum(asked, 0), np.minimum(asked, 0)
    slack = ROUNDING * (np.abs(asked) @ np.abs(turned).max(0, initial=0.0)) + ROUNDING
    weights = np.abs(asked) * turned.std(0)
    order = np.argsort(-weights, axis=1)
    before = np.cumsum(np.take_along_axis(weights, order, 1), axis=1) - np.take_along_axis(weights, order, 1)
    read = np.zeros(asked.shape, bool)
    np.put_along_axis(read, order, before < FOCUS * weights.sum(1, keepdims=True), 1)
    unread = (up * ~read) @ values[n - 1] + (down * ~read) @ values[0] + slack
    bounds = [(up * read) @ values[n - r] + (down * read) @ values[r - 1] + unread for r in depths]
    queries, vectors = _exact(queries, vectors)
    for at, (own, q) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
        high, low = np.flatnonzero((asked[at] > 0) & read[at]), np.flatnonzero((asked[at] < 0) & read[at])
        known = np.zeros(n, bool)
        best, scores, before = np.zeros(0, np.int64), np.zeros(0, queries.dtype), 0
        for depth, bound in zip(depths, bounds, strict=True):
            shown = np.zeros(n, bool)
            if depth == n:
                shown[:] = True
            else:
                shown[lists[n - depth : n - before, high].ravel()] = True
                shown[lists[before:depth, low].ravel()] = True
            shown &= ~known
            known |= shown
            fresh = np.flatnonzero(shown)
            fresh = fresh[ids[fresh] != own]
            if len(fresh):
                best, scores = np.concatenate((best, fresh)), np.concatenate((scores, vectors[fresh] @ q))
                if len(best) > k:
                    if scores.dtype != object and len(best) > 4 * k:  # all that reach the k-th, ties included
                        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                        best, scores = best[near], scores[near]
                    order = np.lexsort((best, -scores))[:k]
                    best, scores = best[order], scores[order]
            if len(best) == k and float(scores.min()) > bound[at]:
                break
            before = depth
        if tally is not None:
            tally.append(int(known.sum()))
        found += [(own, int(ids[i]), int(s)) for i, s in zip(best, scores, strict=True)]
    return found


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors (id, v) and those of them that are queries to (query_id, rank, vec_id, score):
    the k highest inner products of each query with every other row, all if there are fewer.

    A column row tells rows of one id apart; without it ids do. Every pair of a query block
    and a vector block is one task's work, of bounded size; both tables move once for every
    block of the other. Ties go to the smaller id. Without queries or vectors the result is
    empty.
    """
    n_queries, n = queries.count(), vectors.count()
    if not n_queries or not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    axes = vectors.sparkSession.sparkContext.broadcast(principal_axes(vectors))
    q_blocks, v_blocks = -(-n_queries // QUERY_BLOCK), -(-n // VECTOR_BLOCK)
    row = F.col("row" if "row" in vectors.columns else "id").alias("row")
    block = lambda blocks: F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select(row, "id", "v", block(q_blocks).alias("q"), every(v_blocks).alias("b"))
    right = vectors.select(row, "id", "v", block(v_blocks).alias("b"), every(q_blocks).alias("q"))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(asked) and len(held):
            held, turn = held.sort_values(["id", "row"]), axes.value
            out = threshold_topk(asked["row"].to_numpy(), _matrix(asked["v"], len(turn)), held["row"].to_numpy(), _matrix(held["v"], len(turn)), k, turn)
        found = pd.DataFrame(out, columns=["query_row", "row", "score"]).astype("int64")
        return found.assign(query_id=found["query_row"].map(asked.set_index("row")["id"]), vec_id=found["row"].map(held.set_index("row")["id"])).drop(columns="row").astype("int64")

    tops = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInPandas(search, "query_row long, score long, query_id long, vec_id long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def numbered(vectors: DataFrame) -> DataFrame:
    """(id, v) as a table with row, a number for each row."""
    return staged(vectors.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = numbered(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), repeats=True))
    return exact_topk(vectors, vectors.filter("id % 20 = 0"), 20)


ORACLE = {
    "op3_exact_topk": """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
""",
}
