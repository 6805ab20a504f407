"""Exact top-k inner products by Fagin's threshold algorithm.

Each block of rows keeps one list per dimension, sorted by that component.  A
query walks all lists at once, from the large end where its weight is positive
and from the small end where it is negative.  Rows met on the way are scored
in full (random access).  At a depth, no row that was not met can score more
than the sum of weight times the component at that depth; the walk stops when
this bound is below the kth best score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .vectors import finite, nearest_of, search


class Lists:
    """A block's rows, sorted by each component."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable")

    def walk(self, q: np.ndarray, k: int, first: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Rows met, and their scores: they hold the k best and all ties.  A
        step covers as many depths as all before it."""
        n = len(self.x)
        used = np.flatnonzero(q)
        if not len(used):
            return np.arange(n), np.zeros(n, dtype=q.dtype)
        up, down = used[q[used] < 0], used[q[used] > 0]
        met = np.zeros(n, dtype=bool)
        rows, scores = [], []
        depth, step = 0, first
        best = np.zeros(0, dtype=q.dtype)
        while depth < n:
            to = min(n, depth + step)
            seen = np.concatenate((self.order[depth:to, up].ravel(), self.order[n - to:n - depth, down].ravel()))
            new = np.zeros(n, dtype=bool)
            new[seen] = True
            new = np.flatnonzero(new & ~met)
            met[new] = True
            rows.append(new)
            scores.append(self.x[new] @ q)
            best = np.concatenate((best, scores[-1]))
            if len(best) > k:
                best = np.partition(best, len(best) - k)[len(best) - k:]
            bound = (self.x[self.order[to - 1, up], up] @ q[up]) + (self.x[self.order[n - to, down], down] @ q[down])
            if len(best) == k and bound < best.min():
                break
            depth, step = to, to
        return np.concatenate(rows), np.concatenate(scores)


def top_products(points: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k rows of the largest inner product with each query: ``query_id,
    rank, vec_id, score LONG``.  Both tables are ``(id, v ARRAY<LONG>)``; a row
    with the query's id is not in its result.

    Null ids, and vectors that are null or hold a null, take no part; rows that
    repeat another's id and vector count once.  Ties go to the smaller id.  An
    empty table gives an empty result.  Products must fit 63 bits.
    """
    whole = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<long>").alias("v")).where(
        F.col("id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False)))

    def best(x, ids, asked, asked_ids):
        lists = Lists(x)
        for q, own in zip(asked, asked_ids):
            # k + 1: the query's own row may be among them
            at, scores = lists.walk(q, k + 1)
            yield nearest_of(scores, [ids[i] for i in at.tolist()], own, k)

    return search(whole(points), whole(queries), k, "LONG", best, np.int64)


def op10_threshold_topk(spark, sf_dir):
    """The 10 largest integer products of every 100th vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"),
                                                  F.col("embedding").cast("array<double>").alias("v"))
    points = e.where(finite(F.col("v"))).select("id", F.transform("v", lambda x: F.floor(x * 1024)).alias("v"))
    return top_products(points, points.where("id % 100 = 0"), 10)


#: Brute force: every query against every row.
ORACLE = """
WITH p AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE)))
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM p AS q JOIN p ON q.vec_id <> p.vec_id AND len(q.v) = len(p.v) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
