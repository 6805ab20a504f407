"""What the two vector searches share: checked vectors, identical vectors as
one candidate, and the search of query blocks against row blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for

ROWS_A_BLOCK, QUERIES_A_BLOCK = 2048, 4096


def finite(v: Column) -> Column:
    """A vector that is not null and has only finite components."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok, F.lit(False))


def candidates(points: DataFrame, k: int) -> DataFrame:
    """``(id, v)`` -> ``(v, ids)``: each different vector with its k + 1
    smallest ids, the most that can reach any query's result.  A vector that
    millions of rows share shrinks to these before the shuffle."""
    smallest = Window.partitionBy("v").orderBy("id")
    few = points.withColumn("r", F.dense_rank().over(smallest)).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)


def nearest_of(scores: np.ndarray, ids: list, own: int, k: int) -> list[tuple[int, object]]:
    """The k best ``(id, score)`` but the query's own id; ties by id.  ``ids``
    lists the ids of each scored vector."""
    if len(scores) > k + 1:
        least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    found = [(-scores[i], x) for i in at.tolist() for x in ids[i] if x != own]
    return [(x, -s) for s, x in sorted(found)[:k]]


def search(points: DataFrame, queries: DataFrame, k: int, kind: str,
           best: Callable[[np.ndarray, list, np.ndarray, list], Iterator[list[tuple[int, object]]]],
           dtype=np.float64) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``(id, v)`` tables.

    Rows lie in hash blocks of a fixed size; every block of queries meets every
    block of rows, the only pairing that an exact or radius search of a stated
    query set needs.  ``best`` gets a block's vectors and ids and a block of
    queries, and yields each query's k best there; the k best of all blocks are
    ranked.  Only vectors of equal length meet.
    """
    n, m = points.count(), queries.count()
    rows_in, queries_in = blocks_for(n, ROWS_A_BLOCK), blocks_for(m, QUERIES_A_BLOCK)
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = candidates(points, k).select("ids", "v", F.size("v").alias("dim"),
                                        F.pmod(F.xxhash64("v"), F.lit(rows_in)).cast("int").alias("rb"),
                                        every(queries_in).alias("qb"))
    asked = queries.distinct().select("id", "v", F.size("v").alias("dim"),
                                      F.pmod(F.xxhash64("id"), F.lit(queries_in)).cast("int").alias("qb"),
                                      every(rows_in).alias("rb"))
    out = pa.schema([("query_id", pa.int64()), ("part", pa.int64()), ("vec_id", pa.int64()),
                     ("score", pa.int64() if kind == "LONG" else pa.float64())])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        asked_ids, asked_v = right.column("id").to_pylist(), matrix(right.column("v"), dtype)
        # the same id may ask with several vectors: each is a search of its own
        parts = right.column("part").to_pylist()
        found = best(matrix(left.column("v"), dtype), left.column("ids").to_pylist(), asked_v, asked_ids)
        hits = [(q, p, x, s) for q, p, own in zip(asked_ids, parts, found) for x, s in own]
        columns = zip(*hits) if hits else [()] * 4
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    asked = asked.withColumn("part", F.xxhash64("v"))
    hits = (rows.groupBy("dim", "qb", "rb").cogroup(asked.groupBy("dim", "qb", "rb"))
            .applyInArrow(block, f"query_id LONG, part LONG, vec_id LONG, score {kind}"))
    order = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
