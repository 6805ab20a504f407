"""Closest pair across clusters and farthest pair within one (V4) by bounds.

Points lie in balls.  For two balls, the distance of their centers less both
radii bounds the distance of any two of their points from below, the sum of
all three from above.  A first pass measures the pairs of balls that promise
most; a second one only those whose bounds could still change the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sq_euclidean
from ..session import DEFAULT_BROADCAST_BYTES, Scratch
from .center_index import rounding
from .cluster_search import SLICE, squares
from .indices import _pairs_of_clusters
from .pairs import check_points
from .spanning import ball_blocks

#: Pairs of balls that the first pass measures for each of the two results.
FIRST_PASS = 32


def _measured(points: DataFrame, pairs: DataFrame, dim: int, n: int) -> tuple[float | None, float | None]:
    """Least squared distance of points of different clusters, and the largest
    within one, over the given pairs of balls ``(a, b)``.  Balls are hashed into
    groups; two groups of balls meet in a task with the pairs of their balls, so a
    point travels once for each group and not for each pair of balls."""
    groups = max(1, -(-n // max(256, min(16384, n // 16))))
    group = lambda ball: F.pmod(F.xxhash64(ball), F.lit(groups)).cast("int")
    wanted = pairs.select("a", "b", F.least(group("a"), group("b")).alias("bi"), F.greatest(group("a"), group("b")).alias("bj"))
    rows = points.select("id", F.col("cluster").cast("long").alias("cluster"), "features", "blk", group("blk").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        "id", "cluster", "features", "blk", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    met = wanted.select("bi", "bj").distinct()               # at most groups ** 2 / 2 rows
    rows = rows.join(F.broadcast(met), ["bi", "bj"], "left_semi")

    def measure(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("blk")
        balls, ids, clusters = (held[c].to_numpy() for c in ("blk", "id", "cluster"))
        x = held["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        inter, intra = np.inf, -np.inf
        for a, b in zip(asked["a"].to_numpy(), asked["b"].to_numpy()):
            (i, k), (j, m) = ((np.searchsorted(balls, e, "left"), np.searchsorted(balls, e, "right")) for e in (a, b))
            step = max(1, SLICE // max(1, m - j))
            for at in range(i, k, step):
                own = slice(at, min(at + step, k))
                d2 = squares(x[own], x[j:m])
                same = clusters[own, None] == clusters[None, j:m]
                other = ids[own, None] != ids[None, j:m]
                inter = min(inter, d2.min(where=~same & other, initial=np.inf))
                intra = max(intra, d2.max(where=same & other, initial=-np.inf))
        return pa.table({"inter": pa.array([inter if inter < np.inf else None], pa.float64()),
                         "intra": pa.array([intra if intra >= 0 else None], pa.float64())})

    found = wanted.groupBy("bi", "bj").cogroup(rows.groupBy("bi", "bj")).applyInArrow(measure, "inter DOUBLE, intra DOUBLE")
    r = found.agg(F.min("inter").alias("inter"), F.max("intra").alias("intra")).first()
    return r["inter"], r["intra"]


def _ball_pairs(blocks: DataFrame, dim: int) -> DataFrame:
    """``(a, b, least, most, across, within, work)`` for all a <= b: bounds on
    the distance of their points, and whether points of different clusters, or of
    the same one, can meet there (from the range of cluster numbers in each)."""
    cols = ["blk", "center", "radius", "n", "lo", "hi"]
    met = _pairs_of_clusters(blocks, [], "blk", cols, 512).where("blk_a < blk_b").drop("_i", "_j")
    both = blocks.where("n > 1").select(*[F.col(c).alias(f"{c}_a") for c in cols], *[F.col(c).alias(f"{c}_b") for c in cols])
    apart = F.sqrt(sq_euclidean("center_a", "center_b", dim=dim))
    reach: Column = F.col("radius_a") + F.col("radius_b")
    slack = rounding(dim)
    pure = (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b"))
    return met.unionByName(both).select(
        F.col("blk_a").alias("a"), F.col("blk_b").alias("b"),
        (apart - reach - slack * (apart + reach)).alias("least"), ((apart + reach) * (1 + slack)).alias("most"),
        (~pure).alias("across"), ((F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a"))).alias("within"),
        F.when(F.col("blk_a") == F.col("blk_b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(
            F.col("n_a") * F.col("n_b")).alias("work"))


def extreme_pairs(assigned: DataFrame, cluster: str = "cluster", block_points: int | None = None,
                  broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[float | None, float | None, float]:
    """``(inter, intra, share)``: the least squared distance of two points of
    different clusters, the largest of two points of the same one, and the share
    of all pairs of different points that were measured.

    Points of no cluster take no part.  Equal points of a cluster count once;
    their distance 0 is the largest within, if there is no other.  ``inter`` is
    None with one cluster, ``intra`` where every cluster has one point.  Balls
    hold about the square root of the number of points, so there are no more
    pairs of balls than points."""
    rows = assigned.where(F.col(cluster).isNotNull())
    _, dim = check_points(rows)
    scratch = Scratch(assigned.sparkSession, "bounded")
    pts = scratch.put(rows.groupBy(F.col(cluster).alias("cluster"), "features").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "distinct")
    r = pts.agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("copies")).first()
    n = int(r["n"])
    intra = 0.0 if (r["copies"] or 0) > 1 else None
    if n < 2:
        return None, intra, 0.0
    placed, blocks = ball_blocks(pts.select("id", "features"), n, dim, scratch,
                                 block_points or max(64, math.isqrt(n)), broadcast_bytes)
    placed = scratch.put(placed.join(pts.select("id", "cluster"), "id"), "placed")
    ranges = placed.groupBy("blk").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
    pairs = scratch.put(_ball_pairs(scratch.put(blocks.join(ranges, "blk"), "ranges"), dim), "pairs")

    promising = pairs.where("across").orderBy("least", "a", "b").limit(FIRST_PASS).unionByName(
        pairs.where("within").orderBy(F.desc("most"), "a", "b").limit(FIRST_PASS)).select("a", "b", "work").distinct()
    promising = scratch.put(promising, "promising")
    inter, found = _measured(placed, promising, dim, n)
    intra = found if intra is None else max(intra, found or 0.0)

    slack = 1 + rounding(dim)
    closer = F.lit(True) if inter is None else F.col("least") <= math.sqrt(inter) * slack
    farther = F.lit(True) if intra is None else F.col("most") * slack >= math.sqrt(intra)
    left = pairs.where((F.col("across") & closer) | (F.col("within") & farther)).join(
        promising.select("a", "b"), ["a", "b"], "left_anti")
    left = scratch.put(left.select("a", "b", "work"), "left")
    nearer, wider = _measured(placed, left, dim, n)
    work = left.unionByName(promising).agg(F.sum("work")).first()[0] or 0
    least = [d for d in (inter, nearer) if d is not None]
    most = [d for d in (intra, wider) if d is not None]
    for name in ("distinct", "pivots", "nearest", "dealt", "points", "blocks", "placed", "ranges", "pairs", "promising", "left"):
        scratch.drop(name)
    return min(least, default=None), max(most, default=None), float(work) / (n * (n - 1) / 2)


def dunn_min_max_bounded(assigned: DataFrame, cluster: str = "cluster", block_points: int | None = None,
                         broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """V4 -> (inter, intra, dunn_min_max, measured): as ``indices.dunn_min_max``,
    without a table of all pairs; ``measured`` is the share of pairs that the
    bounds left."""
    inter, intra, share = extreme_pairs(assigned, cluster, block_points, broadcast_bytes)
    ratio = inter / intra if inter is not None and intra else None
    return assigned.sparkSession.createDataFrame(
        [(inter, intra, ratio, share)], "inter DOUBLE, intra DOUBLE, dunn_min_max DOUBLE, measured DOUBLE")
