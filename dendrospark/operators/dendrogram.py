"""Dendrogram queries (D1-D4) by pointer doubling.

A merge table is a forest of ``child -> parent`` edges in which a parent's
id is always larger than its children's.  The topmost ancestor of every
node is found by repeatedly replacing a node's pointer with its pointer's
pointer: ceil(log2(depth)) joins, each over the edge table, instead of one
pass per merge.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_BYTES, Scratch, fits_broadcast


def child_parent(merges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return (merges.select(*keys, F.col("point1").alias("node"), F.col("cluster").alias("up"))
            .unionByName(merges.select(*keys, F.col("point2").alias("node"), F.col("cluster").alias("up"))))


def root_of(edges: DataFrame, scratch: Scratch, keys: list[str] | None = None,
            hot_fraction: float = 0.05, broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
            add: str | None = None) -> DataFrame:
    """Topmost ancestor ``(keys..., node, up)`` of every node of a
    ``(keys..., node, up)`` forest; ``add`` names a column that is added up
    along the way to it.

    A table that fits the broadcast limit is joined with a broadcast of itself.
    Beyond it, as pointers double, many nodes come to point at the same
    ancestor, so the join on ``up`` grows a hot key (up to every row).  Each
    step therefore splits it: targets holding more than ``hot_fraction`` of the
    rows (at most 1/hot_fraction of them, a proven bound) are resolved through a
    broadcast of their own few rows; only the rest go through the shuffle
    join."""
    keys = keys or []
    tag = f"jump-{uuid.uuid4().hex[:8]}"
    seen = Observation()
    own = ["node", "up", *([add] if add else [])]
    more = [F.col(add).alias("more")] if add else []
    summed = [(F.col(add) + F.coalesce("more", F.lit(0))).alias(add)] if add else []
    p = scratch.put(edges.select(*keys, *own).observe(seen, F.count(F.lit(1)).alias("n")), f"{tag}-0")
    rows, i = seen.get["n"], 0
    while True:
        q = p.select(*keys, F.col("node").alias("up"), F.col("up").alias("up2"), *more)
        if fits_broadcast(rows, 32 + 16 * len(keys), broadcast_bytes):
            # two steps in one job
            on = p.join(F.broadcast(q), [*keys, "up"], "left").select(*keys, "node", F.coalesce("up2", "up").alias("up"), *summed)
            q = on.select(*keys, F.col("node").alias("up"), F.col("up").alias("up2"), *more)
            joined = on.join(F.broadcast(q), [*keys, "up"], "left")
        else:
            hot = (p.groupBy(*keys, "up").agg(F.count(F.lit(1)).alias("cnt"))
                   .where(F.col("cnt") > max(1, int(rows * hot_fraction)))
                   .select(*keys, "up", F.lit(True).alias("hot")))
            hot_b = F.broadcast(scratch.put(hot.coalesce(1), f"{tag}-hot-{i}"))      # <= 1/hot_fraction rows
            tagged = p.join(hot_b, [*keys, "up"], "left")
            hot_q = F.broadcast(q.join(hot_b, [*keys, "up"]).drop("hot"))
            cold = (tagged.where(F.col("hot").isNull()).drop("hot")
                    .join(q.join(hot_b, [*keys, "up"], "left_anti"), [*keys, "up"], "left"))
            warm = tagged.where(F.col("hot")).drop("hot").join(hot_q, [*keys, "up"], "left")
            joined = cold.unionByName(warm)
        i += 1
        seen = Observation()
        step = joined.select(*keys, "node", F.coalesce("up2", "up").alias("up"), *summed, F.col("up2").isNotNull().alias("moved"))
        step = step.observe(seen, F.count_if("moved").alias("moved"))
        p = scratch.put(step.select(*keys, *own), f"{tag}-{i}")
        scratch.drop(f"{tag}-{i - 1}")
        scratch.drop(f"{tag}-hot-{i - 1}")
        if seen.get["moved"] == 0:
            return p


def check_level(merges: DataFrame, n: int, k: int, model: str | None = None, models: list | None = None) -> None:
    tops = merges.groupBy(*([model] if model else [])).agg(F.max("cluster").alias("top"))
    found = tops.agg(F.min("top").alias("top"), F.count("top").alias("models")).first()
    have = 0 if found["models"] < len(models or [0]) else int(found["top"]) - n
    if k < 1 or n - k > have:
        raise ValueError(
            f"cannot cut at k={k}: the merge table holds {have} merges of {n} points "
            f"(lowest reachable k is {n - have})")


def cut(merges: DataFrame, n: int, k: int, scratch: Scratch | None = None, model: str | None = None,
        models: list | None = None) -> DataFrame:
    """``([model,] id, cluster)`` after the first n-k merges; a point untouched
    by them keeps its own id.  ``model`` names a column that tells the merge
    tables of ``models``, all of n points, apart: they are cut together."""
    spark = merges.sparkSession
    check_level(merges, n, k, model, models)
    scratch = scratch or Scratch(spark, "cut")
    keys = [model] if model else []
    sub = merges.where(F.col("cluster") <= 2 * n - k)
    roots = root_of(child_parent(sub, keys), scratch, keys).withColumnRenamed("node", "id")
    pts = spark.range(1, n + 1)
    if model:
        kind = merges.schema[model].dataType
        pts = pts.withColumn(model, F.explode(F.array(*[F.lit(m).cast(kind) for m in models])))
    return (pts.join(roots, [*keys, "id"], "left")
            .select(*keys, "id", F.coalesce("up", "id").alias("cluster")))


def cut_levels(merges: DataFrame, n: int, ks: list[int], scratch: Scratch | None = None,
               model: str | None = None, models: list | None = None) -> DataFrame:
    """D4 for many K, and models as in ``cut``, at once -> ``([model,] k, id, cluster)``.

    One pointer-doubling cut at the largest K; every smaller K differs from
    it only by the last k_max - k merges, a table bounded by the K range,
    resolved with its own (tiny) pointer doubling and broadcast."""
    spark = merges.sparkSession
    ks = sorted(set(int(k) for k in ks))
    kmax, kmin = ks[-1], ks[0]
    check_level(merges, n, kmin, model, models)
    scratch = scratch or Scratch(spark, "cut-levels")
    keys = [model] if model else []
    base = cut(merges, n, kmax, scratch, model, models)
    klist = F.array(*[F.lit(k) for k in ks])
    top = merges.where((F.col("cluster") > 2 * n - kmax) & (F.col("cluster") <= 2 * n - kmin))
    top_edges = (child_parent(top, keys)
                 .withColumn("k", F.explode(klist))
                 .where(F.col("up") <= F.lit(2 * n) - F.col("k")))
    mapping = root_of(top_edges, scratch, keys=[*keys, "k"])
    mapping = mapping.select(*keys, "k", F.col("node").alias("c0"), F.col("up").alias("top"))
    # at most two rows for each model, level and merge between the levels
    if fits_broadcast(2 * (kmax - kmin) * len(ks) * len(models or [0]), 48):
        mapping = F.broadcast(mapping)
    lab = base.select(*keys, "id", F.col("cluster").alias("c0")).withColumn("k", F.explode(klist))
    return (lab.join(mapping, [*keys, "k", "c0"], "left")
            .select(*keys, "k", "id", F.coalesce("top", "c0").alias("cluster")))


def cluster_members(merges: DataFrame, n: int, cluster: int,
                    scratch: Scratch | None = None) -> DataFrame:
    """The leaves below ``cluster`` -> ``(cluster, id)``: those in its
    interval of the Euler tour.  ``tree.tour`` and ``tree.members`` answer many
    questions from one tour."""
    from .tree import tour
    spark = merges.sparkSession
    if cluster <= n:
        return spark.createDataFrame([(cluster, cluster)], "cluster LONG, id LONG")
    places = tour(merges, n, scratch or Scratch(spark, "members"))
    span = places.where(F.col("node") == cluster).select(
        F.col("node").alias("cluster"), F.col("root").alias("of"), F.col("first").alias("lo"), F.col("size").alias("width"))
    within = (F.col("root") == F.col("of")) & (F.col("first") >= F.col("lo")) & (F.col("first") < F.col("lo") + F.col("width"))
    # one row: a range condition on every leaf
    return places.where(F.col("node") <= n).join(F.broadcast(span), within).select("cluster", F.col("node").alias("id"))


def cluster_of(points: DataFrame, base: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """D3: topmost ancestor of every point within a ``(child, cluster)``
    table; a point absent from it is its own cluster -> ``(id, cluster)``."""
    spark = points.sparkSession
    scratch = scratch or Scratch(spark, "cluster-of")
    roots = root_of(base.select(F.col("child").alias("node"), F.col("cluster").alias("up")), scratch)
    return (points.select("id").join(roots, F.col("id") == F.col("node"), "left")
            .select("id", F.coalesce("up", "id").alias("cluster")))


def is_cluster(ids: DataFrame, merges: DataFrame, col: str = "id") -> DataFrame:
    """D1 (table form): flag ids that name a merge of the table."""
    m = merges.select(F.col("cluster").alias(col), F.lit(True).alias("is_cluster"))
    return ids.join(m, col, "left").withColumn("is_cluster", F.coalesce("is_cluster", F.lit(False)))


def all_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, 2 * n).select(F.col("id"))
