"""Whole-tree computations over a merge table, in logarithmic rounds.

* ``contract`` (C7 and sizes): values that every merge takes from its two
  children.  A merge is an affine map of the children it still waits for; a
  round puts known children and the maps of children that wait for one node
  themselves into it, so leaves are raked and chains halved at once.
* ``tour`` (C10, D2): the leaves of each tree in the order of an Euler tour.
  Every cluster's members are one interval of that order, found by list ranking.
* ``ancestors`` and ``clusters_at`` (D3, D4): the 2^j-th ancestors of every node,
  kept as a table, answer any batch of (point, level) questions.
* ``lives`` (D5): the range of levels K at which each cluster exists.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_BYTES, Scratch, fits_broadcast
from .dendrogram import child_parent, root_of


def contract(merges: DataFrame, leaves: DataFrame, weight: float, scratch: Scratch,
             broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """``(cluster, value)`` of every merge, and the number of rounds: value =
    weight * (value of point1 + value of point2), from the leaves' ``(node,
    value ARRAY<DOUBLE>)``.  Rounds grow with the logarithm of the number of
    merges, whatever the height."""
    tag = f"contract-{uuid.uuid4().hex[:8]}"
    w = F.lit(float(weight))
    side = lambda end: leaves.select(F.col("node").alias(f"point{end}"), F.col("value").alias(f"v{end}"))
    j = merges.select("cluster", "point1", "point2").join(side(1), "point1", "left").join(side(2), "point2", "left")
    sum_of = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    times = lambda b, v: F.transform(v, lambda x: b * x)
    scaled = lambda v: times(w, v)
    const = F.when(F.col("v1").isNotNull() & F.col("v2").isNotNull(), sum_of(scaled("v1"), scaled("v2"))).otherwise(
        F.coalesce(scaled("v1"), scaled("v2")))
    waits = F.array_compact(F.array(*[F.when(F.col(f"v{e}").isNull(), F.struct(F.col(f"point{e}").alias("u"), w.alias("b")))
                                      for e in (1, 2)]))
    # value = const (null: zero) + sum of b * value(u) over the waits
    state = j.select(F.col("cluster").alias("node"), const.alias("c"), waits.alias("w"))

    def put_in(act: DataFrame, maps: DataFrame) -> DataFrame:
        """``act`` with the values and single-node maps ``(node, c, w)`` put in."""
        maps = maps.select("node", "c", F.get("w", F.lit(0)).alias("x"))
        c, new = F.col("c"), []
        for e in (0, 1):
            got = maps.select(F.col("node").alias(f"u{e}"), F.col("c").alias(f"c{e}"), F.col("x").alias(f"x{e}"),
                              F.lit(True).alias(f"hit{e}"))
            wait = F.get("w", F.lit(e))
            act = act.withColumn(f"u{e}", wait["u"]).join(small(got), f"u{e}", "left")
            part = times(wait["b"], f"c{e}")
            c = F.when(F.col(f"c{e}").isNull(), c).when(c.isNull(), part).otherwise(sum_of(c, part))
            x = F.col(f"x{e}")
            on = F.when(x.isNotNull(), F.struct(x["u"].alias("u"), (wait["b"] * x["b"]).alias("b")))
            new.append(F.when(F.col(f"hit{e}").isNull(), wait).otherwise(on))
        return act.select("node", c.alias("c"), F.array_compact(F.array(*new)).alias("w"))

    done, i, before = [], 0, None
    while True:
        seen = Observation()
        state = scratch.put(state.observe(seen, F.count_if(F.size("w") > 0).alias("left"), F.count(F.lit(1)).alias("n")),
                            f"{tag}-{i}")
        known = scratch.put(state.where(F.size("w") == 0), f"{tag}-done-{i}")
        scratch.drop(f"{tag}-{i - 1}")
        scratch.drop(f"{tag}-raked-{i - 1}")
        done.append(known.select(F.col("node").alias("cluster"), F.col("c").alias("value")))
        left = seen.get["left"]
        if left == 0:
            return reduce(DataFrame.unionByName, done), i
        if left == before == seen.get["n"]:
            raise ValueError("the merges wait for nodes that are neither points nor clusters of the table")
        before = left
        small = F.broadcast if fits_broadcast(seen.get["n"], 64, broadcast_bytes // 16) else (lambda df: df)
        # leaves first: then no map names a node that was known before
        raked = scratch.put(put_in(state.where(F.size("w") > 0), known), f"{tag}-raked-{i}")
        state = put_in(raked, raked.where(F.size("w") <= 1))
        i += 1


def sizes(merges: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``merges`` with ``size``, counted where the table does not have it."""
    if "size" in merges.columns:
        return merges
    one = merges.sparkSession.range(1, n + 1).select(F.col("id").alias("node"), F.array(F.lit(1.0)).alias("value"))
    got, _ = contract(merges, one, 1.0, scratch)
    return merges.join(got.select("cluster", F.col("value")[0].cast("long").alias("size")), "cluster")


def tour(merges: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``(node, root, first, size)`` of every leaf and cluster: in the order of
    an Euler tour of its tree, the leaves below a node take the places ``first``
    to ``first + size - 1``.  A node starts where its parent does, or behind its
    sibling; pointer doubling adds these steps up to the root."""
    m = sizes(merges, n, scratch).select("cluster", "point1", "point2", "size")
    own = m.select(F.col("cluster").alias("node"), "size").unionByName(
        merges.sparkSession.range(1, n + 1).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size")))
    own = scratch.put(own, "sizes")
    ahead = m.join(own.select(F.col("node").alias("point1"), F.col("size").alias("s1")), "point1")
    steps = ahead.select(F.col("point1").alias("node"), F.col("cluster").alias("up"), F.lit(0).cast("long").alias("step")).unionByName(
        ahead.select(F.col("point2").alias("node"), F.col("cluster").alias("up"), F.col("s1").alias("step")))
    ranked = root_of(steps, scratch, add="step")
    return scratch.put(own.join(ranked, "node", "left").select(
        "node", F.coalesce("up", "node").alias("root"), F.coalesce("step", F.lit(0)).cast("long").alias("first"), "size"), "tour")


def members(tour: DataFrame, clusters: DataFrame, n: int, block: int = 1 << 16) -> DataFrame:
    """``(cluster, id)``: the leaves in the intervals of ``clusters (cluster)``.
    Intervals are unrolled in pieces of ``block`` places and meet the leaves by
    place, so the rows made are those returned."""
    spans = tour.join(clusters.select(F.col("cluster").alias("node")), "node")
    pieces = spans.select("node", "root", "first", "size", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("at"))
    places = pieces.select(F.col("node").alias("cluster"), "root", F.explode(F.sequence(
        F.col("first") + F.col("at"), F.col("first") + F.least(F.col("at") + block, F.col("size")) - 1)).alias("first"))
    leaves = tour.where(F.col("node") <= n).select(F.col("node").alias("id"), "root", "first")
    return places.join(leaves, ["root", "first"]).select("cluster", "id")


def ancestors(merges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``(node, j, up)``, the 2^j-th ancestor of every node that has one, and the
    number of values of j: n log(height) rows, to be kept with a model."""
    tag = f"lift-{uuid.uuid4().hex[:8]}"
    table = []
    step = child_parent(merges)
    while True:
        seen = Observation()
        step = scratch.put(step.observe(seen, F.count(F.lit(1)).alias("n")), f"{tag}-{len(table)}")
        if seen.get["n"] == 0:
            break
        table.append(step.select("node", F.lit(len(table)).alias("j"), "up"))
        on = step.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        step = step.join(on, "up").select("node", F.col("up2").alias("up"))
    if not table:
        return step.select("node", F.lit(0).alias("j"), "up"), 0
    return reduce(DataFrame.unionByName, table), len(table)


def clusters_at(questions: DataFrame, table: DataFrame, levels: int, n: int) -> DataFrame:
    """``questions (id, k, ...)`` with ``cluster``, the one that holds the point
    when k clusters are left: its last ancestor among the first n-k merges.  One
    join for each power of two, from the largest; no cut.  Questions of any
    number and any levels share the plan."""
    at = questions.withColumn("cluster", F.col("id"))
    for j in range(levels - 1, -1, -1):
        up = table.where(F.col("j") == j).select(F.col("node").alias("cluster"), "up")
        at = at.join(up, "cluster", "left").withColumn(
            "cluster", F.when(F.col("up") <= 2 * n - F.col("k"), F.col("up")).otherwise(F.col("cluster"))).drop("up")
    return at


def lives(merges: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``(node, size, k_from, k_to)``: the levels K at which a leaf or cluster is
    one of the K clusters.  Cluster c exists from level 2n-c down to where its
    parent takes its place; ``k_from`` is the least level that the table reaches
    for a node without a parent."""
    m = sizes(merges, n, scratch)
    own = m.select(F.col("cluster").alias("node"), "size", (2 * n - F.col("cluster")).alias("k_to")).unionByName(
        merges.sparkSession.range(1, n + 1).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size"),
                                                   F.lit(n).cast("long").alias("k_to")))
    least = m.agg((n - F.count(F.lit(1))).alias("k_least"))
    return own.join(child_parent(m), "node", "left").join(F.broadcast(least)).select(
        "node", "size", F.coalesce(2 * n - F.col("up") + 1, "k_least").cast("long").alias("k_from"), "k_to")
