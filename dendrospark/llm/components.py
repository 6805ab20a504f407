"""Connected components of an undirected edge table, in star rounds.

Alternating large-star and small-star rounds (Kiveris et al. 2014): every edge
is re-hung on the smallest neighbour of one of its ends until each node hangs
on the smallest node of its component.  Rounds grow with the logarithm of the
component size; each is written below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """(u, v) both ways; every neighbour larger than u hangs on the smallest of
    u and its neighbours."""
    nb = _both(edges)
    low = nb.groupBy("a").agg(F.min("b").alias("m"))
    return (nb.where("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours hang on the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    rehung = down.join(low, "a")
    return (rehung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct())


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """``(a LONG, b LONG)`` -> ``(node, root)`` for every node of an edge;
    ``root`` is the smallest node that can be reached.  Null ends and loops are
    ignored.  An empty table gives an empty one."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = scratch.put(edges.where("a <> b").distinct(), f"{tag}-0")
    i, mark = 0, None
    while True:
        i += 1
        nxt = scratch.put(_small_star(_large_star(edges)), f"{tag}-{i}")
        # an order-free digest of the edge set: two xors and the count
        now = nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")),
                      F.bit_xor(F.xxhash64("b", "a"))).first()
        if i > 1:
            scratch.drop(f"{tag}-{i - 2}")
        edges = nxt
        if now[0] == 0 or now == mark:
            break
        mark = now
    # a stable set of stars: each row hangs a node on its root
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
