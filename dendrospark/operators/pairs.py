"""Joins over point pairs (P1-P3) and small aggregates.

Pairs are ``(id1 LONG, id2 LONG, dist DOUBLE)`` with ``id1 < id2``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import sq_euclidean
from ..session import DEFAULT_BROADCAST_BYTES, Scratch, fits_broadcast

STRATEGIES = ("min", "max", "avg", "wavg")


def check_points(points: DataFrame, dense: bool = False) -> tuple[int, int]:
    """Number of points and their common dimension, in one aggregate.  Vectors
    that are null, hold a null or NaN, or differ in size are errors; so are,
    with ``dense``, ids other than 1..n once each."""
    whole = F.coalesce(F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    r = points.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("features")).alias("lo"),
                   F.max(F.size("features")).alias("hi"), F.count_if(~whole).alias("gaps"),
                   *([F.min("id").alias("first"), F.max("id").alias("last"),
                      F.count_distinct("id").alias("ids")] if dense else [])).first()
    n = int(r["n"])
    if r["gaps"]:
        raise ValueError(f"{r['gaps']} vectors are null or hold a null or NaN component")
    if r["lo"] != r["hi"]:
        raise ValueError(f"dimension mismatch: vectors of size {r['lo']} and {r['hi']}")
    if dense and n and (r["first"], r["last"], r["ids"]) != (1, n, n):
        raise ValueError(f"{n} points need the ids 1..{n}, once each; found {r['ids']} from {r['first']} to "
                         f"{r['last']} (with_point_ids ranks any key)")
    return n, int(r["hi"] or 0)


def pairwise_distances(points: DataFrame, squared: bool = False, method: str = "auto",
                       n: int | None = None, dim: int | None = None,
                       block_rows: int = 2048, pairs_per_task: int = 2_000_000,
                       broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                       prefixes: list[int] | None = None, label: str | None = None) -> DataFrame:
    """All pairs ``id1 < id2`` with their (squared) Euclidean distance.

    ``broadcast``: the point table is broadcast once and joined with the
    theta condition ``a.id < b.id`` (nested loop on the map side, no
    shuffle) -- only when its size, checked here, is under the limit.
    ``blocks``: points are hashed into B blocks by id; each point is copied
    to the B block pairs it belongs to and the join is an equi-join on
    ``(bi, bj)``, so every task holds two blocks and the n^2/2 output is
    spread evenly, with no broadcast at all.  Beyond 16 blocks they hold at
    least 2048 points, so the copies stay few.

    ``prefixes``: ascending numbers of leading components; one row per pair and
    prefix, named ``nv``, from one join.  ``label`` names a column of both
    points to carry along as ``c1`` and ``c2``.
    """
    if n is None or dim is None:
        n, dim = check_points(points)   # one pass: count, dimension, gaps
    if method == "auto":
        method = "broadcast" if n * (dim * 8 + 64) <= broadcast_bytes else "blocks"
    out = lambda d: (d if squared else F.sqrt(d)).alias("dist")
    carried = ["c1", "c2"] if label else []

    def measured(j: DataFrame, ids: list) -> DataFrame:
        if not prefixes:
            return j.select(*ids, out(sq_euclidean("f1", "f2", dim=dim)), *carried)
        # running sums over the ranges between prefixes
        parts = [sq_euclidean(F.slice("f1", lo + 1, hi - lo), F.slice("f2", lo + 1, hi - lo))
                 for lo, hi in zip([0, *prefixes[:-1]], prefixes)]
        sums = [reduce(lambda x, y: x + y, parts[:i + 1]) for i in range(len(parts))]
        rows = F.explode(F.array(*[F.struct(F.lit(nv).alias("nv"), d.alias("d2"))
                                   for nv, d in zip(prefixes, sums)]))
        return j.select(*ids, *carried, rows.alias("r")).select(
            F.col("r.nv").alias("nv"), "id1", "id2", out(F.col("r.d2")), *carried)

    a = points.select(F.col("id").alias("id1"), F.col("features").alias("f1"), *([F.col(label).alias("c1")] if label else []))
    b = points.select(F.col("id").alias("id2"), F.col("features").alias("f2"), *([F.col(label).alias("c2")] if label else []))
    if method == "broadcast":
        # the n^2/2 work follows the probe side's partitions: spread it by
        # hash of id (a few points can carry the whole quadratic load)
        parts = max(points.sparkSession.sparkContext.defaultParallelism,
                    min(n, int(math.ceil(n * n / 2 / pairs_per_task))))
        a = a.repartition(parts, "id1")
        j = a.join(F.broadcast(b), F.col("id1") < F.col("id2"))
        return measured(j, ["id1", "id2"])
    # a point is copied once for each block: small blocks only while they are few
    nb = max(1, min(math.ceil(n / block_rows), max(16, math.ceil(n / 2048))))
    seq = F.sequence(F.lit(0), F.lit(nb - 1))
    la = a.withColumn("bi", F.pmod(F.col("id1"), F.lit(nb))).withColumn(
        "bj", F.explode(F.filter(seq, lambda x: x >= F.pmod(F.col("id1"), F.lit(nb)))))
    lb = b.withColumn("bj", F.pmod(F.col("id2"), F.lit(nb))).withColumn(
        "bi", F.explode(F.filter(seq, lambda x: x <= F.pmod(F.col("id2"), F.lit(nb)))))
    # the copies are many more rows than Spark expects of a small table: no broadcast
    parts = max(points.sparkSession.sparkContext.defaultParallelism,
                min(nb * (nb + 1) // 2, math.ceil(n * n / 2 / pairs_per_task)))
    la, lb = la.repartition(parts, "bi", "bj"), lb.repartition(parts, "bi", "bj")
    j = la.join(lb.hint("merge"), ["bi", "bj"]).where(
        (F.col("bi") < F.col("bj")) | (F.col("id1") < F.col("id2")))
    if label:
        swap = F.col("id1") > F.col("id2")
        j = j.withColumns({"c1": F.when(swap, F.col("c2")).otherwise(F.col("c1")),
                           "c2": F.when(swap, F.col("c1")).otherwise(F.col("c2"))})
    return measured(j, [F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")])


def nearest_pair(pairs: DataFrame) -> DataFrame:
    """The globally closest pair, ties broken by (dist, id1, id2)."""
    m = pairs.agg(F.min(F.struct("dist", "id1", "id2")).alias("m"))
    return m.select("m.id1", "m.id2", "m.dist")


def cluster_linkage_distance(pairs: DataFrame, assignments: DataFrame | None = None,
                             strategy: str = "min") -> DataFrame:
    """Distance between every two clusters over all their cross pairs
    -> (cluster1, cluster2, dist) with cluster1 < cluster2.  Pairs that carry
    their clusters (``pairwise_distances(label=...)``) need no join: the
    aggregate is partial on the map side."""
    agg = {"min": F.min, "max": F.max, "avg": F.avg}[strategy]
    if assignments is not None:
        a1 = assignments.select(F.col("id").alias("id1"), F.col("cluster").alias("c1"))
        a2 = assignments.select(F.col("id").alias("id2"), F.col("cluster").alias("c2"))
        pairs = pairs.join(a1, "id1").join(a2, "id2")
    return (pairs.where(F.col("c1") != F.col("c2"))
            .groupBy(F.least("c1", "c2").alias("cluster1"), F.greatest("c1", "c2").alias("cluster2"))
            .agg(agg("dist").alias("dist")))


def merge_pair(pairs: DataFrame, pair: DataFrame, new_id: int, strategy: str) -> DataFrame:
    """One Lance-Williams step.  ``pair`` is one row ``(p1, p2[, size1,
    size2])``, the clusters to merge.  Their rows are dropped; every other
    cluster k gets one row ``(k, new_id)`` whose distance is min, max,
    size-weighted average (avg) or plain average (wavg) of d(k,p1), d(k,p2).
    ``new_id`` is larger than every id, so ``id1 < id2`` holds."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    sizes = [F.col(c) if c in pair.columns else F.lit(1).alias(c) for c in ("size1", "size2")]
    one = pair.select(F.least("p1", "p2").alias("lo"), F.greatest("p1", "p2").alias("hi"), "p1", *sizes)
    near = pairs.crossJoin(F.broadcast(one))                  # one row
    first, second = F.col("id1").isin(F.col("lo"), F.col("hi")), F.col("id2").isin(F.col("lo"), F.col("hi"))
    keep = near.where(~(first | second)).select("id1", "id2", "dist")
    rows = near.where((first | second) & ~(first & second))
    own = F.when(first, F.col("id1")).otherwise(F.col("id2"))
    rows = rows.select(F.when(first, F.col("id2")).otherwise(F.col("id1")).alias("other"), "dist",
                       F.when(own == F.col("p1"), F.col("size1")).otherwise(F.col("size2")).cast("double").alias("w"))
    d = {"min": F.min("dist"), "max": F.max("dist"), "wavg": F.avg("dist"),
         "avg": F.sum(F.col("dist") * F.col("w")) / F.sum("w")}[strategy]
    new = rows.groupBy("other").agg(d.alias("dist")).select(
        F.col("other").alias("id1"), F.lit(new_id).cast("long").alias("id2"), "dist")
    return keep.unionByName(new)


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """T4: members per cluster."""
    return assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


#: Where a group's values are cut in each round of median_by().
_CUTS = [i / 16 for i in range(1, 8)] + [0.5 - 1 / 256, 0.5, 0.5 + 1 / 256] + [i / 16 for i in range(9, 16)]


def median_by(df: DataFrame, keys: list[str], col: str, out: str = "median", small: int = 1024) -> DataFrame:
    """Exact median per group (mean of the two middle values for even
    counts).  Null values are left out, NaN is the largest value; a group
    without a value has a null median.

    Groups of at most ``small`` values are sorted in one row each.  If any is
    larger, all are narrowed in rounds: a sketch of bounded size gives each group
    seventeen of its values as cuts, one aggregate counts the values between and
    at the cuts, and only the values of the interval that holds the lower middle
    one go on, at most about a sixteenth.  Values equal to a cut are an answer,
    however often they repeat.  No task ever holds a group."""
    work = Scratch(df.sparkSession, "median")
    rows = df.select(F.struct(F.lit(0).alias("_"), *keys).alias("g"), F.col(col).cast("double").alias("x"))
    sizes = work.put(rows.groupBy("g").agg(F.count("x").alias("n")), "sizes")
    named = [F.col("g")[k].alias(k) for k in keys]
    if (sizes.agg(F.max("n")).first()[0] or 0) <= small:
        xs = rows.groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        n = F.size("xs")
        middle = (F.get("xs", F.floor((n - 1) / 2).cast("int")) + F.get("xs", F.floor(n / 2).cast("int"))) / 2
        return xs.select(*named, F.when(n > 0, middle).alias(out))

    low = _lower_middles(rows, sizes, small, work)
    around = rows.join(_maybe_broadcast(low, 64), "g").groupBy("g").agg(
        F.first("low").alias("low"), F.count("x").alias("n"), F.count_if(F.col("x") <= F.col("low")).alias("upto"),
        F.min(F.when(F.col("x") > F.col("low"), F.col("x"))).alias("next"))
    # values up to the lower middle one reach the upper middle one, or the next value is it
    median = F.when((F.col("n") % 2 == 1) | (2 * F.col("upto") > F.col("n")), F.col("low")).otherwise(
        (F.col("low") + F.col("next")) / 2)
    # a struct of nulls equals another: groups under a null key meet
    return sizes.join(around.select("g", median.alias(out)), "g", "left").select(*named, out)


def _maybe_broadcast(df: DataFrame, bytes_per_row: int) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df.count(), bytes_per_row) else df


def _lower_middles(rows: DataFrame, sizes: DataFrame, small: int, work: Scratch) -> DataFrame:
    """``(g, low)``: the value of rank (n - 1) div 2 of each group, counted from 0."""
    found = []
    rows = rows.where("x IS NOT NULL")
    left = sizes.where("n > 0").select("g", "n", F.floor((F.col("n") - 1) / 2).alias("t"))
    i = 0
    while True:
        most = left.agg(F.max("n")).first()[0]
        if most is None:
            break
        if most <= small:
            xs = rows.groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("xs"))
            found.append(xs.join(left, "g").select("g", F.get("xs", F.col("t").cast("int")).alias("low")))
            break
        cuts = rows.groupBy("g").agg(F.percentile_approx("x", _CUTS, 10000).alias("cuts"))
        cuts = work.put(cuts, f"cuts-{i}")
        above = reduce(Column.__add__, [F.when(F.col("x") > F.col("cuts")[c], 1).otherwise(0) for c in range(len(_CUTS))])
        upto = reduce(Column.__add__, [F.when(F.col("x") >= F.col("cuts")[c], 1).otherwise(0) for c in range(len(_CUTS))])
        # grows with x; the values equal to a cut have a number of their own
        at = rows.join(_maybe_broadcast(cuts, 8 * len(_CUTS) + 64), "g").select(
            "g", "x", (above + upto).alias("part"), (above != upto).alias("cut"))
        parts = at.groupBy("g", "part", "cut").agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("low"))
        upto_part = Window.partitionBy("g").orderBy("part")     # at most 35 rows
        parts = parts.withColumn("end", F.sum("m").over(upto_part)).join(left.select("g", "t"), "g")
        held = parts.where((F.col("t") < F.col("end")) & (F.col("t") >= F.col("end") - F.col("m")))
        held = work.put(held.select("g", "part", "cut", "low", F.col("m").alias("n"),
                                    (F.col("t") - F.col("end") + F.col("m")).alias("t")), f"held-{i}")
        found.append(held.where("cut").select("g", "low"))
        left = held.where("NOT cut")
        rows = work.put(at.where("NOT cut").join(_maybe_broadcast(left.select("g", "part"), 64), ["g", "part"])
                        .select("g", "x"), f"rows-{i}")
        left = left.select("g", "n", "t")
        i += 1
    return work.put(reduce(DataFrame.unionByName, found), "low")
