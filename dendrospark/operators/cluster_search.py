"""Complete and average linkage of many points without a table of their pairs.

Equal points merge first, at distance 0, in the order of their ids: the merges
of a group of copies need no search.  What is left are different points with
weights (UPGMA: copies; WPGMA: 2 ** -depth in the cluster), and the distance of
two clusters is a weighted sum, or the maximum, over the pairs of their points.
While there are more clusters than a table of pairs may have, every round looks
for nearest neighbours in ball-shaped blocks:

* from below, a cluster distance is bounded by that of the centroids (the mean
  of a norm is at least the norm of the mean);
* from above, by ``sqrt(D^2 + v_x + v_y)`` with the variances of the clusters
  (the mean of a distance is at most the root of the mean square); complete
  linkage by ``D`` and both radii.

A nearest neighbour stays the nearest until one of the two merges, since the
linkages are reducible.  State is one row per cluster with its points.  The few
clusters that are left get their table of pairs from blocks of points, added
up where the blocks meet.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.vectors import sq_euclidean
from ..session import DEFAULT_BROADCAST_BYTES, Scratch, fits_broadcast
from .spanning import ball_blocks

#: Distances of one slice of a block pair.
SLICE = 1 << 20
#: Points that ask a block in one task.
ASKING_POINTS = 8192


# ----------------------------------------------------------- in one task
def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of ``x`` and ``y``.  In many dimensions
    by products; where those cancel, and in few dimensions, by differences."""
    dim = x.shape[1]
    if dim <= 8:
        d2 = np.zeros((len(x), len(y)))
        for j in range(dim):
            d = x[:, j, None] - y[None, :, j]
            d2 += d * d
        return d2
    scale = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    d2 = scale - 2 * (x @ y.T)
    i, j = np.nonzero(~(d2 > 1e-5 * scale))
    for at in range(0, len(i), SLICE // dim + 1):
        part = slice(at, at + SLICE // dim + 1)
        d2[i[part], j[part]] = ((x[i[part]] - y[j[part]]) ** 2).sum(axis=1)
    return d2


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``x`` and ``y``."""
    return np.sqrt(squares(x, y))


def between(x, wx, ends_x, y, wy, ends_y, strategy: str) -> np.ndarray:
    """Of all clusters of ``x`` against all of ``y``: the weighted sum (max: the
    maximum; min: the minimum) of the distances of their points.  Clusters are
    runs of rows; ``ends`` are where they end."""
    best = {"max": np.maximum, "min": np.minimum}.get(strategy, np.add)
    out = np.full((len(ends_x), len(ends_y)), {"max": -np.inf, "min": np.inf}.get(strategy, 0.0))
    if not out.size:
        return out
    first_y = np.concatenate(([0], ends_y[:-1]))
    step = max(1, SLICE // len(y))
    for at in range(0, len(x), step):
        d = distances(x[at:at + step], y)
        if best is np.add:
            d *= wy[None, :] * wx[at:at + step, None]
        part = best.reduceat(d, first_y, axis=1)
        own = np.searchsorted(ends_x, np.arange(at, min(at + step, len(x))), "right")
        runs = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        u = own[runs]
        out[u] = best(out[u], best.reduceat(part, runs, axis=0))
    return out


def compared(d: np.ndarray) -> np.ndarray:
    """To 13 digits: sums of the same distances in another order are equal."""
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = 10.0 ** (12 - np.floor(np.log10(d)))
        return np.where((d > 0) & np.isfinite(d), np.round(d * unit) / unit, d)


def _clusters(rows: pa.Table, dim: int):
    """Points, weights, ends of the clusters and their summed weights."""
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(rows["np"].to_numpy())
    return flat("pts").reshape(-1, dim), flat("ws"), ends, rows["w"].to_numpy()


def _cluster_distances(one, two, strategy: str) -> np.ndarray:
    """Linkage distances; ``_clusters`` of both sides."""
    d = between(*one[:3], *two[:3], strategy)
    return d / (one[3][:, None] * two[3][None, :]) if strategy == "avg" else d


# ------------------------------------------------------------ equal points
def merge_copies(points: DataFrame, scratch: Scratch, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """Merges of equal points, the different points ``(keys, id, features, copies)``,
    named by the smallest id, how many these are, and the first free round.  In
    the order ``(0, lo, hi)`` the copies of a point join the first one by id.
    ``keys`` separate models."""
    keys = keys or []
    equal = Window.partitionBy(*keys, "features")
    rank = F.row_number().over(equal.orderBy("id")).cast("long")
    first = F.min("id").over(equal)
    named = points.select(*keys, F.col("id").cast("long").alias("id"), F.transform("features", lambda x: x + F.lit(0.0)).alias("features"))
    ranked = scratch.put(named.select(*keys, "id", "features", rank.alias("rank"), first.alias("lo")), "copies")
    merges = ranked.where("rank > 1").select(
        *keys, "lo", F.col("id").alias("hi"), F.lit(0.0).alias("d"), F.col("rank").alias("size"), F.lit(0.0).alias("h"),
        F.when(F.col("rank") > 2, F.col("rank") - 3).alias("lo_round"), F.lit(None).cast("long").alias("hi_round"),
        (F.col("rank") - 2).alias("round"))
    copies = ranked.groupBy(*keys, "lo").agg(F.max("rank").alias("copies"))
    seen = Observation()
    different = scratch.put(ranked.where("rank = 1").select(*keys, "id", "features").join(
        copies.withColumnRenamed("lo", "id"), [*keys, "id"]).observe(
            seen, F.count(F.lit(1)).alias("n"), F.max("copies").alias("most")), "different")
    return merges, different, seen.get["n"], (seen.get["most"] or 1) - 1


# ------------------------------------------------------------------ rounds
def _start(different: DataFrame, blocks_of: DataFrame, strategy: str) -> DataFrame:
    """One cluster for each different point."""
    w = F.lit(1.0) if strategy == "wavg" else F.col("copies").cast("double")
    none = F.lit(None).cast("long")
    return different.join(blocks_of, "id").select(
        F.col("id").alias("comp"), "blk", F.col("features").alias("c"), F.lit(0.0).alias("v"), F.lit(0.0).alias("rad"),
        w.alias("w"), F.col("copies").alias("size"), F.lit(0.0).alias("h"),
        F.when(F.col("copies") > 1, F.col("copies") - 2).alias("m"), F.lit(1).cast("long").alias("np"),
        F.col("features").alias("pts"), F.array(w).alias("ws"), none.alias("nn"), F.lit(None).cast("double").alias("nd"))


def _nearest(asking: DataFrame, asked: DataFrame, dim: int, strategy: str) -> DataFrame:
    """``(comp, d, key, nn)``: the nearest cluster of each block that a cluster
    asks.  ``asking (at, comp, np, pts, ws, w)`` against ``asked (blk, ...)``."""
    cut = asking.groupBy("at").agg(F.ceil(F.sum("np") / F.lit(ASKING_POINTS)).alias("chunks"))   # a row per block
    left = asking.join(F.broadcast(cut), "at").withColumn("chunk", F.pmod(F.xxhash64("comp"), F.col("chunks"))).drop("chunks")
    # new names: both sides may come from the same rows
    right = asked.select(F.col("blk").alias("at"), *[F.col(c).alias(f"{c}_") for c in asked.columns if c != "blk"])
    right = right.join(F.broadcast(cut), "at").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")

    def search(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.rename_columns([c.rstrip("_") for c in two.column_names])
        names, others = one["comp"].to_numpy(), two["comp"].to_numpy()
        if not len(names) or not len(others):
            return pa.table({"comp": pa.array([], pa.int64()), "d": pa.array([], pa.float64()),
                             "key": pa.array([], pa.float64()), "nn": pa.array([], pa.int64())})
        order = np.argsort(others)                  # a row's least pair is that of the smaller other end
        two, others = two.take(pa.array(order)), others[order]
        d = _cluster_distances(_clusters(one, dim), _clusters(two, dim), strategy)
        d[names[:, None] == others[None, :]] = np.inf
        key = compared(d)
        at = key.argmin(axis=1)
        rows = np.arange(len(at))
        hit = np.isfinite(d[rows, at])
        return pa.table({"comp": names[hit], "d": d[rows, at][hit], "key": key[rows, at][hit], "nn": others[at[hit]]})

    return left.groupBy("at", "chunk").cogroup(right.groupBy("at", "chunk")).applyInArrow(
        search, "comp LONG, d DOUBLE, key DOUBLE, nn LONG")


def _best(found: DataFrame) -> DataFrame:
    """The least of each cluster under ``(d, lo, hi)``: with one end fixed, the
    smaller other end."""
    return found.groupBy("comp").agg(F.min(F.struct("key", "nn", "d")).alias("e")).select(
        "comp", F.col("e.nn").alias("nn"), F.col("e.d").alias("nd"))


def _search(state: DataFrame, dim: int, strategy: str, scratch: Scratch, r: int) -> DataFrame:
    """State in which every cluster has its nearest one."""
    body = ["comp", "np", "pts", "ws", "w"]
    needy = state.where("nn IS NULL")
    asked = state.select("blk", *body)
    own = scratch.put(_best(_nearest(needy.select(F.col("blk").alias("at"), *body), asked, dim, strategy)), f"own-{r}")
    middle = state.groupBy("blk").agg(*[F.avg(F.col("c")[j]).alias(f"c{j}") for j in range(dim)])
    middle = scratch.put(middle.select("blk", F.array(*[f"c{j}" for j in range(dim)]).alias("center")), f"middle-{r}")
    blocks = scratch.put(state.join(F.broadcast(middle), "blk").groupBy("blk").agg(
        F.first("center").alias("center"), F.max(F.sqrt(sq_euclidean("c", "center"))).alias("radius"),
        F.max("v").alias("v_most"), F.max("rad").alias("rad_most")), f"blocks-{r}")
    small = F.broadcast(blocks.withColumnRenamed("blk", "at"))      # a row per block
    away = F.sqrt(sq_euclidean("c", "center"))
    reach = away + F.col("radius")
    upper = reach + F.col("rad") + F.col("rad_most") if strategy == "max" else F.sqrt(
        reach * reach + F.col("v") + F.col("v_most"))
    within = needy.select("comp", "blk", "c", "v", "rad").join(small, F.col("blk") != F.col("at")).groupBy("comp").agg(
        F.min(upper).alias("within"))
    limits = scratch.put(needy.select("comp").join(own.select("comp", "nd"), "comp", "left").join(within, "comp", "left").select(
        "comp", F.least("nd", "within").alias("limit")), f"limits-{r}")
    slack = 1e-9 * (away + F.col("radius") + F.col("limit"))       # rounding of the bounds
    asks = needy.join(limits, "comp").join(
        small, (F.col("blk") != F.col("at")) & (away - F.col("radius") - slack <= F.col("limit"))).select("at", *body)
    asks = scratch.put(asks, f"asks-{r}")
    far = _nearest(asks, asked, dim, strategy)
    keyed = own.select("comp", F.col("nd").alias("d"), "nn")
    near = _best_of(far, keyed)
    got = scratch.put(near.select("comp", F.col("nn").alias("nn1"), F.col("nd").alias("nd1")), f"got-{r}")
    out = state.join(got, "comp", "left").withColumns(
        {"nn": F.coalesce("nn1", "nn"), "nd": F.coalesce("nd1", "nd")}).drop("nn1", "nd1")
    return scratch.put(out, f"near-{r}")


def _best_of(far: DataFrame, own: DataFrame) -> DataFrame:
    """The nearest of both searches; ``own`` holds raw distances."""
    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["comp"], b["d"], pa.array(compared(b["d"].to_numpy())), b["nn"]],
                                             ["comp", "d", "key", "nn"])
    return _best(far.unionByName(own.select("comp", "d", "nn").mapInArrow(
        keys, "comp LONG, d DOUBLE, key DOUBLE, nn LONG")))


def _joined(state: DataFrame, merged: DataFrame, strategy: str, dim: int, r: int) -> DataFrame:
    """The merged clusters, each from the rows of its two ends."""
    side = lambda end, i: state.select(F.col("comp").alias(end), *[F.col(c).alias(f"{c}{i}") for c in (
        "blk", "c", "v", "rad", "w", "np", "pts", "ws")])
    j = merged.select("lo", "hi", "size", "h").join(side("lo", 1), "lo").join(side("hi", 2), "hi")
    if strategy == "wavg":
        a = b = F.lit(0.5)
        w, half = F.lit(1.0), (lambda c: F.transform(c, lambda x: x / 2))
    else:
        w, half = F.col("w1") + F.col("w2"), F.col
        a, b = F.col("w1") / w, F.col("w2") / w
    c = F.zip_with("c1", "c2", lambda x, y: x * a + y * b)
    apart2 = sq_euclidean("c1", "c2")
    apart = F.sqrt(apart2)
    return j.select(
        F.col("lo").alias("comp"), F.col("blk1").alias("blk"), c.alias("c"),
        (a * F.col("v1") + b * F.col("v2") + a * b * apart2).alias("v"),
        F.greatest(F.col("rad1") + b * apart, F.col("rad2") + a * apart).alias("rad"), w.alias("w"), "size", "h",
        F.lit(r).cast("long").alias("m"), (F.col("np1") + F.col("np2")).alias("np"), F.concat("pts1", "pts2").alias("pts"),
        F.concat(half("ws1"), half("ws2")).alias("ws"), F.lit(None).cast("long").alias("nn"),
        F.lit(None).cast("double").alias("nd"))


def merge_down(different: DataFrame, n: int, dim: int, strategy: str, scratch: Scratch, clusters: int, r: int,
               block_points: int | None = None,
               broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[DataFrame, list[DataFrame], int, int]:
    """Rounds until at most ``clusters`` are left: the state, the merges of each
    round, the number of clusters left and the next round."""
    if n > clusters:
        dealt, _ = ball_blocks(different.select("id", "features"), n, dim, scratch,
                               block_points or max(512, 64 * dim), broadcast_bytes)
        blocks_of = dealt.select("id", "blk")
    else:
        blocks_of = different.select("id", F.lit(0).cast("long").alias("blk"))
    state = scratch.put(_start(different, blocks_of, strategy), f"clusters-{r}")
    found, left = [], n
    while left > clusters:
        near = _search(state, dim, strategy, scratch, r)
        end = lambda x, i: near.select(F.col("comp").alias(x), *[F.col(c).alias(f"{c}{i}") for c in (
            "nn", "nd", "size", "h", "m")])
        pairs = end("lo", 1).where("lo < nn1").join(end("hi", 2), F.col("nn1") == F.col("hi"))
        below = F.greatest("h1", "h2")
        # a distance that rounding put under a child's height is raised above it
        h = F.when(F.col("nd1") < below, below * (1 + 2.0 ** -52)).otherwise(F.greatest("nd1", below))
        columns = ["lo", "hi", F.col("nd1").alias("d"), (F.col("size1") + F.col("size2")).alias("size"), h.alias("h"),
                   F.col("m1").alias("lo_round"), F.col("m2").alias("hi_round"), F.lit(r).cast("long").alias("round")]
        seen = Observation()
        merged = scratch.put(pairs.where("nn2 = lo").select(columns).observe(seen, F.count(F.lit(1)).alias("n")), f"found-{r}")
        cnt = seen.get["n"]
        if cnt == 0:       # rounding made a circle of neighbours: the least pair of all
            least = near.select(F.least("comp", "nn").alias("lo"), F.greatest("comp", "nn").alias("nn1"), "nd").orderBy(
                "nd", "lo", "nn1").limit(1)
            one = end("lo", 1).drop("nn1", "nd1").join(F.broadcast(least.withColumnRenamed("nd", "nd1")), "lo").join(
                end("hi", 2), F.col("nn1") == F.col("hi"))
            merged, cnt = scratch.put(one.select(columns), f"least-{r}"), 1
        found.append(merged)
        ends = merged.select(F.col("lo").alias("comp")).unionByName(merged.select(F.col("hi").alias("comp")))
        ends = F.broadcast(ends) if fits_broadcast(2 * cnt, 24, broadcast_bytes) else ends
        keep = near.join(ends, "comp", "left_anti")
        # a neighbour that merged is none any more
        gone = ends.select(F.col("comp").alias("nn"), F.lit(True).alias("gone"))
        gone = F.broadcast(gone) if fits_broadcast(2 * cnt, 24, broadcast_bytes) else gone
        keep = keep.join(gone, "nn", "left").withColumns(
            {"nd": F.when(F.col("gone").isNull(), F.col("nd")), "nn": F.when(F.col("gone").isNull(), F.col("nn"))})
        state = scratch.put(keep.select(state.columns).unionByName(_joined(near, merged, strategy, dim, r)), f"clusters-{r + 1}")
        for name in ("clusters", "own", "middle", "blocks", "limits", "asks", "got", "near"):
            scratch.drop(f"{name}-{r}")
        left -= cnt
        r += 1
    return state, found, left, r


def table_of(state: DataFrame, dim: int, strategy: str, points: int) -> DataFrame:
    """Round state of ``linkage``: the distances of all pairs of clusters, and a
    row for each cluster.  Blocks of clusters meet in pairs, each pair of
    clusters in one task."""
    nb = max(1, min(256, -(-points // 4096)))
    seq = F.sequence(F.lit(0), F.lit(nb - 1))
    rows = state.select("comp", "np", "pts", "ws", "w", "size", F.pmod(F.xxhash64("comp"), F.lit(nb)).cast("int").alias("own"))
    met = rows.withColumn("other", F.explode(seq)).select(
        "*", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj")).drop("other")

    def meet(key, rows):
        own, bi, bj = rows["own"].to_numpy(), key[0].as_py(), key[1].as_py()
        one, two = rows.filter(pa.array(own == bi)), rows.filter(pa.array(own == bj))
        x, y = one["comp"].to_numpy(), two["comp"].to_numpy()
        if not len(x) or not len(y):
            i = j = np.zeros(0, int)
            s = np.zeros((len(x), len(y)))
        else:
            s = between(*_clusters(one, dim)[:3], *_clusters(two, dim)[:3], strategy)
            i, j = np.nonzero(x[:, None] < y[None, :]) if bi == bj else (
                a.ravel() for a in np.indices(s.shape))
        c = one["size"].to_numpy()[i] * two["size"].to_numpy()[j]
        s = s[i, j]
        return pa.table({"a": np.minimum(x[i], y[j]), "b": np.maximum(x[i], y[j]), "d": s / c if strategy == "avg" else s,
                         "s": s, "c": c.astype(np.int64)})

    edges = met.groupBy("bi", "bj").applyInArrow(meet, "a LONG, b LONG, d DOUBLE, s DOUBLE, c LONG")
    none, avg = F.lit(None), strategy == "avg"
    edges = edges.select("a", "b", "d", (F.col("s") if avg else none.cast("double")).alias("s"),
                         (F.col("c") if avg else none.cast("long")).alias("c"), none.cast("long").alias("m"))
    return edges.unionByName(state.select(
        F.col("comp").alias("a"), F.col("comp").alias("b"), F.col("h").alias("d"), none.cast("double").alias("s"),
        F.col("size").alias("c"), "m"))


def all_merges(copies: DataFrame, found: list[DataFrame], rest: DataFrame) -> DataFrame:
    """Raw merges of all three parts."""
    return reduce(DataFrame.unionByName, [copies, *found, rest])
