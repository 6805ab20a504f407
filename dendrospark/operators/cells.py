"""Nearest neighbours in many dimensions, and of several models at once.

Where bounds on balls exclude next to nothing, every cluster that searches meets
every other one: those that search are dealt into chunks, all into blocks, and a
chunk meets a block in one task, a cell.  Points lie in one table that no round
writes again; a round writes a row for each cluster and point, without vectors.

A task measures tiles of bounded size.  Clusters of a cell are ordered by their
number of points, so the members of equally large ones add up as whole arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_BYTES, Scratch, fits_broadcast
from .cluster_search import compared

#: Dimensions from which on cells are searched instead of balls.
CELL_DIM = 9
#: Points on a side of a cell.
SIDE = 16384
#: Distances of one tile.
TILE = 1 << 18


# ----------------------------------------------------------- in one task
class Measured:
    """Distances of any points to the points ``y``."""

    def __init__(self, y: np.ndarray):
        self.y, self.dim = y, y.shape[1]
        if self.dim >= CELL_DIM:
            self.norms = (y * y).sum(axis=1)
            self.right = np.vstack((-2 * y.T, np.ones(len(y)), self.norms))

    def squares(self, x: np.ndarray) -> np.ndarray:
        """In many dimensions by products; where those cancel, and in few, by differences."""
        if self.dim < CELL_DIM:
            d2 = np.zeros((len(x), len(self.y)))
            for j in range(self.dim):
                d = x[:, j, None] - self.y[None, :, j]
                d2 += d * d
            return d2
        norms = (x * x).sum(axis=1)
        d2 = np.column_stack((x, norms, np.ones(len(x)))) @ self.right
        if not d2.min(initial=np.inf) > 1e-5 * (norms.max(initial=0) + self.norms.max(initial=0)):
            i, j = np.nonzero(~(d2 > 1e-5 * (norms[:, None] + self.norms[None, :])))
            for at in range(0, len(i), TILE // self.dim + 1):
                part = slice(at, at + TILE // self.dim + 1)
                d2[i[part], j[part]] = ((x[i[part]] - self.y[j[part]]) ** 2).sum(axis=1)
        return d2

    def distances(self, x: np.ndarray) -> np.ndarray:
        d2 = self.squares(x)
        return np.sqrt(d2, out=d2)


def vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Clusters:
    """Clusters of the rows ``(comp, id, ws, features)``, ordered by their number of
    points; ``runs`` are those of equal size: first cluster, clusters, first point, size."""

    def __init__(self, rows: pa.Table, dim: int):
        names, at, sizes = np.unique(rows["comp"].to_numpy(), return_inverse=True, return_counts=True)
        by_size = np.lexsort((names, sizes))
        place = np.empty(len(names), int)
        place[by_size] = np.arange(len(names))
        order = np.lexsort((rows["id"].to_numpy(), place[at]))
        self.names, sizes = names[by_size], sizes[by_size]
        self.x, self.ws = vectors(rows["features"], dim)[order], rows["ws"].to_numpy()[order]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        self.w = np.add.reduceat(self.ws, starts[:-1]) if len(names) else self.ws
        cuts = np.flatnonzero(np.concatenate(([True], sizes[1:] != sizes[:-1]))) if len(names) else []
        self.runs = [(a, b - a, starts[a], sizes[a]) for a, b in zip(cuts, [*cuts[1:], len(names)])]


def strips(one: Clusters, two: Clusters, strategy: str):
    """``(first, values)``: of some clusters of ``one`` from ``first`` on against all of
    ``two`` the weighted sum (max: the maximum) of the distances of their points."""
    best, dim = (np.maximum if strategy == "max" else np.add), one.x.shape[1]
    # a run's first members, then its second ones, ...
    order = np.concatenate([p + np.arange(k * s).reshape(k, s).T.ravel() for _, k, p, s in two.runs])
    measured = Measured(two.x[order])
    weights = None if best is np.maximum or (two.ws == 1).all() else two.ws[order]
    own = None if best is np.maximum or (one.ws == 1).all() else one.ws
    rows = max(16, TILE // len(order))
    for first, clusters, start, size in one.runs:
        step = max(1, rows // size)
        for a in range(0, clusters, step):
            b = min(clusters, a + step)
            at = start + np.arange(a * size, b * size).reshape(b - a, size).T           # members, clusters
            total = None
            for m in range(0, size, max(1, rows // (b - a))):
                some = at[m:m + max(1, rows // (b - a))]
                d = measured.distances(one.x[some.ravel()])
                if own is not None:
                    d *= own[some.ravel()][:, None]
                d = best.reduce(d.reshape(*some.shape, -1), axis=0)
                total = d if total is None else best(total, d)
            if weights is not None:
                total = total * weights[None, :]
            out = np.empty((b - a, len(two.names)))
            for c, k, p, s in two.runs:
                out[:, c:c + k] = best.reduce(total[:, p:p + k * s].reshape(b - a, s, k), axis=1)
            yield first + a, out


def nearest_of(one: Clusters, two: Clusters, strategy: str):
    """``(comp, d, key, nn)`` of every cluster of ``one`` that has another in ``two``;
    equal keys go to the smaller name."""
    sorter = np.argsort(two.names)
    at = np.minimum(np.searchsorted(two.names, one.names, sorter=sorter), len(sorter) - 1)
    itself = np.where(two.names[sorter[at]] == one.names, sorter[at], -1)
    for first, d in strips(one, two, strategy):
        names = one.names[first:first + len(d)]
        if strategy == "avg":
            d /= one.w[first:first + len(d), None] * two.w[None, :]
        same = itself[first:first + len(d)]
        d[np.flatnonzero(same >= 0), same[same >= 0]] = np.inf
        least = d.min(axis=1)
        i, j = np.nonzero((d <= (least * (1 + 4e-12))[:, None]) & np.isfinite(least)[:, None])
        key = compared(d[i, j])
        keep = key == compared(least)[i]
        i, j, key = i[keep], j[keep], key[keep]
        order = np.lexsort((two.names[j], i))
        order = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))] if len(i) else order
        i, j = i[order], j[order]
        yield names[i], d[i, j], key[order], two.names[j]


# ------------------------------------------------------------------ cells
def cells(asking: DataFrame, asked: DataFrame, keys: list[str], chunk_by: str, block_by: str, asks: int, n: int,
          models: int = 1):
    """Both sides grouped by cells ``(keys, chunk, blk)``: ``asks`` of the ``n`` points
    of a model search.  ``chunk_by`` and ``block_by`` name what stays together."""
    tasks = asking.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, math.ceil(asks / SIDE))
    blocks = max(1, math.ceil(n / SIDE), min(math.ceil(n / 1024), math.ceil(3 * tasks / (chunks * models))))
    parts = max(tasks, chunks * blocks * models)
    number = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    by = [*keys, "chunk", "blk"]
    left = asking.select("*", dealt(chunk_by, chunks).alias("chunk")).select("*", number(blocks).alias("blk"))
    # new names: both sides may come from the same rows
    right = asked.select(*[F.col(c).alias(c if c in keys else f"{c}_") for c in asked.columns])
    right = right.select("*", dealt(f"{block_by}_", blocks).alias("blk")).select("*", number(chunks).alias("chunk"))
    return left.repartition(parts, *by).groupBy(*by).cogroup(right.repartition(parts, *by).groupBy(*by))


def _named(keys: list[str], key: tuple, columns: dict) -> pa.Table:
    """The columns under the values of the model's key."""
    size = len(next(iter(columns.values())))
    return pa.table({k: pa.array([v.as_py()] * size, v.type) for k, v in zip(keys, key)} | columns)


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {dict(df.dtypes)[k]}, " for k in keys)


def merge_cells(different: DataFrame, n: int, dim: int, strategy: str, scratch: Scratch, clusters: int, r: int,
                keys: list[str] | None = None, models: list | None = None,
                broadcast_bytes: int = DEFAULT_BROADCAST_BYTES):
    """Rounds until at most ``clusters`` of each model are left, of ``n`` different points
    in all: the round state of ``linkage`` with the table of their pairs, the merges of
    each round, the clusters left of the largest model and the next round.

    ``different (keys, id, features, copies)`` as of ``merge_copies``."""
    keys, models = keys or [], models or [None]
    none = F.lit(None).cast("long")
    small = F.broadcast if fits_broadcast(n, 48, broadcast_bytes) else (lambda df: df)
    w = F.lit(1.0) if strategy == "wavg" else F.col("copies").cast("double")

    def put(df: DataFrame, name: str):
        """The clusters, how many a model has, and the points of those that search."""
        seen = Observation()
        of = lambda m: F.col(keys[0]) == F.lit(m) if keys else F.lit(True)
        counts = [F.count_if(of(m)).alias(f"n{i}") for i, m in enumerate(models)]
        df = scratch.put(df.observe(seen, F.coalesce(F.sum(F.when(F.col("nn").isNull(), F.col("np"))), F.lit(0)).alias("asks"),
                                    *counts), name)
        got = seen.get
        return df, max(got[f"n{i}"] for i in range(len(models))), got["asks"]

    at = scratch.put(different.select(*keys, "id", F.col("id").alias("comp"), w.alias("ws")), f"at-{r}")
    state, left, asks = put(different.select(
        *keys, F.col("id").alias("comp"), w.alias("w"), F.col("copies").alias("size"), F.lit(0.0).alias("h"),
        F.when(F.col("copies") > 1, F.col("copies") - 2).alias("m"), F.lit(1).cast("long").alias("np"), none.alias("nn"),
        F.lit(None).cast("double").alias("nd")), f"clusters-{r}")
    most = left                                     # points of the largest model
    found = []

    def search(key, one, two):
        two = two.rename_columns([c.rstrip("_") for c in two.column_names])
        parts = [(np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, int))]
        if len(one) and len(two):
            parts += nearest_of(Clusters(one, dim), Clusters(two, dim), strategy)
        return _named(keys, key, dict(zip(("comp", "d", "key", "nn"), map(np.concatenate, zip(*parts)))))

    while left > clusters:
        rows = different.select(*keys, "id", "features").join(small(at), [*keys, "id"])
        asking = rows.join(small(state.where("nn IS NULL").select(*keys, "comp")), [*keys, "comp"])
        cols = [*keys, "comp", "id", "ws", "features"]
        near = cells(asking.select(cols), rows.select(cols), keys, "comp", "comp", -(-asks // len(models)), most,
                     len(models)).applyInArrow(search, f"{_ddl(different, keys)}comp LONG, d DOUBLE, key DOUBLE, nn LONG")
        near = near.groupBy(*keys, "comp").agg(F.min(F.struct("key", "nn", "d")).alias("e"))
        got = scratch.put(near.select(*keys, "comp", F.col("e.nn").alias("nn1"), F.col("e.d").alias("nd1")), f"got-{r}")
        near = state.join(small(got), [*keys, "comp"], "left").withColumns(
            {"nn": F.coalesce("nn", "nn1"), "nd": F.coalesce("nd", "nd1")}).drop("nn1", "nd1")
        end = lambda x, i: near.select(*keys, F.col("comp").alias(x), *[F.col(c).alias(f"{c}{i}") for c in (
            "nn", "nd", "size", "h", "m", "w", "np")])
        lo, hi = end("lo", 1), end("hi", 2).withColumn("nn1", F.col("hi"))
        below = F.greatest("h1", "h2")
        # a distance that rounding put under a child's height is raised above it
        h = F.when(F.col("nd1") < below, below * (1 + 2.0 ** -52)).otherwise(F.greatest("nd1", below))
        raw = [*keys, "lo", "hi", "d", "size", "h", "lo_round", "hi_round", "round"]
        columns = [*keys, "lo", "hi", F.col("nd1").alias("d"), (F.col("size1") + F.col("size2")).alias("size"), h.alias("h"),
                   F.col("m1").alias("lo_round"), F.col("m2").alias("hi_round"), F.lit(r).cast("long").alias("round"),
                   (F.lit(1.0) if strategy == "wavg" else F.col("w1") + F.col("w2")).alias("w"),
                   (F.col("np1") + F.col("np2")).alias("np")]
        seen = Observation()
        merged = scratch.put(lo.where("lo < nn1").join(hi, [*keys, "nn1"]).where("nn2 = lo").select(columns).observe(
            seen, F.count(F.lit(1)).alias("n")), f"found-{r}")
        if not seen.get["n"]:       # rounding made a circle of neighbours: the least pair of all, of each model
            least = near.where("nn IS NOT NULL").groupBy(*keys).agg(F.min(F.struct(
                "nd", F.least("comp", "nn").alias("lo"), F.greatest("comp", "nn").alias("nn1"))).alias("e"))
            least = least.select(*keys, "e.lo", "e.nn1", F.col("e.nd").alias("nd1"))
            merged = scratch.put(lo.drop("nn1", "nd1").join(least, [*keys, "lo"]).join(hi, [*keys, "nn1"]).select(columns),
                                 f"least-{r}")
        found.append(merged.select(raw))
        ends = merged.select(*keys, F.col("lo").alias("comp"), F.col("lo").alias("to")).unionByName(
            merged.select(*keys, F.col("hi").alias("comp"), F.col("lo").alias("to")))
        keep = near.join(small(ends), [*keys, "comp"], "left_anti")
        # a neighbour that merged is none any more
        keep = keep.join(small(ends.select(*keys, F.col("comp").alias("nn"), "to")), [*keys, "nn"], "left").withColumns(
            {"nd": F.when(F.col("to").isNull(), F.col("nd")), "nn": F.when(F.col("to").isNull(), F.col("nn"))})
        new = merged.select(*keys, F.col("lo").alias("comp"), "w", "size", "h", F.lit(r).cast("long").alias("m"), "np",
                            none.alias("nn"), F.lit(None).cast("double").alias("nd"))
        ws = F.when(F.col("to").isNotNull(), F.col("ws") / 2).otherwise(F.col("ws")) if strategy == "wavg" else F.col("ws")
        at = scratch.put(at.join(small(ends), [*keys, "comp"], "left").select(
            *keys, "id", F.coalesce("to", "comp").alias("comp"), ws.alias("ws")), f"at-{r + 1}")
        state, left, asks = put(keep.select(state.columns).unionByName(new), f"clusters-{r + 1}")
        for name in ("clusters", "at", "got"):
            scratch.drop(f"{name}-{r}")
        r += 1
    table = pairs_of_clusters(different, at, state, most, dim, strategy, keys, small)
    return table, found, left, r


def pairs_of_clusters(different: DataFrame, at: DataFrame, state: DataFrame, n: int, dim: int, strategy: str,
                      keys: list[str], small) -> DataFrame:
    """Round state of ``linkage``: the distances of all pairs of clusters, and a row for
    each cluster.  Blocks of whole clusters meet in pairs; ``n`` points of a model at most."""
    nb = max(1, min(256, -(-n // 8192)))
    rows = different.select(*keys, "id", "features").join(small(at), [*keys, "id"])
    met = rows.withColumn("own", F.pmod(F.xxhash64("comp"), F.lit(nb)).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).select(
        *keys, "comp", "id", "ws", "features", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))

    def meet(key, rows):
        own, (bi, bj) = rows["own"].to_numpy(), [k.as_py() for k in key[-2:]]
        parts = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))]
        sides = [rows.filter(pa.array(own == b)) for b in (bi, bj)]
        if all(len(s) for s in sides):
            one, two = (Clusters(s, dim) for s in sides)
            for first, s in strips(one, two, strategy):
                x, c = one.names[first:first + len(s)], one.w[first:first + len(s), None] * two.w[None, :]
                i, j = np.nonzero(x[:, None] < two.names[None, :]) if bi == bj else (a.ravel() for a in np.indices(s.shape))
                parts.append((x[i], two.names[j], s[i, j], c[i, j]))
        x, y, s, c = map(np.concatenate, zip(*parts))
        return _named(keys, key, {"a": np.minimum(x, y), "b": np.maximum(x, y), "d": s / c if strategy == "avg" else s, "s": s,
                                  "c": np.rint(c).astype(np.int64)})

    by, parts = [*keys, "bi", "bj"], max(at.sparkSession.sparkContext.defaultParallelism, nb * (nb + 1) // 2)
    edges = met.repartition(parts, *by).groupBy(*by).applyInArrow(
        meet, f"{_ddl(different, keys)}a LONG, b LONG, d DOUBLE, s DOUBLE, c LONG")
    none, avg = F.lit(None), strategy == "avg"
    edges = edges.select(*keys, "a", "b", "d", (F.col("s") if avg else none.cast("double")).alias("s"),
                         (F.col("c") if avg else none.cast("long")).alias("c"), none.cast("long").alias("m"))
    return edges.unionByName(state.select(
        *keys, F.col("comp").alias("a"), F.col("comp").alias("b"), F.col("h").alias("d"), none.cast("double").alias("s"),
        F.col("size").alias("c"), "m"))


# ------------------------------------------------- points of other components
def nearest_foreign_in_cells(needy: DataFrame, others: DataFrame, dim: int, asks: int, n: int) -> DataFrame:
    """Nearest point of another component, ``(id, d, nn)``, as ``nearest_foreign`` of all
    blocks: ``needy (id, comp, blk, features)`` against ``others (nn, c2, blk, f2)``.
    Products find the candidates, differences in the order of the components decide."""
    def search(key, one, two):
        two = two.rename_columns([c.rstrip("_") for c in two.column_names])
        ids, comps = one["id"].to_numpy(), one["comp"].to_numpy()
        parts = [(np.zeros(0, int), np.zeros(0), np.zeros(0, int))]
        if len(one) and len(two):
            two = two.sort_by("nn")
            x, y, names, others = vectors(one["features"], dim), vectors(two["f2"], dim), two["nn"].to_numpy(), two["c2"].to_numpy()
            measured = Measured(y)
            step, norm = max(16, TILE // len(y)), (y * y).sum(axis=1).max()
            for at in range(0, len(x), step):
                some = x[at:at + step]
                d2 = measured.squares(some)
                d2[comps[at:at + step, None] == others[None, :]] = np.inf
                least = d2.min(axis=1)
                i, j = np.nonzero(d2 <= (least + 1e-11 * ((some * some).sum(axis=1) + norm))[:, None])
                real = np.isfinite(d2[i, j])
                i, j = i[real], j[real]
                exact = np.zeros(len(i))
                for c in range(dim):                             # in the order in which Spark adds up
                    d = some[i, c] - y[j, c]
                    exact += d * d
                exact = np.sqrt(exact)
                order = np.lexsort((names[j], exact, i))
                order = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))] if len(i) else order
                parts.append((ids[at + i[order]], exact[order], names[j[order]]))
        return pa.table(dict(zip(("id", "d", "nn"), map(np.concatenate, zip(*parts)))))

    found = cells(needy.withColumnRenamed("blk", "home").select("id", "comp", "home", "features"),
                  others.withColumnRenamed("blk", "home"), [], "id", "home", asks, n).applyInArrow(
        search, "id LONG, d DOUBLE, nn LONG")
    return found.groupBy("id").agg(F.min(F.struct("d", "nn")).alias("e")).select("id", "e.*")
