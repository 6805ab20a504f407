"""Single linkage from a minimum spanning tree.

Edges are compared by ``(d, p, q)``, the distance and the leaf pair ``p < q``
(Kruskal's order), which no two edges share, so the tree is unique.

* ``spanning_tree``: Boruvka rounds over a pair table.  Every component hooks to
  the other end of its least edge, pointer jumping contracts the hooked
  components, inner and parallel edges go.  At least half of the components
  disappear in a round, so there are at most ceil(log2 n).
* ``spanning_tree_of_points``: the same rounds without a pair table.  The state
  is one row per point; the nearest point of another component is searched in
  ball-shaped blocks of points that triangle bounds cannot exclude.
* ``number_tree``: the merge table of the tree's edges.  A range of consecutive
  edges is halved: the lighter half's components, named by their last merge,
  are the points of the heavier half, and both halves go on independently, all
  ranges of a level at once, down to ranges of a bounded number of edges.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.vectors import sq_euclidean
from ..plans.ranking import global_rank
from ..session import DEFAULT_BROADCAST_BYTES, Scratch, fits_broadcast
from .dendrogram import root_of
from .pairs import check_points

#: Edges of one range that a task numbers by itself.
RANGE_EDGES = 1 << 17
#: Points of one block of the nearest-point search.
BLOCK_POINTS = 1024


# ------------------------------------------------------------ contraction
def _hooks(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """``chosen (keys, x, d, p, q, a, b)``, the least edge of each component ->
    ``(keys, node, up)``: x hangs on the other end.  Two components that chose
    the same edge would hang on each other; the smaller one stays a root."""
    other = F.when(F.col("x") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    both = chosen.groupBy(*keys, "p", "q").agg(F.count(F.lit(1)).alias("votes"))
    return (chosen.withColumn("up", other).join(both, [*keys, "p", "q"])
            .where((F.col("votes") == 1) | (F.col("x") > F.col("up")))
            .select(*keys, F.col("x").alias("node"), "up"))


def _contract(chosen: DataFrame, keys: list[str], scratch: Scratch, components: int,
              broadcast_bytes: int) -> DataFrame:
    """``(keys, node, up)``: the root of every component that hooks to another
    one; broadcast if ``components`` rows fit."""
    roots = root_of(_hooks(chosen, keys), scratch, keys)
    return F.broadcast(roots) if fits_broadcast(components, 40, broadcast_bytes) else roots


def spanning_tree(pairs: DataFrame, n: int, scratch: Scratch, broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                  keys: list[str] | None = None, models: int = 1) -> tuple[DataFrame, int]:
    """Edges ``(keys, p, q, d)`` of the minimum spanning forest of a pair table
    ``(keys, id1, id2, dist)``, and the number of rounds.  ``keys`` separate
    ``models`` independent tables that share the rounds."""
    keys = keys or []
    tag = f"tree-{uuid.uuid4().hex[:8]}"
    p, q = F.least("id1", "id2").cast("long"), F.greatest("id1", "id2").cast("long")
    state = pairs.where("id1 <> id2").select(*keys, p.alias("a"), q.alias("b"), F.col("dist").cast("double").alias("d"),
                                            p.alias("p"), q.alias("q"))
    seen = Observation()
    state = scratch.put(state.observe(seen, F.count(F.lit(1)).alias("n")), f"{tag}-0")
    found, r, left = [], 0, seen.get["n"]
    while left:
        ends = lambda a, b: F.explode(F.array(a, b)).alias("x")
        near = state.select(*keys, ends("a", "b"), "d").groupBy(*keys, "x").agg(F.min("d").alias("least"))
        # at most n / 2^r components are left after r rounds
        small = fits_broadcast(max(1, (n * models) >> r), 40, broadcast_bytes)
        near = F.broadcast(near) if small else near
        na = near.select(*keys, F.col("x").alias("a"), F.col("least").alias("da"))
        nb = near.select(*keys, F.col("x").alias("b"), F.col("least").alias("db"))
        # only edges that attain the least distance of an end are compared whole
        few = state.join(na, [*keys, "a"]).join(nb, [*keys, "b"]).where("d = da OR d = db").select(
            *keys, F.struct("d", "p", "q", "a", "b").alias("e"),
            F.explode(F.array_compact(F.array(F.when(F.col("d") == F.col("da"), F.col("a")),
                                              F.when(F.col("d") == F.col("db"), F.col("b"))))).alias("x"))
        chosen = scratch.put(few.groupBy(*keys, "x").agg(F.min("e").alias("e")).select(*keys, "x", "e.*"), f"{tag}-chosen-{r}")
        found.append(chosen.select(*keys, "p", "q", "d"))
        to = _contract(chosen, keys, scratch, (n * models) >> r, broadcast_bytes)
        ta = to.select(*keys, F.col("node").alias("a"), F.col("up").alias("ra"))
        tb = to.select(*keys, F.col("node").alias("b"), F.col("up").alias("rb"))
        moved = state.join(ta, [*keys, "a"], "left").join(tb, [*keys, "b"], "left").select(
            *keys, F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"), "d", "p", "q").where("x <> y")
        least = moved.groupBy(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
            F.min(F.struct("d", "p", "q")).alias("e"))
        r += 1
        seen = Observation()
        state = scratch.put(least.select(*keys, "a", "b", "e.*").observe(seen, F.count(F.lit(1)).alias("n")), f"{tag}-{r}")
        left = seen.get["n"]
        scratch.drop(f"{tag}-{r - 1}")
    scratch.drop(f"{tag}-{r}")
    if not found:
        return state.select(*keys, "p", "q", "d"), 0
    return reduce(DataFrame.unionByName, found).distinct(), r


# ------------------------------------------------- nearest points in blocks
def ball_blocks(points: DataFrame, n: int, dim: int, scratch: Scratch, block_points: int = BLOCK_POINTS,
                broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Points dealt into balls: ``(id, features, blk)`` and the blocks ``(blk,
    center, radius, n)``.

    About n / ``block_points`` points, those with the smallest hash, are pivots;
    a point belongs to the nearest one.  A ball of more points than that is cut
    by id into blocks that share its center, so one crowded place does not make
    one large block.  Blocks are as large as it takes for their centers (three
    for each two that are expected) to fit the broadcast limit."""
    block_points = max(block_points, math.ceil(3 * n * (dim * 8 + 64) / broadcast_bytes))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("pivot"), "id"), 11) / F.lit(float(1 << 53))
    first = points.select(F.min("id")).first()[0]
    pivots = scratch.put(points.where((place <= 1 / block_points) | (F.col("id") == first)).select(
        F.col("id").alias("pivot"), F.col("features").alias("center")), "pivots")
    near = points.select("id", "features").join(F.broadcast(pivots)).select(
        "id", "pivot", sq_euclidean("features", "center", dim=dim).alias("d2"))
    at = scratch.put(near.groupBy("id").agg(F.min_by("pivot", "d2").alias("pivot"), F.sqrt(F.min("d2")).alias("far")), "nearest")
    cuts = at.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_points)).alias("cuts"))
    blk = (F.shiftleft("pivot", 20) + F.pmod(F.xxhash64("id"), F.col("cuts"))).alias("blk")
    dealt = scratch.put(at.join(F.broadcast(cuts), "pivot").select("id", "far", "pivot", blk), "dealt")
    blocks = dealt.groupBy("blk", "pivot").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    return (scratch.put(points.select("id", "features").join(dealt.select("id", "blk"), "id"), "points"),
            scratch.put(blocks.join(pivots, "pivot").select("blk", "center", "radius", "n"), "blocks"))


def nearest_foreign(needy: DataFrame, others: DataFrame, dim: int, chunk: int = 1024) -> DataFrame:
    """Nearest point of another component, ``(id, d, nn)``: ``needy (id, comp,
    blk, features)`` against the points ``others (nn, c2, blk, f2)`` of the block;
    equal distances go to the smaller id.  The points that ask for a block are
    cut into chunks, each of which meets a copy of the block."""
    asked = needy.groupBy("blk").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("chunks"))
    asked = F.broadcast(asked)                               # a row per block
    left = needy.join(asked, "blk").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).drop("chunks")
    right = others.join(asked, "blk").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def vectors(column):
        return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)

    def search(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.sort_by("nn")
        x, y = vectors(one["features"]), vectors(two["f2"]) if len(two) else np.zeros((0, dim))
        d2 = np.zeros((len(x), len(y)))
        for j in range(dim):                                 # in the order in which Spark adds up
            d = x[:, j, None] - y[None, :, j]
            d2 += d * d
        d2[one["comp"].to_numpy()[:, None] == two["c2"].to_numpy()[None, :]] = np.inf
        at = d2.argmin(axis=1) if len(y) else np.zeros(0, int)
        d = np.sqrt(d2[np.arange(len(at)), at])
        hit = np.isfinite(d)
        return pa.table({"id": one["id"].to_numpy()[:len(at)][hit], "d": d[hit], "nn": two["nn"].to_numpy()[at[hit]]})

    found = left.groupBy("blk", "chunk").cogroup(right.groupBy("blk", "chunk")).applyInArrow(
        search, "id LONG, d DOUBLE, nn LONG")
    return found.groupBy("id").agg(F.min(F.struct("d", "nn")).alias("e")).select("id", "e.*")


def spanning_tree_of_points(points: DataFrame, scratch: Scratch, block_points: int = BLOCK_POINTS,
                            broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                            dense: bool = True) -> tuple[DataFrame, list[dict]]:
    """Edges ``(p, q, d)`` of the minimum spanning tree of points with ids 1..n
    (``dense``; else any different ids),
    without a table of pairs; and for each round the components, the points that
    searched, and the share of all pairs that was compared.

    The state is one row per point: its component, its nearest point of another
    component, and a distance that its nearest one cannot be below.  A nearest
    point stays the nearest until it joins the component; a point whose bound
    exceeds its component's best edge need not search.  Those that search look
    through their own block, then through the blocks that the bound
    ``|x - center| - radius`` does not exclude; in many dimensions through all
    blocks, groups of which meet groups of points."""
    from .cells import CELL_DIM, nearest_foreign_in_cells
    n, dim = check_points(points, dense=dense)
    if n == 0:
        return points.sparkSession.createDataFrame([], "p LONG, q LONG, d DOUBLE"), []
    pts, blocks = ball_blocks(points, n, dim, scratch, block_points, broadcast_bytes)
    state = scratch.put(pts.select("id", "blk", F.col("id").alias("comp"), F.lit(None).cast("long").alias("nn"),
                                   F.lit(0.0).alias("d")), "state-0")
    found, log, left, r = [], [], n, 0
    while left > 1:
        small = F.broadcast if fits_broadcast(left, 48, broadcast_bytes) else (lambda df: df)
        searching, asking = Observation(), Observation()
        known = state.where("nn IS NOT NULL").groupBy("comp").agg(F.min("d").alias("best"))
        needy = state.where("nn IS NULL").join(small(known), "comp", "left").where("best IS NULL OR d <= best")
        if dim >= CELL_DIM:                          # bounds exclude next to nothing: all blocks, a group of them to a task
            needy = scratch.put(needy.select("id", "comp").observe(searching, F.count(F.lit(1)).alias("n")), f"needy-{r}")
            at = F.broadcast(state.select("id", "comp")) if fits_broadcast(n, 48, broadcast_bytes) else state.select("id", "comp")
            here = pts.join(at, "id").select(F.col("id").alias("nn"), F.col("features").alias("f2"), F.col("comp").alias("c2"), "blk")
            asks = searching.get["n"]
            few = F.broadcast(needy) if fits_broadcast(asks, 48, broadcast_bytes) else needy
            got = nearest_foreign_in_cells(pts.join(few, "id"), here, dim, asks, n).select(
                "id", F.col("nn").alias("nn1"), F.col("d").alias("d1"))
        else:
            needy = scratch.put(needy.join(pts.select("id", "features"), "id").select("id", "blk", "comp", "features", "best")
                                .observe(searching, F.count(F.lit(1)).alias("n")), f"needy-{r}")
            here = scratch.put(pts.join(state.select("id", "comp"), "id").select(
                F.col("id").alias("nn"), F.col("features").alias("f2"), F.col("comp").alias("c2"), "blk"), f"here-{r}")
            own = scratch.put(nearest_foreign(needy.select("id", "comp", "blk", "features"), here, dim), f"own-{r}")
            spans = here.groupBy("blk").agg(F.min("c2").alias("c_lo"), F.max("c2").alias("c_hi"))
            away = F.sqrt(sq_euclidean("features", "center"))        # inside join conditions: kept small
            elsewhere = (F.col("blk") != F.col("home")) & ((F.col("c_lo") != F.col("comp")) | (F.col("c_hi") != F.col("comp")))
            # a component's search is limited by its best edge so far, or by the
            # farthest that a point of a block which holds others can lie
            asks = needy.withColumnRenamed("blk", "home").join(F.broadcast(blocks.join(spans, "blk")), elsewhere)
            reached = needy.join(own, "id").groupBy("comp").agg(F.min("d").alias("near")).join(
                asks.groupBy("comp").agg(F.min(away + F.col("radius")).alias("within")), "comp", "full")
            limited = needy.join(small(reached), "comp", "left").select(
                "id", F.col("blk").alias("home"), "comp", "features", F.least("best", "near", "within").alias("limit"))
            slack = 1e-9 * (away + F.col("radius") + F.col("limit"))              # rounding of the bounds
            asked = limited.join(F.broadcast(blocks.join(spans, "blk")),
                                 elsewhere & (away - F.col("radius") - slack <= F.col("limit"))).select(
                "id", "comp", "blk", "features", "n")
            asked = scratch.put(asked.observe(asking, F.coalesce(F.sum("n"), F.lit(0)).alias("n")), f"asked-{r}")
            far = nearest_foreign(asked.drop("n"), here, dim)
            best = own.unionByName(far).groupBy("id").agg(F.min(F.struct("d", "nn")).alias("e"))
            got = limited.select("id", "limit").join(best, "id", "left")
            # beyond the limit a find is only a bound: nearer points may lie in skipped blocks
            sure = F.col("e.d") <= F.col("limit") + 1e-9 * F.col("limit")
            got = got.select("id", F.when(sure, F.col("e.nn")).alias("nn1"), F.least("e.d", "limit").alias("d1"))
        after = scratch.put(state.join(got, "id", "left").select(
            "id", "blk", "comp", F.coalesce("nn1", "nn").alias("nn"), F.greatest("d", "d1").alias("d")), f"after-{r}")
        least = after.where("nn IS NOT NULL").groupBy(F.col("comp").alias("x")).agg(F.min(F.struct(
            "d", F.least("id", "nn").alias("p"), F.greatest("id", "nn").alias("q"), "nn")).alias("e"))
        other = after.select(F.col("id").alias("nn"), F.col("comp").alias("other"))
        chosen = least.select("x", "e.*").join(other, "nn").select(
            "x", "d", "p", "q", F.least("x", "other").alias("a"), F.greatest("x", "other").alias("b"))
        chosen = scratch.put(chosen, f"chosen-{r}")
        found.append(chosen.select("p", "q", "d"))
        to = _contract(chosen, [], scratch, left, broadcast_bytes)
        moved = scratch.put(after.join(to.select(F.col("node").alias("comp"), "up"), "comp", "left").select(
            "id", "blk", F.coalesce("up", "comp").alias("comp"), "nn", "d"), f"moved-{r}")
        # a nearest point that joined the component is none any more
        theirs = moved.select(F.col("id").alias("nn"), F.col("comp").alias("c2"))
        state = scratch.put(moved.join(theirs, "nn", "left").select(
            "id", "blk", "comp", F.when(F.col("c2") != F.col("comp"), F.col("nn")).alias("nn"), "d"), f"state-{r + 1}")
        if dim >= CELL_DIM:
            met = searching.get["n"] * n
        else:
            met = asking.get["n"] + needy.join(blocks, "blk").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        log.append({"components": left, "searched": searching.get["n"], "compared": met / max(1, n * (n - 1))})
        left = state.agg(F.count_distinct("comp")).first()[0]
        for name in ("state", "needy", "here", "own", "asked", "after", "moved"):
            scratch.drop(f"{name}-{r}")
        r += 1
    if not found:
        return points.sparkSession.createDataFrame([], "p LONG, q LONG, d DOUBLE"), log
    return reduce(DataFrame.unionByName, found).distinct(), log


# ------------------------------------------------------------- numbering
def forest_roots(edges: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``(keys, a, b)`` -> ``(keys, node, root)``: the smallest node of each
    component, in star rounds (every edge is hung on the smallest neighbour of
    its larger, then of its smaller end, until all hang on one)."""
    tag = f"stars-{uuid.uuid4().hex[:8]}"

    def digest(df):
        seen = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*keys, "a", "b")).alias("x"),
                          F.bit_xor(F.xxhash64("b", *keys, "a")).alias("y")), seen

    up = edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    up, seen = digest(up)
    up, i = scratch.put(up, f"{tag}-0"), 0
    mark = tuple(seen.get.values())
    while mark[0]:
        both = up.unionByName(up.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [*keys, "a"]).where("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        nxt, seen = digest(small.unionByName(least.select(*keys, "a", F.col("m").alias("b"))).distinct())
        i += 1
        up = scratch.put(nxt, f"{tag}-{i}")
        scratch.drop(f"{tag}-{i - 1}")
        now = tuple(seen.get.values())
        if now == mark:
            break
        mark = now
    return up.select(*keys, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        up.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _merge_range(edges: pd.DataFrame, n: int) -> pd.DataFrame:
    """Children and sizes of the merges of one range of edges, in their order;
    ``a`` and ``b`` name the clusters that stood before the range."""
    edges = edges.sort_values("r")
    up: dict[int, int] = {}
    now: dict[int, tuple[int, int]] = {}

    def top(x):
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    rows = []
    for r, a, b, sa, sb in zip(edges["r"], edges["a"], edges["b"], edges["sa"], edges["sb"]):
        ta, tb = top(a), top(b)
        (ca, na), (cb, nb) = now.get(ta, (a, sa)), now.get(tb, (b, sb))
        up[ta] = tb
        now[tb] = (n + 1 + r, na + nb)
        leaves = ca <= n and cb <= n
        rows.append((min(ca, cb), max(ca, cb), na + nb) if leaves else (max(ca, cb), min(ca, cb), na + nb))
    out = edges[["r", "d"]].copy()
    out["point1"], out["point2"], out["size"] = zip(*rows)
    return out


def number_tree(tree: DataFrame, n: int, scratch: Scratch, keys: list[str] | None = None,
                range_edges: int = RANGE_EDGES) -> DataFrame:
    """Merge table ``(keys, cluster, point1, point2, height, size)`` of spanning
    tree edges ``(keys, p, q, d)``.

    The edges' rank is the merge's number.  While a range has more than
    ``range_edges`` edges it is halved, all ranges of a level in the same jobs;
    a task numbers at most that many edges."""
    keys = keys or []
    ranked = global_rank(tree, [*keys, "d", "p", "q"], out="r", start=0)
    if keys:
        first = ranked.groupBy(*keys).agg(F.min("r").alias("first"))            # one row per model
        ranked = ranked.join(F.broadcast(first), keys).withColumn("r", F.col("r") - F.col("first")).drop("first")
    one = F.lit(1).cast("long")
    edges = scratch.put(ranked.select(*keys, "r", F.col("p").alias("a"), F.col("q").alias("b"), one.alias("sa"),
                                      one.alias("sb"), "d"), "ranked")
    width = size = range_edges
    while width < n - 1:
        width *= 2
    level = 0
    while width > size:
        half = width // 2
        part = edges.withColumn("g", F.floor(F.col("r") / F.lit(width)).cast("long"))
        light = scratch.put(part.where(F.col("r") % width < half), f"light-{level}")
        roots = scratch.put(forest_roots(light.select(*keys, "g", "a", "b"), [*keys, "g"], scratch), f"roots-{level}")
        at = [*keys, "g", "node"]
        sizes = light.select(*keys, "g", F.col("a").alias("node"), F.col("sa").alias("s")).unionByName(
            light.select(*keys, "g", F.col("b").alias("node"), F.col("sb").alias("s"))).distinct()
        last = light.select(*keys, "g", F.col("a").alias("node"), "r")
        named = (roots.join(sizes, at).groupBy(*keys, "g", "root").agg(F.sum("s").alias("s"))
                 .join(roots.join(last, at).groupBy(*keys, "g", "root").agg((F.max("r") + n + 1).alias("name")),
                       [*keys, "g", "root"]))
        to = scratch.put(roots.join(named, [*keys, "g", "root"]).select(*at, "name", "s"), f"names-{level}")
        heavy = part.where(F.col("r") % width >= half)
        for end in "ab":
            side = to.select(*keys, "g", F.col("node").alias(end), F.col("name").alias("to"), F.col("s").alias("ts"))
            heavy = heavy.join(side, [*keys, "g", end], "left").withColumns(
                {f"s{end}": F.coalesce("ts", f"s{end}"), "moved": F.coalesce("to", end)}).drop("to", "ts", end).withColumnRenamed(
                "moved", end)
        cols = [*keys, "r", "a", "b", "sa", "sb", "d"]
        edges = scratch.put(light.select(cols).unionByName(heavy.select(cols)), f"edges-{level}")
        for name in (f"light-{level}", f"roots-{level}", f"names-{level}", f"edges-{level - 1}" if level else "ranked"):
            scratch.drop(name)
        width, level = half, level + 1
    schema = f"{''.join(f'{k} {dict(tree.dtypes)[k]}, ' for k in keys)}r LONG, d DOUBLE, point1 LONG, point2 LONG, size LONG"

    def merge(key, rows):
        out = _merge_range(rows, n)
        for k in keys:
            out.insert(0, k, rows[k].iloc[0])
        return out

    done = edges.withColumn("g", F.floor(F.col("r") / F.lit(size)).cast("long")).groupBy(*keys, "g").applyInPandas(
        lambda key, rows: merge(key, rows)[[c.split()[0] for c in schema.split(", ")]], schema)
    return done.select(*keys, (F.col("r") + n + 1).alias("cluster"), "point1", "point2", F.col("d").alias("height"), "size")
