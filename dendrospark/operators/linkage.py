"""Agglomerative hierarchical clustering (C1-C10) in distributed rounds.

Single linkage goes by the minimum spanning tree (``spanning``).  The others run
in rounds of reciprocal nearest neighbours (RNN): every round, each active
cluster picks its nearest neighbour under a strict total order of cluster pairs;
pairs that pick each other merge, all at once.  Complete, size-weighted average
(UPGMA) and plain average (WPGMA) linkage are *reducible*, so merging every
reciprocal pair in one round yields the same dendrogram as merging the single
closest pair per step (Murtagh 1983; Muellner 2011), but in tens of rounds
instead of n-1 steps.

The order, for ties and exact duplicates, does not depend on the rounds: it is
``(d, lo, hi)``, the smallest leaves of the two clusters.  A merge's key exceeds
those of the merges below it, and merges are numbered by that key: this is the
sequence of the one-merge-per-step procedure.

Round state is one table written to the scratch folder under
``spark.checkpoint.dir`` (lineage cut, fresh size estimates):

* edge rows ``(a, b, d[, s, c])`` with ``a < b``; a cluster is named by
  its smallest leaf id during the rounds.  UPGMA edges carry the sum ``s`` of
  all cross-pair distances and their count ``c``, so merging is
  ``sum, sum`` with no weights.
* node rows ``a = b = rep`` with ``d`` = effective height, ``c`` = size, ``m`` =
  the round of its last merge; relabelling folds a merged pair's node rows and
  their edge into one.
* merges of round r ``(lo, hi, d, size, h, lo_round, hi_round)``, one folder per
  round; the last two say which earlier merges are the children.

Only the edges that touch a merged cluster are shuffled and re-aggregated;
the rest pass through.  Nothing but counts reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.ranking import global_rank
from ..session import DEFAULT_BROADCAST_BYTES, Scratch, fits_broadcast
from .cells import CELL_DIM, merge_cells
from .cluster_search import all_merges, merge_copies, merge_down, table_of
from .pairs import STRATEGIES, check_points, pairwise_distances
from .spanning import BLOCK_POINTS, RANGE_EDGES, number_tree, spanning_tree, spanning_tree_of_points
from .tree import contract, members, tour

MERGE_COLS = ["cluster", "point1", "point2", "height", "size"]
#: Rows of round state to a partition.
ROWS_A_PARTITION = 250_000
#: Linkage of more points than that goes without a table of all pairs.
PAIR_TABLE_POINTS = 4096
#: Clusters that are left when their table of pairs is made.
TABLE_CLUSTERS = 2048


def _initial_state(pairs: DataFrame, n: int, strategy: str, keys: list[str],
                   models: list | None) -> DataFrame:
    """Round state: edge rows ``a < b`` (``d``; UPGMA also ``s`` = sum of cross
    distances and ``c`` = their count) and one node row ``a = b = rep`` per
    cluster (``d`` = its height, ``c`` = its size, ``m`` = the round of its last
    merge), per model key if any."""
    e = pairs.select(*keys, F.least("id1", "id2").cast("long").alias("a"),
                     F.greatest("id1", "id2").cast("long").alias("b"),
                     F.col("dist").cast("double").alias("d"))
    e = e.where(F.col("a") != F.col("b"))
    avg, none = strategy == "avg", F.lit(None).cast("long")
    e = e.select(*keys, "a", "b", "d", (F.col("d") if avg else F.lit(None).cast("double")).alias("s"),
                 (F.lit(1).cast("long") if avg else none).alias("c"), none.alias("m"))
    nodes = pairs.sparkSession.range(1, n + 1)
    if keys:
        nodes = nodes.withColumn(keys[0], F.explode(F.array(*[F.lit(m) for m in models])))
    nodes = nodes.select(*keys, F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d"),
                         F.lit(None).cast("double").alias("s"), F.lit(1).cast("long").alias("c"), none.alias("m"))
    return e.unionByName(nodes)


def _reaggregate(rows: DataFrame, strategy: str, keys: list[str], r: int) -> DataFrame:
    """Regroup relabelled rows after round ``r``.  A group ``a = b`` is a merged
    cluster's node: its old node rows and the merge edge; height = max, size =
    sum of the node sizes.  A group ``a < b`` holds only edge rows: max, the mean
    of 2 or 4 child rows (wavg: equal to applying the two merges in turn) or
    ``sum, sum`` (avg).  A mean is never below its smallest part, whatever the
    rounding."""
    node = F.col("a") == F.col("b")
    size = F.sum(F.when(F.col("was_node"), F.col("c")))
    if strategy == "max":
        d = F.max("d")
    elif strategy == "wavg":
        d = F.greatest(F.avg("d"), F.min("d"))
    else:
        d = F.greatest(F.sum("s") / F.sum("c"), F.min("d"))
    return rows.groupBy(*keys, "a", "b").agg(
        F.when(node, F.max("d")).otherwise(d).alias("d"),
        (F.when(~node, F.sum("s")) if strategy == "avg" else F.lit(None).cast("double")).alias("s"),
        F.when(node, size).otherwise(F.sum("c") if strategy == "avg" else F.lit(None).cast("long"))
        .alias("c"), F.when(node, F.lit(r)).cast("long").alias("m"))


def _reciprocal_pairs(state: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Edges that are the nearest neighbour of both their ends, with the merged
    cluster's size and height and the rounds of the ends' last merges.  The
    distance to the nearest neighbour is a hash aggregate over primitive values;
    only edges that attain it at one end are compared by the whole key."""
    is_edge = F.col("a") < F.col("b")
    edges = state.where(is_edge).select(*keys, "a", "b", "d")
    # both ends of each edge; a node row once
    at = F.explode(F.when(is_edge, F.array("a", "b")).otherwise(F.array("a"))).alias("x")
    own = lambda c: F.max(F.when(~F.col("e"), F.col(c)))
    near = state.select(*keys, at, "d", "c", "m", is_edge.alias("e")).groupBy(*keys, "x").agg(
        F.min(F.when(F.col("e"), F.col("d"))).alias("least"), own("c").alias("size"), own("d").alias("h"), own("m").alias("m"))
    near = F.broadcast(near) if small else near
    na = near.select(*keys, F.col("x").alias("a"), F.col("least").alias("da"), F.col("size").alias("sa"),
                     F.col("h").alias("ha"), F.col("m").alias("ma"))
    nb = near.select(*keys, F.col("x").alias("b"), F.col("least").alias("db"), F.col("size").alias("sb"),
                     F.col("h").alias("hb"), F.col("m").alias("mb"))
    few = edges.join(na, [*keys, "a"]).join(nb, [*keys, "b"]).where("d = da OR d = db").select(
        *keys, F.struct("d", "a", "b", (F.col("sa") + F.col("sb")).alias("size"),
                        F.greatest("d", "ha", "hb").alias("h"), "ma", "mb").alias("e"),
        F.explode(F.filter(F.array(F.struct(F.col("a").alias("x"), F.col("da").alias("least")),
                                   F.struct(F.col("b").alias("x"), F.col("db").alias("least"))),
                           lambda y: y["least"] == F.col("d"))).alias("y"))
    nn = few.groupBy(*keys, "y.x").agg(F.min("e").alias("e"))
    mutual = nn.groupBy(*keys, "e").agg(F.count(F.lit(1)).alias("votes")).where("votes = 2")
    return mutual.select(*keys, F.col("e.a").alias("lo"), F.col("e.b").alias("hi"), "e.d", "e.size", "e.h",
                         F.col("e.ma").alias("lo_round"), F.col("e.mb").alias("hi_round"))


def rnn_rounds(pairs: DataFrame, n: int, strategy: str, scratch: Scratch,
               broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, model: str | None = None,
               models: list | None = None, first_round: int = 0) -> tuple[DataFrame, int]:
    """Run RNN rounds until no edge is left.  Returns the raw merges
    ``([model,] lo, hi, d, size, h, lo_round, hi_round, round)``, n-1 rows per
    model, and the number of rounds.

    ``model`` names a key column of ``pairs`` that separates independent
    dendrograms (e.g. one per feature prefix): they advance through the same
    rounds and jobs, so M models cost about one model's rounds, not M.

    ``pairs`` may also be a round state of n clusters with columns ``a, b, d, s,
    c, m``, whose merges so far had rounds below ``first_round``.

    Each round writes its merges, then the relabelled state, as Parquet in the
    scratch folder, and drops the state before it: a lost executor costs a
    re-read, never earlier rounds.  The state shrinks geometrically and is
    packed into as many partitions as its rows need."""
    keys = [model] if model else []
    spark = pairs.sparkSession
    state = pairs if "a" in pairs.columns else _initial_state(pairs, n, strategy, keys, models)
    state = scratch.put(state, f"state-{first_round}")
    n_models = len(models) if model else 1
    nodes_fit = fits_broadcast(n * n_models, 40, broadcast_bytes)
    found: list[DataFrame] = []
    r, left = first_round, n * n_models
    while True:
        seen = Observation()
        # at most half of the clusters left merge, each row of them once
        merged = (_reciprocal_pairs(state, keys, nodes_fit).withColumn("round", F.lit(r).cast("long"))
                  .coalesce(max(1, -(-left // ROWS_A_PARTITION))).observe(seen, F.count(F.lit(1)).alias("n")))
        merged = scratch.put(merged, f"merges-{r}")
        cnt = seen.get["n"]
        if cnt == 0:
            break
        found.append(merged)
        # relabel map: both ends of a merge are now named by its lo
        t = (merged.select(*keys, F.col("lo").alias("node"), F.col("lo").alias("new"))
             .unionByName(merged.select(*keys, F.col("hi").alias("node"), F.col("lo").alias("new"))))
        if fits_broadcast(2 * cnt, 40, broadcast_bytes):
            t = F.broadcast(t)
        ta = t.select(*keys, F.col("node").alias("a"), F.col("new").alias("na"))
        tb = t.select(*keys, F.col("node").alias("b"), F.col("new").alias("nb"))
        tagged = state.join(ta, [*keys, "a"], "left").join(tb, [*keys, "b"], "left")
        touched = F.col("na").isNotNull() | F.col("nb").isNotNull()
        own = ["d", "s", "c", "m"]
        keep = tagged.where(~touched).select(*keys, "a", "b", *own)
        ea = F.coalesce("na", "a")
        eb = F.coalesce("nb", "b")
        moved = tagged.where(touched).select(
            *keys, F.least(ea, eb).alias("a"), F.greatest(ea, eb).alias("b"), *own,
            (F.col("a") == F.col("b")).alias("was_node"))
        left -= cnt                                     # clusters, of all models
        rows = (left // n_models + 1) ** 2 // 2 * n_models      # as many edges at most
        parts = max(1, -(-rows // ROWS_A_PARTITION))
        r += 1
        state = scratch.put(keep.unionByName(_reaggregate(moved, strategy, keys, r - 1)).coalesce(parts), f"state-{r}")
        scratch.drop(f"state-{r - 1}")
    scratch.drop(f"state-{r}")
    if not found:
        key_ddl = f"{model} {dict(pairs.dtypes)[model]}, " if model else ""
        empty = (f"{key_ddl}lo LONG, hi LONG, d DOUBLE, size LONG, h DOUBLE, lo_round LONG, hi_round LONG, round LONG")
        return spark.createDataFrame([], empty), 0
    return reduce(DataFrame.unionByName, found), r - first_round


def number_merges(raw: DataFrame, n: int, model: str | None = None) -> DataFrame:
    """Turn raw round merges into the merge table.

    Rank by ``(h, lo, hi)``, the order of the one-merge-per-step procedure;
    cluster id = n + rank.  A child is the merge of its representative in the
    round that the parent carries, or the leaf itself.  Children are stored
    (smaller, larger) for two leaves, else (larger, smaller).  With a ``model`` key the rank runs
    within each model (one distributed rank over (model, ...), minus each
    model's first rank)."""
    keys = [model] if model else []
    ranked = global_rank(raw, [*keys, "h", "lo", "hi"], out="idx", start=0)
    if keys:
        first = ranked.groupBy(*keys).agg(F.min("idx").alias("first"))   # one row per model
        ranked = ranked.join(F.broadcast(first), keys).withColumn(
            "idx", F.col("idx") - F.col("first")).drop("first")
    ranked = ranked.withColumn("cluster", F.col("idx") + F.lit(n + 1)).drop("idx")
    made = lambda end: ranked.select(
        *keys, F.col("lo").alias(end), F.col("round").alias(f"{end}_round"), F.col("cluster").alias(f"{end}_cluster"))
    j = ranked.join(made("lo"), [*keys, "lo", "lo_round"], "left").join(made("hi"), [*keys, "hi", "hi_round"], "left")
    c1 = F.coalesce("lo_cluster", "lo")
    c2 = F.coalesce("hi_cluster", "hi")
    leaves = (c1 <= n) & (c2 <= n)
    return j.select(
        *keys, "cluster",
        F.when(leaves, F.least(c1, c2)).otherwise(F.greatest(c1, c2)).alias("point1"),
        F.when(leaves, F.greatest(c1, c2)).otherwise(F.least(c1, c2)).alias("point2"),
        F.col("h").alias("height"), "size")


def linkage_from_pairs(pairs: DataFrame, n: int, strategy: str = "avg", k: int = 1,
                       broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                       model: str | None = None, models: list | None = None) -> DataFrame:
    """Merge table ``([model,] cluster, point1, point2, height,
    size)`` from a pair table ``([model,] id1, id2, dist)`` over ids 1..n; the
    first n-k merges of every model.  A null or NaN distance, an id outside
    1..n or a pair table that leaves points unconnected is an error."""
    _check(strategy, n, k)
    if model and not models:
        raise ValueError("models: the list of model keys is required with model=")
    bad = F.col("dist").isNull() | F.isnan("dist") | ~F.col("id1").between(1, n) | ~F.col("id2").between(1, n)
    scratch = Scratch(pairs.sparkSession, f"linkage-{strategy}")
    checked = pairs.withColumn("dist", F.when(~F.coalesce(bad, F.lit(True)), F.col("dist")).otherwise(
        F.raise_error(F.lit(f"a pair needs ids from 1 to {n} and a distance")).cast("double")))
    if strategy == "min":
        raw, _ = spanning_tree(checked, n, scratch, broadcast_bytes, [model] if model else [], len(models or [0]))
    else:
        raw, _ = rnn_rounds(checked, n, strategy, scratch, broadcast_bytes, model=model, models=models)
    want = (n - 1) * (len(models) if model else 1)
    if (got := raw.count()) != want:
        raise ValueError(f"{got} merges of {want}: the pairs do not connect all points 1..{n}")
    merges = number_tree(raw, n, scratch, [model] if model else []) if strategy == "min" else number_merges(raw, n, model)
    return scratch.put(merges.where(F.col("cluster") <= 2 * n - k), "merge-table")


def _check(strategy: str, n: int, k: int) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    if not 1 <= k <= n:
        raise ValueError(f"k must lie in 1..{n}")


def single_linkage(points: DataFrame, k: int = 1, broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                   block_points: int = BLOCK_POINTS, range_edges: int = RANGE_EDGES) -> DataFrame:
    """C1 without a pair table: the merge table of the spanning tree that
    nearest-point searches find.  The state is a row per different point: copies
    hang on the first of them by id, the least edges at distance 0."""
    n, _ = check_points(points, dense=True)
    _check("min", n, k)
    scratch = Scratch(points.sparkSession, "single-linkage")
    copies, different, _, _ = merge_copies(points, scratch)
    tree, _ = spanning_tree_of_points(different.select("id", "features"), scratch, block_points, broadcast_bytes, dense=False)
    tree = tree.unionByName(copies.select(F.col("lo").alias("p"), F.col("hi").alias("q"), "d"))
    merges = number_tree(scratch.put(tree, "tree"), n, scratch, range_edges=range_edges)
    return scratch.put(merges.where(F.col("cluster") <= 2 * n - k), "merge-table")


def linkage_of_points(points: DataFrame, strategy: str = "avg", k: int = 1,
                      broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, table_clusters: int = TABLE_CLUSTERS,
                      block_points: int | None = None) -> DataFrame:
    """C2-C5 without a table of all pairs: copies merge first, nearest clusters
    are searched in blocks that bounds do not exclude (in many dimensions, where
    next to nothing is excluded, in cells), and ``table_clusters`` of them at most
    meet in a table of pairs."""
    n, dim = check_points(points, dense=True)
    _check(strategy, n, k)
    if strategy == "min":
        return single_linkage(points, k, broadcast_bytes)
    scratch = Scratch(points.sparkSession, f"linkage-{strategy}")
    copies, different, m, r = merge_copies(points, scratch)
    if dim >= CELL_DIM:
        table, found, left, r = merge_cells(different, m, dim, strategy, scratch, table_clusters, r,
                                            broadcast_bytes=broadcast_bytes)
    else:
        state, found, left, r = merge_down(different, m, dim, strategy, scratch, table_clusters, r, block_points, broadcast_bytes)
        table = table_of(state, dim, strategy, m)
    rest, _ = rnn_rounds(table, left, strategy, scratch, broadcast_bytes, first_round=r)
    raw = all_merges(copies, found, rest)
    if (got := raw.count()) != n - 1:
        raise ValueError(f"{got} merges of {n - 1}")
    return scratch.put(number_merges(raw, n).where(F.col("cluster") <= 2 * n - k), "merge-table")


def linkage(points: DataFrame, strategy: str = "avg", k: int = 1, n: int | None = None,
            broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """E1 core: points ``(id, features)`` with ids 1..n -> merge table.  Ids
    with gaps or repeats, and null or NaN components, are errors."""
    n, dim = check_points(points, dense=True)
    if strategy == "min" and n > PAIR_TABLE_POINTS:         # the same merges either way
        return single_linkage(points, k, broadcast_bytes)
    if n > PAIR_TABLE_POINTS:
        return linkage_of_points(points, strategy, k, broadcast_bytes)
    pairs = pairwise_distances(points, n=n, dim=dim, broadcast_bytes=broadcast_bytes)
    return linkage_from_pairs(pairs, n, strategy, k, broadcast_bytes)


def _prefixes_of_points(points: DataFrame, nvs: list[int], strategy: str, k: int, n: int, broadcast_bytes: int,
                        table_clusters: int = TABLE_CLUSTERS) -> DataFrame:
    """``linkage_by_prefix`` without a table of all pairs: the prefixes are models that
    share the rounds of ``merge_cells``.  Vectors are zero beyond their prefix."""
    _check(strategy, n, k)
    scratch = Scratch(points.sparkSession, f"prefixes-{strategy}")
    copies, different, m, r = merge_copies(prefixes(points, nvs), scratch, ["nv"])
    table, found, left, r = merge_cells(different, m, max(nvs), strategy, scratch, table_clusters, r, ["nv"], nvs, broadcast_bytes)
    rest, _ = rnn_rounds(table, left, strategy, scratch, broadcast_bytes, "nv", nvs, first_round=r)
    raw = all_merges(copies, found, rest)
    if (got := raw.count()) != (n - 1) * len(nvs):
        raise ValueError(f"{got} merges of {(n - 1) * len(nvs)}")
    return scratch.put(number_merges(raw, n, "nv").where(F.col("cluster") <= 2 * n - k), "merge-table")


def prefixes(points: DataFrame, nvs: list[int]) -> DataFrame:
    """``(nv, id, features)``: each point once for every prefix, with zeros up to
    the longest."""
    own = F.transform(F.slice("features", 1, max(nvs)), lambda x, i: F.when(i < F.col("nv"), x).otherwise(0.0))
    return points.withColumn("nv", F.explode(F.array(*[F.lit(v) for v in sorted(set(nvs))]))).select(
        "nv", "id", own.alias("features"))


def linkage_by_prefix(points: DataFrame, nvs: list[int], strategy: str = "avg", k: int = 1,
                      n: int | None = None,
                      broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """One dendrogram per feature prefix ``nv`` (the reference's grid), all
    advancing through the same rounds -> ``(nv, cluster, point1, point2,
    height, size)``.  One pair join serves all prefixes: their squared
    distances are sums over consecutive ranges of components.  Of more than
    ``PAIR_TABLE_POINTS`` points there is no table of all pairs (min excepted)."""
    n, dim = check_points(points, dense=True)
    nvs = sorted({int(v) for v in nvs})
    if n > PAIR_TABLE_POINTS and strategy != "min":
        return _prefixes_of_points(points, nvs, strategy, k, n, broadcast_bytes)
    pairs = pairwise_distances(points, n=n, dim=dim, prefixes=nvs, broadcast_bytes=broadcast_bytes)
    return linkage_from_pairs(pairs, n, strategy, k, broadcast_bytes, model="nv", models=nvs)


def linkage_with_assignments(points: DataFrame, strategy: str = "avg", k: int = 1,
                             n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The merge table down to k clusters and the final ``(id, cluster)``
    assignment of every point."""
    from .dendrogram import cut
    n = n or points.count()
    merges = linkage(points, strategy, k)
    return merges, cut(merges, n, k)


def singletons(spark, n: int) -> DataFrame:
    """Every point its own cluster."""
    return spark.range(1, n + 1).select(F.col("id"), F.col("id").alias("cluster"))


def merge_members(merges: DataFrame, n: int, scratch: Scratch | None = None) -> DataFrame:
    """Members of every merge, one row ``(cluster, id)`` for each leaf
    below it: the merge's interval of an Euler tour.  The tour is O(n) rows; only
    the result has a row for each leaf and merge above it."""
    scratch = scratch or Scratch(merges.sparkSession, "members")
    return members(tour(merges, n, scratch), merges.select("cluster"), n)


def midpoints(merges: DataFrame, points: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Per merge, the unweighted midpoint of its two children's centroids
    (a leaf's centroid is its vector) -> ``(cluster, centroid)``, by tree
    contraction: rounds grow with the logarithm of the merges, not the height."""
    scratch = scratch or Scratch(merges.sparkSession, "midpoints")
    got, _ = contract(merges, points.select(F.col("id").alias("node"), F.col("features").alias("value")), 0.5, scratch)
    return got.withColumnRenamed("value", "centroid")


def midpoint_centers(merges: DataFrame, points: DataFrame, n: int, scratch: Scratch | None = None) -> DataFrame:
    """C7 as a model: the midpoints of all merges are its centers ``(k, center,
    cluster, centroid)``, in the order of the merges; k is the level that the
    table reaches.  ``predict`` and ``LinkageModel`` take them as they are."""
    level = merges.agg((F.lit(n) - F.count(F.lit(1))).cast("int").alias("k"))          # one row
    return midpoints(merges, points, scratch).join(F.broadcast(level)).select(
        "k", (F.col("cluster") - n - 1).cast("int").alias("center"), "cluster", "centroid")
