import pytest

from conftest import pts_df
from dendrospark.operators.dendrogram import (all_ids, cluster_members, cluster_of, cut,
                                              cut_levels, is_cluster)
from dendrospark.operators.linkage import linkage

M = "cluster LONG, point1 LONG, point2 LONG, height DOUBLE, size LONG"


def test_leaf_before_cluster(spark):
    merges = spark.createDataFrame([(4, 1, 2, 1.0, 2), (5, 3, 4, 2.0, 3)], M)
    assert sorted(r.id for r in cluster_members(merges, 3, 5).collect()) == [1, 2, 3]
    assert sorted(r.id for r in cluster_members(merges, 3, 4).collect()) == [1, 2]
    assert {r.id: r.cluster for r in cut(merges, 3, 2).collect()} == {1: 4, 2: 4, 3: 3}
    assert {r.id: r.cluster for r in cut(merges, 3, 1).collect()} == {1: 5, 2: 5, 3: 5}


def test_k_below_stored_level_raises(spark):
    merges = spark.createDataFrame([(4, 1, 2, 1.0, 2)], M)
    with pytest.raises(ValueError):
        cut(merges, 3, 1)


def test_cut_has_k_labels_and_levels_agree(spark):
    import numpy as np
    X = np.random.default_rng(2).normal(size=(25, 2))
    m = linkage(pts_df(spark, X), "max")
    levels = cut_levels(m, 25, [2, 3, 5, 8]).collect()
    for k in (2, 3, 5, 8):
        single = {r.id: r.cluster for r in cut(m, 25, k).collect()}
        multi = {r.id: r.cluster for r in levels if r.k == k}
        assert single == multi and len(set(single.values())) == k


def test_cluster_of_and_is_cluster(spark):
    merges = spark.createDataFrame([(5, 1, 2, 1.0, 2), (6, 5, 3, 2.0, 3), (7, 6, 4, 3.0, 4)], M)
    base = spark.createDataFrame([(1, 5), (2, 5), (5, 6), (3, 6)], "child LONG, cluster LONG")
    pts = pts_df(spark, [[0], [1], [2], [3]])
    assert {r.id: r.cluster for r in cluster_of(pts, base).collect()} == {1: 6, 2: 6, 3: 6, 4: 4}
    flags = {r.id: r.is_cluster for r in is_cluster(all_ids(spark, 4), merges).collect()}
    assert [i for i, f in sorted(flags.items()) if f] == [5, 6, 7]


def test_hot_target_split_matches_plain_join(spark):
    """A star: every node points at one hub; the split path must agree with
    the plain join."""
    from dendrospark.operators.dendrogram import root_of
    from dendrospark.session import Scratch
    rows = [(i, 100) for i in range(1, 60)] + [(100, 200), (200, 300)] + [(i, i + 1) for i in range(400, 420)]
    edges = spark.createDataFrame(rows, "node LONG, up LONG")
    sc = Scratch(spark, "t")
    split = {r.node: r.up for r in root_of(edges, sc, broadcast_bytes=0).collect()}
    plain = {r.node: r.up for r in root_of(edges, sc, hot_fraction=1.0, broadcast_bytes=0).collect()}
    assert split == plain == {r.node: r.up for r in root_of(edges, sc).collect()}
    weighed = edges.withColumn("w", edges["node"] * 10)
    for limit in (0, 1 << 20):
        sums = {r.node: (r.up, r.w) for r in root_of(weighed, sc, broadcast_bytes=limit, add="w").collect()}
        assert sums[5] == (300, 50 + 1000 + 2000) and sums[418] == (420, 4180 + 4190)
    assert split[5] == 300 and split[400] == 420


def test_centers_fallback_moves_down_a_level(spark):
    from dendrospark.operators.centers import LinkageModel, centers, predict
    pts = pts_df(spark, [[0], [0.1], [0.2], [0.3], [100], [100.1], [100.2], [1000]])
    m = linkage(pts, "avg")
    # at k=2 only one cluster has >= 2 members; one level down both A and B do
    c = centers(pts, m, 8, 2, min_size=2).collect()
    assert sorted(r.size for r in c) == [3, 4]
    with pytest.raises(ValueError):
        centers(pts, m, 8, 2, min_size=5)
    model = LinkageModel(m, 8).with_centers(centers(pts, m, 8, 3))
    assert model.cut(3).select("cluster").distinct().count() == 3
    assert model.predict(pts).select("center").distinct().count() == 3
    assert model.compute_cost(pts).first().cost == pytest.approx(
        sum((x - 0.15) ** 2 for x in (0, 0.1, 0.2, 0.3)) + sum((x - 100.1) ** 2 for x in (100, 100.1, 100.2)))


def chain(spark, n):
    """Every merge takes the next point."""
    rows = [(n + 1 + i, n + i if i else 1, i + 2 if i else 2, 1.0 + i, i + 2) for i in range(n - 1)]
    return spark.createDataFrame(rows, M)


def test_a_chain_of_64_merges_contracts_in_logarithmic_rounds(spark):
    from dendrospark.operators.tree import contract
    from dendrospark.session import Scratch
    leaves = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 66)], "node LONG, value ARRAY<DOUBLE>")
    got, rounds = contract(chain(spark, 65), leaves, 0.5, Scratch(spark, "chain"))
    assert rounds <= 8
    v, want = 1.0, {}
    for i in range(64):
        v = (v + i + 2) / 2
        want[66 + i] = [pytest.approx(v), 1.0]
    assert {r.cluster: r.value for r in got.collect()} == want
    assert {r.cluster: r.value for r in contract(chain(spark, 65), leaves, 0.5, Scratch(spark, "joined"), 0)[0].collect()} == want


def test_tour_lifting_and_lives_of_a_forest(spark):
    import numpy as np
    from dendrospark.operators.tree import ancestors, clusters_at, lives, members, tour
    from dendrospark.session import Scratch
    sc, n = Scratch(spark, "forest"), 21
    m = linkage(pts_df(spark, np.random.default_rng(4).normal(size=(n, 2))), "wavg", k=3)
    below = {i: [i] for i in range(1, n + 1)}
    rows = m.orderBy("cluster").collect()
    for r in rows:
        below[r.cluster] = below[r.point1] + below[r.point2]
    for merges in (m, m.select("cluster", "point1", "point2")):           # a stored table has no sizes
        t = tour(merges, n, sc)
        assert {r.node: r["size"] for r in t.collect()} == {c: len(x) for c, x in below.items()}
        got = members(t, m.select("cluster"), n, block=3).collect()
        assert sorted(map(tuple, got)) == sorted((c, x) for c in below if c > n for x in below[c])
        assert t.count() == 2 * n - 3
    # no level below the table's: every other one is asked for each point
    table, levels = ancestors(m, sc)
    ask = spark.range(1, n + 1).selectExpr("id", "explode(sequence(3, 21)) AS k")
    for r in clusters_at(ask, table, levels, n).collect():
        assert r.cluster == max(c for c, x in below.items() if r.id in x and (c <= n or c <= 2 * n - r.k))
    alive = lives(m, n, sc).collect()
    for k in range(3, n + 1):
        want = {max(c for c, x in below.items() if i in x and (c <= n or c <= 2 * n - k)) for i in range(1, n + 1)}
        assert {r.node for r in alive if r.k_from <= k <= r.k_to} == want and len(want) == k


def test_fallback_levels_in_small_batches(spark):
    """The level-by-level rule, whatever the number of levels looked at once."""
    import numpy as np
    from dendrospark.operators.centers import centers
    n = 30
    pts = pts_df(spark, np.random.default_rng(6).normal(size=(n, 2)))
    m = linkage(pts, "avg")
    below = {i: {i} for i in range(1, n + 1)}
    for r in m.orderBy("cluster").collect():
        below[r.cluster] = below[r.point1] | below[r.point2]
    k, ms, keep = 3, 8, 3
    while True:
        now = sorted({max(c for c, x in below.items() if i in x and (c <= n or c <= 2 * n - k)) for i in range(1, n + 1)})
        good = [c for c in now if len(below[c]) >= ms]
        if len(good) >= keep:
            break
        ms, k = int(ms / n * max(len(below[c]) for c in now) + 0.5), k + 1
    want = sorted(sorted(good, key=lambda c: (-len(below[c]), c))[:keep])
    for batch in (1, 2, 256):
        got = centers(pts, m, n, 3, min_size=8, batch=batch).orderBy("center").collect()
        assert [(r.k, r.cluster, r["size"]) for r in got] == [(k, c, len(below[c])) for c in want]
