import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import greedy_linkage
from conftest import REFERENCE, pts_df
from dendrospark.operators.linkage import (linkage, linkage_by_prefix, linkage_from_pairs, merge_members,
                                            midpoints, singletons)
from dendrospark.sources import io

GOLDEN = f"{REFERENCE}/linkageModels"


def merges_of(df):
    return [tuple(r) for r in df.orderBy("cluster").select("cluster", "point1", "point2", "height", "size").collect()]


@pytest.mark.skipif(not os.path.exists(GOLDEN), reason="reference models absent")
@pytest.mark.parametrize("nv", [1, 20])
def test_golden_avg_linkage(spark, nv):
    """The shipped C3 models are size-weighted average linkage down to K=3."""
    pts = io.take_features(io.read_points(spark, f"{REFERENCE}/data/C3-D20-I100"), nv)
    got = [(r.cluster, r.point1, r.point2) for r in linkage(pts, "avg", k=3).orderBy("cluster").collect()]
    with open(f"{GOLDEN}/Linkage-C3-300p-D{nv}/part-00000") as fh:
        want = [tuple(int(x) for x in line.split(",")) for line in fh if line.strip()]
    assert got == want


@pytest.mark.parametrize("strategy", ["min", "max", "avg", "wavg"])
def test_matches_greedy_brute_force(spark, strategy):
    rng = np.random.default_rng(11)
    X = np.vstack([rng.normal(c, 0.3, size=(8, 2)) for c in ((0, 0), (3, 0), (0, 4))])
    got = merges_of(linkage(pts_df(spark, X), strategy))
    want = greedy_linkage(X, strategy)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[4] for g in got] == [w[4] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


@pytest.mark.parametrize("strategy,heights", [
    ("min", [1, 2, 4, 8]), ("max", [1, 3, 7, 15]),
    ("avg", [1, 2.5, 17 / 3, 12.25]), ("wavg", [1, 2.5, 5.25, 10.625])])
def test_five_on_a_line(spark, strategy, heights):
    got = merges_of(linkage(pts_df(spark, [[0], [1], [3], [7], [15]]), strategy))
    assert [g[3] for g in got] == pytest.approx(heights)
    assert [g[4] for g in got] == [2, 3, 4, 5]


def test_two_points(spark):
    assert merges_of(linkage(pts_df(spark, [[0], [3]]), "avg")) == [(3, 1, 2, 3.0, 2)]


def test_ties_are_deterministic(spark):
    got = merges_of(linkage(pts_df(spark, [[0, 0], [1, 0], [0, 1], [1, 1]]), "min"))
    assert [g[:3] for g in got] == [(5, 1, 2), (6, 5, 3), (7, 6, 4)]


TIED = {
    "duplicates": [[0], [0], [0], [9], [9], [30], [35], [31], [33]],
    "random integers": np.random.default_rng(2).integers(0, 4, (16, 2)).tolist(),
}


@pytest.mark.parametrize("strategy", ["min", "max", "avg", "wavg"])
@pytest.mark.parametrize("name", TIED)
def test_ties_follow_the_greedy_procedure(spark, strategy, name):
    got = merges_of(linkage(pts_df(spark, TIED[name]), strategy))
    want = greedy_linkage(TIED[name], strategy)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_gaps_in_ids_and_components_are_errors(spark):
    ddl = "id LONG, features ARRAY<DOUBLE>"
    for rows in ([(1, [0.0]), (2, [1.0]), (10, [2.0])], [(1, [0.0]), (1, [1.0])], [(0, [0.0]), (1, [1.0])],
                 [(1, [0.0]), (2, [None])], [(1, [0.0]), (2, None)], [(1, [0.0]), (2, [float("nan")])],
                 [(1, [0.0]), (2, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            linkage(spark.createDataFrame(rows, ddl), "avg")
    pairs = "id1 LONG, id2 LONG, dist DOUBLE"
    with pytest.raises(ValueError):                      # 3 and 4 are cut off
        linkage_from_pairs(spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0)], pairs), 4, "avg")
    for row in ((1, 2, None), (1, 2, float("nan")), (1, 5, 1.0)):
        with pytest.raises(Exception, match="a pair needs ids"):
            linkage_from_pairs(spark.createDataFrame([row], pairs), 2, "min")


def test_one_pair_join_serves_all_prefixes(spark):
    X = np.random.default_rng(3).normal(size=(14, 5))
    got = linkage_by_prefix(pts_df(spark, X), [2, 5], "avg").collect()
    for nv in (2, 5):
        rows = sorted((r.cluster, r.point1, r.point2) for r in got if r.nv == nv)
        assert rows == [w[:3] for w in greedy_linkage(X[:, :nv], "avg")]


def test_duplicates_merge_first(spark):
    got = merges_of(linkage(pts_df(spark, [[0.0], [5.0], [9.0], [5.0]]), "max"))
    assert got[0][:4] == (5, 2, 4, 0.0)


def test_stop_level_and_properties(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(30, 3))
    full = linkage(pts_df(spark, X), "avg")
    rows = merges_of(full)
    n = 30
    assert [r[0] for r in rows] == list(range(n + 1, 2 * n))
    h = {r[0]: r[3] for r in rows}
    size = {r[0]: r[4] for r in rows}
    children = [c for r in rows for c in r[1:3]]
    assert len(children) == len(set(children))           # each id a child once
    for c, p1, p2, hh, s in rows:
        assert p1 < c and p2 < c
        assert hh >= h.get(p1, 0.0) and hh >= h.get(p2, 0.0)   # monotone heights
        assert s == size.get(p1, 1) + size.get(p2, 1)
    assert rows[-1][4] == n
    top = merges_of(linkage(pts_df(spark, X), "avg", k=4))
    assert top == rows[: n - 4]


def test_singletons_members_midpoints(spark):
    assert sorted(tuple(r) for r in singletons(spark, 3).collect()) == [(1, 1), (2, 2), (3, 3)]
    merges = spark.createDataFrame([(4, 1, 2, 1.0, 2), (5, 4, 3, 2.0, 3)],
                                   "cluster LONG, point1 LONG, point2 LONG, height DOUBLE, size LONG")
    assert sorted(tuple(r) for r in merge_members(merges, 3).collect()) == [(4, 1), (4, 2), (5, 1), (5, 2), (5, 3)]
    chain = [(8 + i, 7 + i if i else 1, i + 2 if i else 2, 1.0 + i, i + 2) for i in range(6)]
    rows = merge_members(spark.createDataFrame(chain, merges.schema), 7).collect()
    assert sorted(tuple(r) for r in rows) == [(8 + i, x) for i in range(6) for x in range(1, i + 3)]
    pts = pts_df(spark, [[0.0, 0.0], [2.0, 0.0], [4.0, 4.0]])
    mp = {r.cluster: r.centroid for r in midpoints(merges, pts).collect()}
    assert mp[4] == [1.0, 0.0] and mp[5] == [2.5, 2.0]


def test_linkage_with_assignments(spark):
    from dendrospark.operators.linkage import linkage_with_assignments
    merges, asg = linkage_with_assignments(pts_df(spark, [[0], [1], [10], [11], [30]]), "min", k=2)
    assert merges.count() == 3
    labels = {r.id: r.cluster for r in asg.collect()}
    assert labels[1] == labels[2] == labels[3] == labels[4] != labels[5] == 5


@pytest.mark.skipif(not os.path.exists(GOLDEN), reason="reference models absent")
def test_prefix_models_share_rounds(spark):
    """Two feature prefixes as one keyed linkage = the two shipped models."""
    from dendrospark.operators.linkage import linkage_by_prefix
    pts = io.read_points(spark, f"{REFERENCE}/data/C3-D20-I100")
    m = linkage_by_prefix(pts, [1, 20], "avg", k=3).collect()
    for nv in (1, 20):
        got = sorted((r.cluster, r.point1, r.point2) for r in m if r.nv == nv)
        with open(f"{GOLDEN}/Linkage-C3-300p-D{nv}/part-00000") as fh:
            want = [tuple(int(x) for x in line.split(",")) for line in fh if line.strip()]
        assert got == want
