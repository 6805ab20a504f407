"""Aggregates over all pairs without a table of them."""

import numpy as np
import pytest

from dendrospark.operators.block_pairs import label_linkage, nearest_points
from dendrospark.operators.indices import dunn_min_max
from dendrospark.operators.pairs import pairwise_distances

from conftest import labelled_df


@pytest.mark.parametrize("dim", [2, 12])
def test_aggregates_of_pairs_in_blocks(spark, dim):
    rng = np.random.default_rng(dim)
    v, y = rng.normal(size=(600, dim)), rng.integers(0, 3, 600)
    v[17] = v[400]                                              # closest: a copy
    v[18] = v[401]
    df = labelled_df(spark, v, y)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    for strategy, f in (("min", np.min), ("max", np.max), ("avg", np.mean)):
        got = {(r[0], r[1]): r[2] for r in label_linkage(df, strategy).collect()}
        want = {(a, b): f(d[np.ix_(y == a, y == b)]) for a in range(3) for b in range(a + 1, 3)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert nearest_points(df).first()[:] == (18, 401, 0.0)
    r = dunn_min_max(df).first()
    same = y[:, None] == y[None]
    assert abs(r["inter"] - d[~same].min() ** 2) < 1e-9 and abs(r["intra"] - d[same].max() ** 2) < 1e-9
    # an id that comes twice is no pair; rows without a label take no part
    few = spark.createDataFrame([(1, [0.0], 0), (1, [5.0], 1), (2, [1.0], 1), (3, [9.0], None)],
                                "id LONG, features ARRAY<DOUBLE>, cluster LONG")
    assert [r[:] for r in label_linkage(few, "max").collect()] == [(0, 1, 1.0)]
    assert nearest_points(few.where("id = 1")).first()[:] == (None, None, None)


def test_copies_for_block_pairs_are_not_broadcast(spark):
    """Spark takes the copies of a small table for small."""
    df = labelled_df(spark, [[float(i)] for i in range(40)], [0] * 40).drop("cluster")
    got = pairwise_distances(df, method="blocks", block_rows=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    rows = got.collect()
    assert len(rows) == 780 and all(r["dist"] == r["id2"] - r["id1"] for r in rows)
