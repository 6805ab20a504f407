"""Linkage without a table of all pairs."""

import numpy as np
import pytest

from dendrospark.operators import linkage as L

from brute import greedy_linkage
from conftest import pts_df


def _rows(m):
    return [(r["cluster"], r["point1"], r["point2"], r["size"]) for r in m], [r["height"] for r in m]


@pytest.mark.parametrize("strategy", ["avg", "max", "wavg"])
def test_search_equals_greedy(spark, monkeypatch, strategy):
    """Copies, ties and different points; no pair table of the points."""
    rng = np.random.default_rng(3)
    v = np.concatenate((rng.random((30, 2)) * 100, rng.integers(0, 3, (15, 2)) * 200))
    monkeypatch.setattr(L, "PAIR_TABLE_POINTS", 20)
    monkeypatch.setattr(L, "TABLE_CLUSTERS", 8)

    def refuse(*a, **k):
        raise AssertionError("a table of all pairs")
    monkeypatch.setattr(L, "pairwise_distances", refuse)
    monkeypatch.setattr(L.linkage_of_points, "__defaults__", ("avg", 1, L.DEFAULT_BROADCAST_BYTES, 12, 8))
    got, heights = _rows(L.linkage(pts_df(spark, v), strategy).orderBy("cluster").collect())
    want = greedy_linkage(v, strategy)
    assert got == [(c, a, b, s) for c, a, b, _, s in want]
    assert np.allclose(heights, [h for _, _, _, h, _ in want])


def test_single_linkage_searches_different_points_only(spark, monkeypatch):
    seen = []
    whole = L.spanning_tree_of_points

    def counted(points, *a, **k):
        seen.append(points.count())
        return whole(points, *a, **k)
    monkeypatch.setattr(L, "spanning_tree_of_points", counted)
    v = np.random.default_rng(5).integers(0, 4, (40, 1))
    got, _ = _rows(L.single_linkage(pts_df(spark, v)).orderBy("cluster").collect())
    assert got == [(c, a, b, s) for c, a, b, _, s in greedy_linkage(v, "min")]
    assert seen == [len(np.unique(v))]
