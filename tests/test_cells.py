"""Linkage in many dimensions, and of prefixes, without a table of all pairs."""

import numpy as np
import pytest

from dendrospark.operators import linkage as L
from dendrospark.operators import spanning as S

from brute import greedy_linkage
from conftest import pts_df


def _same(rows, want):
    rows = list(rows)
    assert [(r["cluster"], r["point1"], r["point2"], r["size"]) for r in rows] == [(c, a, b, s) for c, a, b, _, s in want]
    assert np.allclose([r["height"] for r in rows], [h for _, _, _, h, _ in want])


def _points():
    """Different points, copies and ties in 12 dimensions."""
    rng = np.random.default_rng(3)
    v = np.concatenate((rng.random((30, 12)) * 100, rng.integers(0, 2, (12, 12)) * 200))
    v[:3] = v[5:8]
    return v


def _refuse(*a, **k):
    raise AssertionError("copied for each ball")


@pytest.mark.parametrize("strategy", ["avg", "wavg"])
def test_cells_equal_greedy(spark, monkeypatch, strategy):
    """Points of many dimensions are not copied for every ball that a bound does not exclude."""
    monkeypatch.setattr(L, "merge_down", _refuse)
    monkeypatch.setattr("dendrospark.operators.cells.SIDE", 10)
    v = _points()
    _same(L.linkage_of_points(pts_df(spark, v), strategy, table_clusters=12).orderBy("cluster").collect(),
          greedy_linkage(v, strategy))


def test_prefixes_have_no_table_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIR_TABLE_POINTS", 10)
    monkeypatch.setattr(L, "pairwise_distances", _refuse)
    monkeypatch.setattr(L._prefixes_of_points, "__defaults__", (8,))
    v = _points()
    rows = L.linkage_by_prefix(pts_df(spark, v), [3, 7], "avg").orderBy("nv", "cluster").collect()
    for nv in (3, 7):
        _same((r for r in rows if r["nv"] == nv), greedy_linkage(v[:, :nv], "avg"))


def test_single_linkage_in_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "nearest_foreign", _refuse)
    monkeypatch.setattr("dendrospark.operators.cells.SIDE", 10)
    v = _points()
    _same(L.single_linkage(pts_df(spark, v), block_points=8).orderBy("cluster").collect(), greedy_linkage(v, "min"))


def test_a_hundred_thousand_edges_are_numbered_at_once(spark, monkeypatch, tmp_path):
    """No level of halving below ``RANGE_EDGES``; it was 4096."""
    from dendrospark.session import Scratch
    monkeypatch.setattr(S, "forest_roots", _refuse)
    n = 100_000
    tree = spark.range(1, n).selectExpr("id AS p", "id + 1 AS q", "CAST(id AS DOUBLE) AS d")
    got = S.number_tree(tree, n, Scratch(spark, "chain"))
    assert got.selectExpr("count(*)", "max(size)", "sum(CAST(size = cluster - 100000 + 1 AS INT))").first()[:] == (n - 1, n, n - 1)
