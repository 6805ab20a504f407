"""Single linkage by spanning trees: rounds, numbering and the search without a pair table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import greedy_linkage
from conftest import pts_df
from dendrospark.operators.linkage import single_linkage
from dendrospark.operators.pairs import pairwise_distances
from dendrospark.operators.spanning import forest_roots, number_tree, spanning_tree, spanning_tree_of_points
from dendrospark.session import Scratch


def merges_of(df):
    return [tuple(r) for r in df.orderBy("cluster").select("cluster", "point1", "point2", "height", "size").collect()]


def check(got, X):
    want = greedy_linkage(X, "min")
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_doubling_gaps_take_logarithmic_rounds(spark):
    """64 points whose gaps grow: one nearest-neighbour pair merges at a time."""
    X = [[float(1.5 ** i)] for i in range(64)]
    scratch = Scratch(spark, "chain")
    tree, rounds = spanning_tree(pairwise_distances(pts_df(spark, X)), 64, scratch)
    assert rounds <= math.ceil(math.log2(64))
    assert sorted((r.p, r.q) for r in tree.collect()) == [(i, i + 1) for i in range(1, 64)]
    check(merges_of(number_tree(tree, 64, scratch, range_edges=16)), X)


@pytest.mark.parametrize("range_edges", [1, 3, 1000])
def test_numbering_of_any_tree(spark, range_edges):
    rng = np.random.default_rng(range_edges)
    n, rows, want = 40, [], {}
    models = ("random", "star", "path")
    for m in models:
        weights = rng.integers(0, 6, n).astype(float).tolist()     # many ties
        edges = [(i + 1, j + 1, weights[j]) for j in range(1, n)
                 for i in [{"random": int(rng.integers(0, j)), "star": 0, "path": j - 1}[m]]]
        rows += [(m, *e) for e in edges]
        now, size = {i: i for i in range(1, n + 1)}, {i: 1 for i in range(1, n + 1)}
        for r, (p, q, d) in enumerate(sorted(edges, key=lambda e: (e[2], e[0], e[1]))):
            a, b = now[p], now[q]
            c = n + 1 + r
            size[c] = size[a] + size[b]
            want[m, c] = ((min(a, b), max(a, b)) if max(a, b) <= n else (max(a, b), min(a, b))) + (d, size[c])
            now = {x: c if y in (a, b) else y for x, y in now.items()}
    tree = spark.createDataFrame(rows, "model STRING, p LONG, q LONG, d DOUBLE")
    got = number_tree(tree, n, Scratch(spark, "numbering"), ["model"], range_edges).collect()
    assert {(r.model, r.cluster): (r.point1, r.point2, r.height, r.size) for r in got} == want and len(got) == 3 * (n - 1)


def test_roots_of_forests(spark):
    edges = [(g, i, i + 1) for g in (1, 2) for i in range(20) if i % 7] + [(2, 30, 5), (3, 9, 8), (3, 8, 9), (3, 4, 4)]
    got = forest_roots(spark.createDataFrame(edges, "g INT, a LONG, b LONG"), ["g"], Scratch(spark, "roots")).collect()
    assert len(got) == len({(r.g, r.node) for r in got})
    for g in (1, 2, 3):
        group = {x: {x} for e in edges if e[0] == g for x in e[1:]}
        for _, a, b in (e for e in edges if e[0] == g):
            both = group[a] | group[b]
            for x in both:
                group[x] = both
        want = {x: min(c) for x, c in group.items() if len(c) > 1}
        assert {r.node: r.root for r in got if r.g == g} == want


@pytest.mark.parametrize("name", ["ties", "copies"])
def test_points_without_a_pair_table(spark, name):
    rng = np.random.default_rng(8)
    X = {"ties": rng.integers(0, 4, (45, 2)).astype(float),
         "copies": np.vstack([np.zeros((20, 2)), rng.normal(size=(15, 2))])}[name]
    check(merges_of(single_linkage(pts_df(spark, X), block_points=12)), X)


def test_separated_blocks_are_not_compared(spark):
    rng = np.random.default_rng(9)
    X = np.vstack([rng.normal(rng.normal(0, 50, 2), 0.1, (25, 2)) for _ in range(16)])
    tree, log = spanning_tree_of_points(pts_df(spark, X), Scratch(spark, "separated"), block_points=25)
    assert len(log) <= math.ceil(math.log2(len(X))) and log[0]["searched"] == len(X)
    assert all(r["compared"] < 0.3 for r in log)
    want, _ = spanning_tree(pairwise_distances(pts_df(spark, X)), len(X), Scratch(spark, "pairs"))
    assert sorted(map(tuple, tree.select("p", "q", "d").collect())) == sorted(map(tuple, want.select("p", "q", "d").collect()))


def test_one_point_and_none(spark):
    one = pts_df(spark, [[1.0, 2.0]])
    assert single_linkage(one).collect() == []
    assert spanning_tree_of_points(one.limit(0), Scratch(spark, "none"))[0].collect() == []
    with pytest.raises(ValueError):
        single_linkage(one, k=2)
