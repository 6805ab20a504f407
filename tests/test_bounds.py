"""Triangle bounds change how much is measured, never the result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.operators.bounded import dunn_min_max_bounded, extreme_pairs
from dendrospark.operators.center_index import center_balls, nearest_in_balls
from dendrospark.operators.centers import predict, predict_all
from tests.conftest import labelled_df, pts_df


def groups(seed, count, size, dim, gap=50.0):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(count, dim)) * gap
    labels = np.repeat(np.arange(count), size)
    return at[labels] + rng.normal(size=(count * size, dim)), labels


def centers_df(spark, centroids):
    return spark.createDataFrame([(0, i, [float(x) for x in c]) for i, c in enumerate(centroids)],
                                 "k INT, center INT, centroid ARRAY<DOUBLE>")


def brute_extremes(X, labels):
    d2 = ((X[:, None] - X[None]) ** 2).sum(2)
    same = labels[:, None] == labels[None]
    off = ~np.eye(len(X), dtype=bool)
    return d2[~same].min(), d2[same & off].max()


# ------------------------------------------------------------ D6
def test_nearest_center_measures_few_of_a_thousand(spark):
    X, _ = groups(1, 40, 10, 4)
    C, _ = groups(1, 40, 25, 4)
    cent, pts = centers_df(spark, C), pts_df(spark, X)
    balls = F.broadcast(center_balls(cent, ["k"], 4))
    got = {r.id: r.b for r in pts.crossJoin(balls).select("id", nearest_in_balls("features", F.col("balls"), 4).alias("b")).collect()}
    want = ((X[:, None] - C[None]) ** 2).sum(2).argmin(1)
    assert [got[i + 1].won.center for i in range(len(X))] == want.tolist()
    assert np.mean([b.evaluated for b in got.values()]) < len(C) / 4


def test_equal_distances_go_to_the_lowest_center(spark):
    grid = [(x, y) for x in range(14) for y in range(14)] * 2                # each center twice
    X = [(x + 0.5, y + 0.5) for x in range(13) for y in range(13)]           # four centers, and their copies, as near
    cent, pts = centers_df(spark, grid), pts_df(spark, X)
    plain = {r.id: (r.center, r.d2) for r in predict(pts, cent, ks=[0], index_from=10**9).collect()}
    index = {r.id: (r.center, r.d2) for r in predict(pts, cent, ks=[0], index_from=1).collect()}
    assert index == plain
    assert index[1] == (0, 0.5)


def test_one_center_and_points_on_centers(spark):
    pts = pts_df(spark, [(0, 0), (3, 4), (1e200, 0)])                        # the last one's squares overflow
    assert [(r.id, r.center) for r in predict(pts, centers_df(spark, [(0, 0)]), index_from=1).orderBy("id").collect()] == [
        (1, 0), (2, 0), (3, 0)]
    got = predict(pts, centers_df(spark, [(3, 4), (0, 0), (3, 4)]), index_from=1).orderBy("id").collect()
    assert [(r.center, r.d2) for r in got][:2] == [(1, 0.0), (0, 0.0)]
    assert got[2].center == 0                                               # all infinitely far: the lowest


def test_models_of_several_datasets_and_levels(spark):
    rng = np.random.default_rng(5)
    pts = spark.createDataFrame([(m, i, rng.normal(size=3).tolist()) for m in "ab" for i in range(40)],
                                "model STRING, id LONG, features ARRAY<DOUBLE>").cache()
    cent = spark.createDataFrame([(m, k, i, rng.normal(size=3).tolist()) for m in "ab" for k in (3, 17) for i in range(k)],
                                 "model STRING, k INT, center INT, centroid ARRAY<DOUBLE>").cache()
    plain, index = ({(r.model, r.id): r.best for r in predict_all(pts, cent, model="model", index_from=at).collect()}
                    for at in (10**9, 1))
    assert index == plain and len(index) == 80
    assert all([b.k for b in best] == [3, 17] for best in index.values())


# ------------------------------------------------------------ V4
def test_bounds_leave_out_most_pairs_of_separated_groups(spark):
    X, labels = groups(2, 12, 60, 3)
    inter, intra, share = extreme_pairs(labelled_df(spark, X, labels), block_points=16)
    assert (inter, intra) == pytest.approx(brute_extremes(X, labels), rel=1e-12)
    assert share < 0.3


def test_mixed_clusters_and_copies(spark):
    rng = np.random.default_rng(3)
    X = rng.integers(0, 6, size=(200, 2)).astype(float)
    labels = rng.integers(0, 5, size=200)
    inter, intra, _ = extreme_pairs(labelled_df(spark, X, labels), block_points=8)
    assert (inter, intra) == brute_extremes(X, labels) and inter == 0


def test_small_and_empty_cases(spark):
    at = lambda rows, labels: dunn_min_max_bounded(labelled_df(spark, rows, labels)).first()
    one = at([(0, 0), (1, 0), (3, 0)], [7, 7, 7])
    assert (one.inter, one.intra, one.dunn_min_max) == (None, 9.0, None)
    apart = at([(0, 0), (1, 0)], [1, 2])
    assert (apart.inter, apart.intra, apart.dunn_min_max) == (1.0, None, None)
    copies = at([(0, 0), (0, 0), (2, 0)], [1, 1, 2])
    assert (copies.inter, copies.intra, copies.dunn_min_max) == (4.0, 0.0, None)
    empty = dunn_min_max_bounded(labelled_df(spark, [(0, 0)], [1]).where("id < 0")).first()
    assert (empty.inter, empty.intra, empty.dunn_min_max) == (None, None, None)
    loose = dunn_min_max_bounded(spark.createDataFrame(
        [(1, [0.0], 1), (2, [5.0], None), (3, [1.0], 2)], "id LONG, features ARRAY<DOUBLE>, cluster LONG")).first()
    assert (loose.inter, loose.intra) == (1.0, None)


def test_equal_centers_are_measured_once(spark):
    """The lowest of equal centers wins, so it alone is in the index."""
    cent = spark.range(400).selectExpr("0 AS k", "int(399 - id) AS center", "array(double(id % 7), 0D) AS centroid")
    balls = center_balls(cent, ["k"], 2)
    members = balls.selectExpr("explode(balls) AS b").selectExpr("explode(b.members) AS m").select("m.center").collect()
    assert sorted(r.center for r in members) == list(range(7))
    pts = pts_df(spark, [[x, 1.0] for x in range(7)])
    got = predict(pts, cent, index_from=1).select("features", "center").collect()
    assert all(r.center == min(c for c in range(400) if (399 - c) % 7 == r.features[0]) for r in got)
