import os

import pytest
from pyspark.sql import functions as F

from conftest import REFERENCE, pts_df
from dendrospark.functions import vectors as VF
from dendrospark.operators.pairs import (cluster_linkage_distance, cluster_sizes, median_by,
                                         merge_pair, nearest_pair, pairwise_distances)
from dendrospark.sources import io


def test_distances_and_weighted(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 6.0, 3.0], [1, 2, 3])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, w ARRAY<INT>")
    r = df.select(VF.euclidean("a", "b").alias("e"), VF.sq_euclidean("a", "b").alias("s"),
                  VF.sq_euclidean("a", "b", dim=3).alias("u"),
                  VF.weighted_sq_euclidean("a", "b", "w").alias("w")).first()
    assert r["e"] == pytest.approx(5.0) and r["s"] == 25.0 and r["u"] == 25.0
    assert r["w"] == 1 * 9 + 2 * 16 + 0


def test_dimension_mismatch_raises(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    with pytest.raises(Exception):
        df.select(VF.euclidean("a", "b")).collect()
    with pytest.raises(ValueError):
        pairwise_distances(pts_df(spark, [[1, 2], [1]])).collect()


def test_to_double_or_zero(spark):
    df = spark.createDataFrame([("",), ("1.5",)], "s STRING")
    assert [r[0] for r in df.select(VF.to_double_or_zero("s")).collect()] == [0.0, 1.5]
    bad = spark.createDataFrame([("x",)], "s STRING")
    with pytest.raises(Exception):
        bad.select(VF.to_double_or_zero("s")).collect()


def test_other_endpoint(spark):
    df = spark.createDataFrame([(1, 2), (2, 5), (3, 4), (1, 7)], "a LONG, b LONG")
    got = [r[0] for r in df.select(VF.other_endpoint("a", "b", F.lit(1), F.lit(2))).collect()]
    assert got == [2, 5, 0, 7]


def test_mean_vectors_and_sizes(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 6.0], 0), (3, [5.0, 5.0], 1)],
                               "id LONG, features ARRAY<DOUBLE>, cluster LONG")
    m = {r["cluster"]: r["centroid"] for r in VF.mean_vectors(df, ["cluster"], "features", 2).collect()}
    assert m[0] == [2.0, 4.0] and m[1] == [5.0, 5.0]
    assert {r["cluster"]: r["size"] for r in cluster_sizes(df).collect()} == {0: 2, 1: 1}


def test_median_even_and_odd(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 4.0), (0, 10.0), (1, 5.0), (1, 1.0), (1, 3.0)],
                               "g INT, x DOUBLE")
    got = {r["g"]: r["median"] for r in median_by(df, ["g"], "x").collect()}
    assert got == {0: 3.0, 1: 3.0}


def test_median_by_narrowing_equals_sorting(spark):
    import math

    import numpy as np
    rng = np.random.default_rng(5)
    nan = float("nan")
    groups = {"wide": (10.0 ** rng.uniform(-300, 300, 3001)) * rng.choice([-1, 1], 3001),
              "even": rng.normal(size=4000),
              "few values": rng.integers(0, 4, 5000).astype(float),
              # two of three rows are one value, just below or at the middle
              "hot below": np.concatenate((np.zeros(1500), rng.uniform(1, 2, 1502))),
              "hot at": np.concatenate((np.zeros(2000), rng.uniform(1, 2, 1000))),
              "two halves": np.concatenate((np.full(1000, -1.0), np.full(1000, 3.0))),
              "small": np.array([4.0, 1.0]), "one": np.array([7.0]), None: rng.normal(size=2000)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    rows += [("null only", None), ("even", None), ("nan", 1.0), ("nan", nan), ("nan", nan)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(g, None if x is None else float(x)) for g, x in rows], "g STRING, x DOUBLE").repartition(5)
    for small in (16, 10 ** 6):
        got = {r["g"]: r["m"] for r in median_by(df, ["g"], "x", "m", small=small).collect()}
        assert set(got) == {*groups, "null only", "nan"}
        assert got.pop("null only") is None and math.isnan(got.pop("nan"))
        assert got == pytest.approx({g: float(np.median(xs)) for g, xs in groups.items()}, rel=1e-12)


def test_median_of_one_group_and_of_none(spark):
    df = spark.range(1, 20001).selectExpr("CAST(id % 9999 AS DOUBLE) AS x")
    want = sorted(i % 9999 for i in range(1, 20001))
    assert median_by(df, [], "x").first()["median"] == (want[9999] + want[10000]) / 2
    assert median_by(df.where("false").withColumn("g", F.lit(1)), ["g"], "x").count() == 0
    plan = median_by(df, [], "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "collect_list" not in plan


def test_pairs_both_methods_agree(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    X = rng.normal(size=(40, 3))
    pts = pts_df(spark, X)
    a = {(r.id1, r.id2): r.dist for r in pairwise_distances(pts, method="broadcast").collect()}
    b = {(r.id1, r.id2): r.dist for r in pairwise_distances(pts, method="blocks", block_rows=7).collect()}
    assert len(a) == 40 * 39 // 2 and a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k])
        assert a[k] == pytest.approx(float(np.sqrt(((X[k[0] - 1] - X[k[1] - 1]) ** 2).sum())))


def test_nearest_pair_ties_and_merge_step(spark):
    pts = pts_df(spark, [[0, 0], [1, 0], [0, 1], [1, 1]])
    pairs = pairwise_distances(pts)
    best = nearest_pair(pairs).first()
    assert (best.id1, best.id2, best.dist) == (1, 2, 1.0)
    pair = spark.createDataFrame([(1, 2, 3, 1)], "p1 LONG, p2 LONG, size1 INT, size2 INT")
    step = {(r.id1, r.id2): r.dist for r in merge_pair(pairs, pair.select("p1", "p2"), 5, "max").collect()}
    assert step == {(3, 4): 1.0, (3, 5): pytest.approx(2 ** 0.5), (4, 5): pytest.approx(2 ** 0.5)}
    avg = {(r.id1, r.id2): r.dist for r in merge_pair(pairs, pair, 5, "avg").collect()}
    assert avg[(3, 5)] == pytest.approx((3 * 1.0 + 2 ** 0.5) / 4)


def test_cluster_linkage_distance(spark):
    pts = pts_df(spark, [[0], [1], [5], [9]])
    asg = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 20)], "id LONG, cluster LONG")
    pairs = pairwise_distances(pts)
    got = {s: cluster_linkage_distance(pairs, asg, s).first().dist for s in ("min", "max", "avg")}
    assert got == {"min": 4.0, "max": 9.0, "avg": pytest.approx((5 + 9 + 4 + 8) / 4)}
    labelled = pts.join(asg, "id")
    for method in ("broadcast", "blocks"):
        carried = pairwise_distances(labelled, method=method, block_rows=2, label="cluster")
        assert cluster_linkage_distance(carried, strategy="max").first().dist == 9.0


def test_read_points_numbers_by_file_and_line(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("7,70\n")
    (tmp_path / "part-1.csv").write_text("".join(f"{i},{-i}\n" for i in range(28)))
    rows = [(r.id, r.features) for r in io.read_points(spark, str(tmp_path)).orderBy("id").collect()]
    assert rows == [(1, [7.0, 70.0])] + [(i + 2, [float(i), float(-i)]) for i in range(28)]
    by_key = [r.features[1] for r in io.read_points(spark, str(tmp_path), order_by="_c1").orderBy("id").collect()]
    assert by_key == sorted(by_key)


@pytest.mark.skipif(not os.path.exists(f"{REFERENCE}/data/C3-D20-I100"), reason="reference data absent")
def test_read_points_and_prefix(spark):
    pts = io.read_points(spark, f"{REFERENCE}/data/C3-D20-I100")
    first = pts.where("id = 1").first()
    assert pts.count() == 300 and len(first.features) == 20
    with open(f"{REFERENCE}/data/C3-D20-I100") as fh:
        line1 = [float(x) for x in fh.readline().split(",")]
    assert first.features == pytest.approx(line1)
    assert len(io.take_features(pts, 5).first().features) == 5


def test_with_point_ids_distributed(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("key")).repartition(5)
    ids = io.with_point_ids(df, ["key"]).collect()
    assert sorted(r.id for r in ids) == list(range(1, 1001))
    assert all(r.id == r.key + 1 for r in ids)


def test_sinks_round_trip(spark, tmp_path):
    merges = spark.createDataFrame([(4, 1, 2, 1.0, 2), (5, 4, 3, 2.0, 3)],
                                   "cluster LONG, point1 LONG, point2 LONG, height DOUBLE, size LONG")
    io.write_merges(merges, str(tmp_path / "m"))
    back = io.read_merges(spark, str(tmp_path / "m")).orderBy("cluster").collect()
    assert [tuple(r) for r in back] == [(4, 1, 2), (5, 4, 3)]
    assert [r.line for r in io.merge_lines(merges).orderBy("cluster").collect()] == ["4,1,2", "5,4,3"]
    sc = [tuple(r) for r in io.scipy_dendrogram(merges).collect()]
    assert sc == [(0, 1, 1.0, 2), (3, 2, 2.0, 3)]
    io.write_dendrogram(merges, str(tmp_path / "d"))
    io.write_assignments(spark.createDataFrame([(2, 5), (1, 5)], "id LONG, cluster LONG"), str(tmp_path / "a"))
    a = spark.read.csv(str(tmp_path / "a"), schema="id LONG, cluster LONG").collect()
    assert sorted(tuple(r) for r in a) == [(1, 5), (2, 5)]


def test_write_report(spark, tmp_path):
    rep = spark.createDataFrame([(3, 0.9, 2.0, 0.8, 1.5, 0.2, 10.0), (2, 0.5, 1.0, 0.4, 0.5, 0.9, 20.0)],
                                "k INT, silhouette DOUBLE, dunn DOUBLE, silhouette_bd DOUBLE, dunn_bd DOUBLE, "
                                "davis_bouldin DOUBLE, wssse DOUBLE")
    io.write_report(rep, str(tmp_path / "r"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "r")).collect()
    assert [int(r.k) for r in back] == [2, 3]
