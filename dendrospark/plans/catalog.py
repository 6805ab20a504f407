"""Registered queries over the driver tables, each paired (where SQL can
state it) with an independent DuckDB formulation in ``ORACLE``.

Points: ``supplier`` (id = s_suppkey + 1, features [s_acctbal,
s_nationkey]) and ``embeddings`` (id = vec_id + 1, 64 floats, ``label``
0-9 as a given clustering).  Every double is rounded to 6 decimals on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import (mean_vectors, other_endpoint, sq_norm,
                                 to_double_or_zero, weighted_sq_euclidean)
from ..operators import indices as V
from ..operators.block_pairs import label_linkage, nearest_points
from ..operators.bounded import dunn_min_max_bounded
from ..operators.centers import LinkageModel, centers, compute_cost, group_by_center, predict
from ..operators.dendrogram import all_ids, cluster_members, cluster_of, cut, is_cluster
from ..operators.linkage import (linkage, linkage_with_assignments, merge_members, midpoint_centers, midpoints,
                                 single_linkage, singletons)
from ..operators.pairs import cluster_sizes, median_by, merge_pair, nearest_pair, pairwise_distances
from ..operators.tree import ancestors, clusters_at
from ..session import Scratch
from ..sources.io import (merge_lines, points_from_table, read_merges, read_points, scipy_dendrogram, take_features,
                          write_assignments, write_merges, write_report)
from . import oracle_sql as O
from .pipelines import best_k, bisecting_grid, bisecting_report, build_and_evaluate, evaluate_grid, evaluate_model

REPORT_KS = list(range(2, 9))
CUT_K = 5
PREFIX_NV = 8
GRID_NVS, GRID_KS = [4, 8], [2, 3, 4]
# F3 weights: 1,2,3 repeating over the 64 components
WEIGHTS = [1 + (i % 3) for i in range(64)]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def sup_points(spark, sf):
    return points_from_table(_t(spark, sf, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"])


def tied_points(spark, sf):
    """Integers with many duplicates: ties at every distance."""
    return points_from_table(_t(spark, sf, "supplier"), "s_suppkey", ["s_nationkey"])


def emb_points(spark, sf):
    return points_from_table(_t(spark, sf, "embeddings"), "vec_id", vector_col="embedding")


def emb_labelled(spark, sf):
    e = _t(spark, sf, "embeddings")
    return e.select((F.col("vec_id") + 1).alias("id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("features"),
                    F.col("label").cast("long").alias("cluster"))


def r6(c):
    return F.round(c, 6)


def _n(df: DataFrame) -> int:
    return df.count()


# --------------------------------------------------------------- pairs ----

def q_pairwise_supplier(spark, sf):
    p = pairwise_distances(sup_points(spark, sf))
    return p.select("id1", "id2", r6("dist").alias("dist"))


def q_pairwise_embeddings(spark, sf):
    p = pairwise_distances(emb_points(spark, sf))
    return p.select("id1", "id2", r6("dist").alias("dist"))


def q_nearest_pair_embeddings(spark, sf):
    return nearest_points(emb_points(spark, sf)).select(
        "id1", "id2", r6("dist").alias("dist"))


def q_nearest_pair_supplier(spark, sf):
    return nearest_points(sup_points(spark, sf)).select(
        "id1", "id2", r6("dist").alias("dist"))


def q_pairwise_blocks_supplier(spark, sf):
    p = pairwise_distances(sup_points(spark, sf), method="blocks", block_rows=64)
    return p.select("id1", "id2", r6("dist").alias("dist"))


def _one_nearest(pts):
    """The merged pair, as a table of one row."""
    return nearest_points(pts).select(F.col("id1").alias("p1"), F.col("id2").alias("p2"))


def q_other_endpoint(spark, sf):
    pts = sup_points(spark, sf)
    j = pairwise_distances(pts).crossJoin(F.broadcast(_one_nearest(pts)))
    return j.select("id1", "id2", other_endpoint("id1", "id2", F.col("p1"), F.col("p2")).alias("other"))


def _merge_step(strategy):
    def q(spark, sf):
        pts = sup_points(spark, sf)
        pairs = pairwise_distances(pts)
        out = merge_pair(pairs, _one_nearest(pts), _n(pts) + 1, strategy)
        return out.select("id1", "id2", r6("dist").alias("dist"))
    return q


def _second_step(strategy):
    """The pair that merged first, of size 2, merges with its nearest."""
    def q(spark, sf):
        pts = sup_points(spark, sf)
        n = _n(pts)
        pairs = pairwise_distances(pts)
        once = merge_pair(pairs, _one_nearest(pts), n + 1, strategy)
        near = nearest_pair(once.where(F.col("id2") == n + 1)).select(
            F.col("id1").alias("p1"), F.col("id2").alias("p2"), F.lit(1).alias("size1"), F.lit(2).alias("size2"))
        return merge_pair(once, near, n + 2, strategy).select("id1", "id2", r6("dist").alias("dist"))
    return q


# ------------------------------------------------------- vector functions --

def q_weighted_sq_embeddings(spark, sf):
    pts = emb_labelled(spark, sf)
    cent = mean_vectors(pts, ["cluster"], "features", 64).select("cluster", "centroid")
    j = pts.join(F.broadcast(cent), "cluster")  # 10 label centroids
    w = F.array(*[F.lit(x) for x in WEIGHTS])
    return j.select("id", r6(weighted_sq_euclidean("features", "centroid", w)).alias("wsq"))


def q_feature_prefix(spark, sf):
    p = take_features(emb_points(spark, sf), PREFIX_NV)
    return p.select("id", F.size("features").cast("long").alias("nv"),
                    r6(sq_norm("features")).alias("sq_norm"))


def q_to_double(spark, sf):
    s = _t(spark, sf, "supplier")
    return s.select("s_suppkey", to_double_or_zero(F.split_part("s_name", F.lit("#"), F.lit(2)))
                    .alias("num"))


def q_median_acctbal(spark, sf):
    c = _t(spark, sf, "customer")
    return median_by(c, ["c_nationkey"], "c_acctbal", "median").select(
        "c_nationkey", r6("median").alias("median"))


def q_label_centroids(spark, sf):
    m = mean_vectors(emb_labelled(spark, sf), ["cluster"], "features", 64)
    return m.select("cluster", F.posexplode("centroid").alias("pos", "value")).select(
        "cluster", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


def q_label_sizes(spark, sf):
    return cluster_sizes(emb_labelled(spark, sf))


def _label_linkage(strategy):
    def q(spark, sf):
        d = label_linkage(emb_labelled(spark, sf), strategy)
        return d.select("cluster1", "cluster2", r6("dist").alias("dist"))
    return q


# ---------------------------------------------------------------- linkage --

def _merges_out(m):
    return m.select("cluster", "point1", "point2", r6("height").alias("height"), "size")


def _linkage_supplier(strategy):
    def q(spark, sf):
        return _merges_out(linkage(sup_points(spark, sf), strategy))
    return q


def _linkage_tied(strategy):
    def q(spark, sf):
        return _merges_out(linkage(tied_points(spark, sf), strategy))
    return q


def q_linkage_min_points_embeddings(spark, sf):
    """C1 without a pair table, in blocks of about 128 points."""
    return _merges_out(single_linkage(emb_points(spark, sf), block_points=128))


def q_linkage_min_ranges_tied(spark, sf):
    """C1 with ties, numbered in ranges of at most 16 tree edges."""
    return _merges_out(single_linkage(tied_points(spark, sf), block_points=32, range_edges=16))


def q_ranked_ids_customer(spark, sf):
    """S2 over a key with gaps."""
    c = _t(spark, sf, "customer").select((F.col("c_custkey") * 3 + 5).alias("key"), "c_acctbal")
    p = points_from_table(c, "key", ["c_acctbal"], dense_key=False)
    return p.select("id", r6(F.col("features")[0]).alias("x"))


def q_stored_merges_supplier(spark, sf):
    """The merge table, written and read again."""
    path = Scratch(spark, "stored").path("merges")
    write_merges(_sup_model(spark, sf)[2], path)
    return read_merges(spark, path)


def q_stored_assignments_supplier(spark, sf):
    """The assignments, written and read again."""
    path = Scratch(spark, "stored").path("assignments")
    write_assignments(linkage_with_assignments(sup_points(spark, sf), "avg", CUT_K)[1], path)
    return spark.read.csv(path, schema="id LONG, cluster LONG")


def q_linkage_avg_embeddings(spark, sf):
    return _merges_out(linkage(emb_points(spark, sf), "avg"))


def _sup_model(spark, sf):
    pts = sup_points(spark, sf)
    n = _n(pts)
    return pts, n, linkage(pts, "avg", n=n)


def q_cut_supplier(spark, sf):
    _, n, m = _sup_model(spark, sf)
    return cut(m, n, CUT_K)


def q_members_supplier(spark, sf):
    _, n, m = _sup_model(spark, sf)
    root = m.where(F.col("cluster") == 2 * n - 1).first()  # the root row: its two children
    a = cluster_members(m, n, int(root["point1"]))
    b = cluster_members(m, n, int(root["point2"]))
    return a.unionByName(b)


def q_cluster_of_supplier(spark, sf):
    pts, n, m = _sup_model(spark, sf)
    level = m.where(F.col("cluster") <= 2 * n - CUT_K)   # the stored K-level model
    base = (level.select(F.col("point1").alias("child"), "cluster")
            .unionByName(level.select(F.col("point2").alias("child"), "cluster")))
    return cluster_of(pts, base)


def q_is_cluster_supplier(spark, sf):
    _, n, m = _sup_model(spark, sf)
    return is_cluster(all_ids(spark, n), m.where(F.col("cluster") <= 2 * n - CUT_K))


def q_singletons_supplier(spark, sf):
    return singletons(spark, _n(sup_points(spark, sf)))


def q_merge_members_supplier(spark, sf):
    """The members of every merge."""
    _, n, m = _sup_model(spark, sf)
    return merge_members(m, n)


def q_merge_lines_supplier(spark, sf):
    return merge_lines(_sup_model(spark, sf)[2])


def q_dendrogram_supplier(spark, sf):
    d = scipy_dendrogram(_sup_model(spark, sf)[2])
    return d.select("p1", "p2", r6("dist").alias("dist"), "count")


def q_midpoints_supplier(spark, sf):
    pts, n, m = _sup_model(spark, sf)
    mp = midpoints(m, pts)
    return mp.select("cluster", r6(F.col("centroid")[0]).alias("c0"), r6(F.col("centroid")[1]).alias("c1"))


def q_midpoint_predict_supplier(spark, sf):
    """The midpoints of all merges as a model's centers."""
    pts, n, m = _sup_model(spark, sf)
    model = LinkageModel(m, n).with_centers(midpoint_centers(m, pts, n))
    return model.predict(pts).select("id", "center", r6("d2").alias("d2"))


def q_levels_supplier(spark, sf):
    """D3 and D4 from the ancestor table: every point asks for a level of its own."""
    pts, n, m = _sup_model(spark, sf)
    table, levels = ancestors(m, Scratch(spark, "levels"))
    return clusters_at(pts.select("id", (F.col("id") % 7 + 1).alias("k")), table, levels, n).select("id", "k", "cluster")


# ------------------------------------------------------------ model --------

def q_centers_fallback_supplier(spark, sf):
    """D5 where the level asked for has too few clusters of that size."""
    pts, n, m = _sup_model(spark, sf)
    c = centers(pts, m, n, CUT_K, min_size=n // 4, dim=2)
    return c.select("k", "center", "cluster", "size", r6(F.col("centroid")[0]).alias("c0"), r6(F.col("centroid")[1]).alias("c1"))


def q_file_report_supplier(spark, sf):
    """Points from a file, the report to a file and back."""
    scratch = Scratch(spark, "files")
    sup_points(spark, sf).orderBy("id").select(*[F.col("features")[i] for i in (0, 1)]).write.csv(scratch.path("points"))
    rep = build_and_evaluate(read_points(spark, scratch.path("points")), "avg", REPORT_KS[0], REPORT_KS[-1])
    write_report(rep, scratch.path("report"))
    ddl = ", ".join(f"{c} {'INT' if c == 'k' else 'DOUBLE'}" for c in rep.columns)
    return _report_cols(spark.read.csv(scratch.path("report"), schema=ddl, header=True))


def _sup_centers(spark, sf):
    pts, n, m = _sup_model(spark, sf)
    return pts, centers(pts, m, n, CUT_K, dim=2)


def q_centers_supplier(spark, sf):
    _, c = _sup_centers(spark, sf)
    return c.select("center", "cluster", "size", r6(F.col("centroid")[0]).alias("c0"),
                    r6(F.col("centroid")[1]).alias("c1"))


def q_predict_supplier(spark, sf):
    pts, c = _sup_centers(spark, sf)
    return predict(pts, c).select("id", "center", r6("d2").alias("d2"))


def q_predict_blocks_supplier(spark, sf):
    """Centers above the limit: blocks of one center each."""
    pts, c = _sup_centers(spark, sf)
    return predict(pts, c, broadcast_bytes=64).select("id", "center", r6("d2").alias("d2"))


def q_predict_balls_supplier(spark, sf):
    """The metric index, whatever the number of centers."""
    pts, c = _sup_centers(spark, sf)
    return predict(pts, c, index_from=1).select("id", "center", r6("d2").alias("d2"))


def q_cost_supplier(spark, sf):
    pts, c = _sup_centers(spark, sf)
    return compute_cost(predict(pts, c)).select(r6("cost").alias("cost"))


def q_group_by_center_supplier(spark, sf):
    pts, c = _sup_centers(spark, sf)
    return group_by_center(predict(pts, c)).select("center", "size")


# --------------------------------------------------------------- indices ---

def q_silhouette_labels(spark, sf):
    s = V.silhouette(emb_labelled(spark, sf), dim=64)
    return s.select(r6("b").alias("b"), r6("a").alias("a"), r6("silhouette").alias("silhouette"))


def q_silhouette_blocks_labels(spark, sf):
    """Clusters above the limit: blocks of a few clusters each."""
    s = V.silhouette(emb_labelled(spark, sf), dim=64, broadcast_bytes=2048)
    return s.select(r6("b").alias("b"), r6("a").alias("a"), r6("silhouette").alias("silhouette"))


def _ratio_q(fn, name):
    def q(spark, sf):
        d = fn(emb_labelled(spark, sf))
        return d.select(r6("inter").alias("inter"), r6("intra").alias("intra"), r6(name).alias(name))
    return q


def q_bd_labels(spark, sf):
    pts = emb_labelled(spark, sf)
    cent = mean_vectors(pts, ["cluster"], "features", 64).select(
        F.lit(0).alias("k"), F.col("cluster").cast("int").alias("center"), "centroid")
    pr = predict(pts.select("id", "features"), cent, ks=[0], dim=64)
    bd = V.bd_indices(pr, cent, ["k"])
    return bd.select(*[r6(c).alias(c) for c in ("silhouette_bd", "dunn_bd", "davis_bouldin", "wssse")])


def _report_cols(rep):
    return rep.select("k", *[r6(c).alias(c) for c in
                             ("silhouette", "dunn", "silhouette_bd", "dunn_bd", "davis_bouldin", "wssse")])


def q_report_supplier(spark, sf):
    pts, n, m = _sup_model(spark, sf)
    return _report_cols(evaluate_model(pts, m, n, REPORT_KS, dim=2))


def q_best_k_supplier(spark, sf):
    pts, n, m = _sup_model(spark, sf)
    return best_k(evaluate_model(pts, m, n, REPORT_KS, dim=2))


def q_report_embeddings(spark, sf):
    pts = emb_points(spark, sf)
    n = _n(pts)
    m = linkage(pts, "avg", n=n)
    return _report_cols(evaluate_model(pts, m, n, REPORT_KS, dim=64))


def q_bisecting_report_embeddings(spark, sf):
    return _report_cols(bisecting_report(emb_points(spark, sf), [2, 5, 10], seed=1, dim=64))


def q_grid_embeddings(spark, sf):
    g = evaluate_grid({"embeddings": emb_points(spark, sf)}, GRID_NVS, GRID_KS)
    return g.select("dataset", "nv", *_report_cols(g).columns)


def q_bisecting_grid_embeddings(spark, sf):
    g = bisecting_grid({"embeddings": emb_points(spark, sf)}, GRID_NVS, GRID_KS)
    return g.select("dataset", "nv", *_report_cols(g).columns)


def q_median_price_by_flag(spark, sf):
    rows = _t(spark, sf, "lineitem")
    return median_by(rows, ["l_returnflag"], "l_extendedprice").select("l_returnflag", r6("median").alias("median"))


def q_median_quantity(spark, sf):
    return median_by(_t(spark, sf, "lineitem"), [], "l_quantity").select(r6("median").alias("median"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pairwise_supplier": q_pairwise_supplier,
    "pairwise_embeddings": q_pairwise_embeddings,
    "nearest_pair_embeddings": q_nearest_pair_embeddings,
    "nearest_pair_supplier": q_nearest_pair_supplier,
    "pairwise_blocks_supplier": q_pairwise_blocks_supplier,
    "other_endpoint": q_other_endpoint,
    "merge_step_min": _merge_step("min"),
    "merge_step_max": _merge_step("max"),
    "merge_step_avg": _merge_step("avg"),
    "merge_step_wavg": _merge_step("wavg"),
    "second_step_avg": _second_step("avg"),
    "second_step_wavg": _second_step("wavg"),
    "weighted_sq_embeddings": q_weighted_sq_embeddings,
    "feature_prefix": q_feature_prefix,
    "to_double": q_to_double,
    "median_acctbal": q_median_acctbal,
    "median_price_by_flag": q_median_price_by_flag,
    "median_quantity": q_median_quantity,
    "label_centroids": q_label_centroids,
    "label_sizes": q_label_sizes,
    "label_linkage_min": _label_linkage("min"),
    "label_linkage_max": _label_linkage("max"),
    "label_linkage_avg": _label_linkage("avg"),
    "linkage_min_supplier": _linkage_supplier("min"),
    "linkage_max_supplier": _linkage_supplier("max"),
    "linkage_avg_supplier": _linkage_supplier("avg"),
    "linkage_wavg_supplier": _linkage_supplier("wavg"),
    "linkage_min_tied": _linkage_tied("min"),
    "linkage_max_tied": _linkage_tied("max"),
    "linkage_avg_tied": _linkage_tied("avg"),
    "linkage_wavg_tied": _linkage_tied("wavg"),
    "linkage_min_points_embeddings": q_linkage_min_points_embeddings,
    "linkage_min_ranges_tied": q_linkage_min_ranges_tied,
    "ranked_ids_customer": q_ranked_ids_customer,
    "stored_merges_supplier": q_stored_merges_supplier,
    "stored_assignments_supplier": q_stored_assignments_supplier,
    "linkage_avg_embeddings": q_linkage_avg_embeddings,
    "cut_supplier": q_cut_supplier,
    "members_supplier": q_members_supplier,
    "cluster_of_supplier": q_cluster_of_supplier,
    "is_cluster_supplier": q_is_cluster_supplier,
    "singletons_supplier": q_singletons_supplier,
    "merge_members_supplier": q_merge_members_supplier,
    "merge_lines_supplier": q_merge_lines_supplier,
    "dendrogram_supplier": q_dendrogram_supplier,
    "midpoints_supplier": q_midpoints_supplier,
    "midpoint_predict_supplier": q_midpoint_predict_supplier,
    "levels_supplier": q_levels_supplier,
    "centers_fallback_supplier": q_centers_fallback_supplier,
    "file_report_supplier": q_file_report_supplier,
    "centers_supplier": q_centers_supplier,
    "predict_supplier": q_predict_supplier,
    "predict_blocks_supplier": q_predict_blocks_supplier,
    "predict_balls_supplier": q_predict_balls_supplier,
    "cost_supplier": q_cost_supplier,
    "group_by_center_supplier": q_group_by_center_supplier,
    "silhouette_labels": q_silhouette_labels,
    "silhouette_blocks_labels": q_silhouette_blocks_labels,
    "dunn_labels": _ratio_q(lambda d: V.dunn(d, dim=64), "dunn"),
    "dunn_average_labels": _ratio_q(lambda d: V.dunn_average(d, dim=64), "dunn_average"),
    "dunn_min_max_labels": _ratio_q(lambda d: V.dunn_min_max(d), "dunn_min_max"),
    "dunn_min_max_bounded_labels": _ratio_q(dunn_min_max_bounded, "dunn_min_max"),
    "dunn_centroids_labels": _ratio_q(lambda d: V.dunn_centroids(d, dim=64), "dunn_centroids"),
    "bd_indices_labels": q_bd_labels,
    "report_supplier": q_report_supplier,
    "best_k_supplier": q_best_k_supplier,
    "report_embeddings": q_report_embeddings,
    "bisecting_report_embeddings": q_bisecting_report_embeddings,
    "grid_embeddings": q_grid_embeddings,
    "bisecting_grid_embeddings": q_bisecting_grid_embeddings,
}


# ------------------------------------------------------------------ SQL ----

def _ks(ks):
    return ", ".join(str(k) for k in ks)


SQ = O.sqd
_PAIR_SUP = (f"WITH {O.SUP_PTS} SELECT a.id AS id1, b.id AS id2, round(sqrt({SQ('a.f', 'b.f')}), 6) AS dist "
             "FROM sp a JOIN sp b ON a.id < b.id")
_PAIR_EMB = (f"WITH {O.EMB_PTS} SELECT a.id AS id1, b.id AS id2, round(sqrt({SQ('a.f', 'b.f')}), 6) AS dist "
             "FROM ep a JOIN ep b ON a.id < b.id")


def _nearest(pts_cte, name):
    return (f"WITH {pts_cte}, pr AS (SELECT a.id AS id1, b.id AS id2, sqrt({SQ('a.f', 'b.f')}) AS dist "
            f"FROM {name} a JOIN {name} b ON a.id < b.id) "
            "SELECT id1, id2, round(dist, 6) AS dist FROM pr ORDER BY dist, id1, id2 LIMIT 1")


_SUP_PAIRS = (f"{O.SUP_PTS}, pr AS (SELECT a.id AS id1, b.id AS id2, sqrt({SQ('a.f', 'b.f')}) AS dist "
              "FROM sp a JOIN sp b ON a.id < b.id), "
              "np AS (SELECT id1 AS p1, id2 AS p2 FROM pr ORDER BY dist, id1, id2 LIMIT 1)")


def _merge_step_sql(strategy):
    agg = {"min": "min(dist)", "max": "max(dist)", "avg": "sum(dist * 1.0) / sum(1.0)",
           "wavg": "avg(dist)"}[strategy]
    return (f"WITH {_SUP_PAIRS}, "
            "t AS (SELECT CASE WHEN id1 IN (np.p1, np.p2) THEN id2 ELSE id1 END AS o, dist FROM pr, np "
            "WHERE (id1 IN (np.p1, np.p2) OR id2 IN (np.p1, np.p2)) AND NOT (id1 = np.p1 AND id2 = np.p2)) "
            "SELECT id1, id2, round(dist, 6) AS dist FROM pr, np "
            "WHERE id1 NOT IN (np.p1, np.p2) AND id2 NOT IN (np.p1, np.p2) "
            f"UNION ALL SELECT o AS id1, (SELECT count(*) FROM sp) + 1 AS id2, round({agg}, 6) AS dist "
            "FROM t GROUP BY o")


def _second_step_sql(strategy):
    agg = {"avg": "sum(dist * w) / sum(w)", "wavg": "avg(dist)"}[strategy]
    return (f"WITH {_SUP_PAIRS}, nn AS (SELECT count(*) AS n FROM sp), "
            "t AS (SELECT CASE WHEN id1 IN (np.p1, np.p2) THEN id2 ELSE id1 END AS o, dist FROM pr, np "
            "WHERE (id1 IN (np.p1, np.p2) OR id2 IN (np.p1, np.p2)) AND NOT (id1 = np.p1 AND id2 = np.p2)), "
            "once AS (SELECT id1, id2, dist FROM pr, np WHERE id1 NOT IN (np.p1, np.p2) AND id2 NOT IN (np.p1, np.p2) "
            "UNION ALL SELECT o, n + 1, avg(dist) FROM t, nn GROUP BY o, n), "
            "m AS (SELECT id1 AS q1, id2 AS q2 FROM once, nn WHERE id2 = n + 1 ORDER BY dist, id1 LIMIT 1), "
            "u AS (SELECT CASE WHEN id1 IN (m.q1, m.q2) THEN id2 ELSE id1 END AS o, dist, "
            "CASE WHEN id1 = m.q2 OR id2 = m.q2 THEN 2 ELSE 1 END AS w FROM once, m "
            "WHERE (id1 IN (m.q1, m.q2) OR id2 IN (m.q1, m.q2)) AND NOT (id1 = m.q1 AND id2 = m.q2)) "
            "SELECT id1, id2, round(dist, 6) AS dist FROM once, m WHERE id1 NOT IN (m.q1, m.q2) AND id2 NOT IN (m.q1, m.q2) "
            f"UNION ALL SELECT o AS id1, n + 2 AS id2, round({agg}, 6) AS dist FROM u, nn GROUP BY o, n")


def _label_linkage_sql(agg):
    return (f"WITH {O.EMB_PTS} SELECT CAST(least(a.label, b.label) AS BIGINT) AS cluster1, "
            "CAST(greatest(a.label, b.label) AS BIGINT) AS cluster2, "
            f"round({agg}(sqrt({SQ('a.f', 'b.f')})), 6) AS dist FROM ep a JOIN ep b ON a.id < b.id "
            "WHERE a.label <> b.label GROUP BY 1, 2")


def _linkage_sql(pts_cte, name, strategy):
    return (f"WITH RECURSIVE {pts_cte}, {O.greedy_linkage(name, strategy)} "
            "SELECT cluster, point1, point2, round(height, 6) AS height, size FROM mg")


_SUP_AVG = f"WITH RECURSIVE {O.SUP_PTS}, {O.greedy_linkage('sp', 'avg')}"
_LAB_LABELS = "asg AS (SELECT 0 AS k, id, label AS c FROM ep)"


def _ratio_sql(cte, name):
    return (f"WITH {O.EMB_PTS}, {O.long_points('ep')}, {_LAB_LABELS}, {O.indices_sql('ep', 'asg')} "
            f"SELECT round(inter, 6) AS inter, round(intra, 6) AS intra, round({name}, 6) AS {name} FROM {cte}")


def _report_sql(pts_cte, name, ks, linkage_cte):
    return (f"{linkage_cte}, {O.climb(name, ks)}, {O.long_points(name)}, "
            f"{O.centers_of('lab')}, {O.predict_sql(name)}, "
            "asg AS (SELECT k, id, center AS c FROM pr), "
            f"{O.indices_sql(name, 'asg')}, {O.bd_sql()} ")


_REPORT_SEL = ("SELECT s.k, round(s.silhouette, 6) AS silhouette, round(d.dunn, 6) AS dunn, "
               "round(b.silhouette_bd, 6) AS silhouette_bd, round(b.dunn_bd, 6) AS dunn_bd, "
               "round(b.davis_bouldin, 6) AS davis_bouldin, round(b.wssse, 6) AS wssse "
               "FROM sil s JOIN dn d ON d.k = s.k JOIN bd b ON b.k = s.k")

_BEST = """, rep AS ({sel})
SELECT
  (SELECT k FROM rep WHERE NOT isnan(silhouette) AND silhouette IS NOT NULL ORDER BY silhouette DESC, k LIMIT 1) AS best_silhouette,
  (SELECT k FROM rep WHERE NOT isnan(dunn) AND dunn IS NOT NULL ORDER BY dunn DESC, k LIMIT 1) AS best_dunn,
  (SELECT k FROM rep WHERE NOT isnan(silhouette_bd) AND silhouette_bd IS NOT NULL ORDER BY silhouette_bd DESC, k LIMIT 1) AS best_silhouette_bd,
  (SELECT k FROM rep WHERE NOT isnan(dunn_bd) AND dunn_bd IS NOT NULL ORDER BY dunn_bd DESC, k LIMIT 1) AS best_dunn_bd,
  (SELECT k FROM rep WHERE NOT isnan(davis_bouldin) AND davis_bouldin IS NOT NULL ORDER BY davis_bouldin, k LIMIT 1) AS best_davis_bouldin
"""

_SUP_CENTERS = (f"{_SUP_AVG}, {O.climb('sp', [CUT_K])}, {O.long_points('sp')}, {O.centers_of('lab')}")



def _grid_sql():
    """Per prefix, the report over points cut to that many components."""
    parts = []
    for nv in GRID_NVS:
        pts = (f"ep AS (SELECT vec_id + 1 AS id, list_transform(embedding[1:{nv}], lambda x: CAST(x AS DOUBLE)) AS f "
               "FROM embeddings)")
        rep = _report_sql(pts, "ep", GRID_KS, f"WITH RECURSIVE {pts}, {O.greedy_linkage('ep', 'avg')}")
        parts.append(f"SELECT 'embeddings' AS dataset, {nv} AS nv, * FROM ({rep}{_REPORT_SEL})")
    return " UNION ALL ".join(parts)


_MIDPOINTS = (
        f"{_SUP_AVG}, "
        "md(step, node, v) AS ("
        "  SELECT 0, id, f FROM sp"
        "  UNION ALL"
        "  SELECT * FROM ("
        "    WITH known AS (SELECT * FROM md),"
        "    fresh AS (SELECT mg.cluster AS node,"
        "                     list_transform(range(1, len(k1.v) + 1), lambda i: (k1.v[i] + k2.v[i]) / 2.0) AS v"
        "              FROM mg JOIN known k1 ON k1.node = mg.point1 JOIN known k2 ON k2.node = mg.point2"
        "              WHERE mg.cluster NOT IN (SELECT node FROM known))"
        "    SELECT (SELECT max(step) FROM known) + 1, node, v FROM known"
        "    WHERE EXISTS (SELECT 1 FROM fresh)"
        "    UNION ALL SELECT (SELECT max(step) FROM known) + 1, node, v FROM fresh"
        "  )"
        "), fin AS (SELECT node, v FROM md WHERE step = (SELECT max(step) FROM md)) ")


def _fallback_sql(k, part):
    """Level by level: too few clusters of the size asked for, so one level down
    with a size that shrinks by the largest cluster's share."""
    return (f"{_SUP_AVG}, allk AS (SELECT unnest(range(1, n + 1)) AS k FROM nn), "
            "par AS (SELECT point1 AS node, cluster AS up FROM mg UNION ALL SELECT point2, cluster FROM mg), "
            "cl(k, id, node) AS (SELECT allk.k, sp.id, sp.id FROM sp, allk UNION ALL "
            "SELECT cl.k, cl.id, par.up FROM cl JOIN par ON par.node = cl.node, nn WHERE par.up <= 2 * nn.n - cl.k), "
            "lab AS (SELECT k, id, max(node) AS cluster FROM cl GROUP BY k, id), "
            "sz AS (SELECT k, cluster, count(*) AS m FROM lab GROUP BY k, cluster), "
            "lv AS (SELECT k, max(m) AS largest, list(m) AS ms FROM sz GROUP BY k), "
            f"st(k, ms, ok) AS (SELECT lv.k, nn.n // {part}, len(list_filter(lv.ms, lambda x: x >= nn.n // {part})) >= {k} "
            f"FROM lv, nn WHERE lv.k = {k} UNION ALL "
            "SELECT nx.k, CAST(floor(st.ms / nn.n * lv.largest + 0.5) AS BIGINT), "
            f"len(list_filter(nx.ms, lambda x: x >= floor(st.ms / nn.n * lv.largest + 0.5))) >= {k} "
            "FROM st JOIN lv ON lv.k = st.k JOIN lv nx ON nx.k = st.k + 1, nn WHERE NOT st.ok AND st.k < nn.n - 5), "
            f"top AS (SELECT sz.k, sz.cluster, sz.m FROM sz JOIN st ON st.ok AND st.k = sz.k AND sz.m >= st.ms "
            f"ORDER BY m DESC, cluster LIMIT {k}) "
            "SELECT CAST(top.k AS INTEGER) AS k, CAST(row_number() OVER (ORDER BY top.cluster) - 1 AS INTEGER) AS center, top.cluster, "
            "any_value(top.m) AS size, round(avg(sp.f[1]), 6) AS c0, round(avg(sp.f[2]), 6) AS c1 "
            "FROM top JOIN lab ON lab.k = top.k AND lab.cluster = top.cluster JOIN sp ON sp.id = lab.id "
            "GROUP BY top.k, top.cluster")


ORACLE: dict[str, str] = {
    "pairwise_supplier": _PAIR_SUP,
    "pairwise_embeddings": _PAIR_EMB,
    "nearest_pair_embeddings": _nearest(O.EMB_PTS, "ep"),
    "nearest_pair_supplier": _nearest(O.SUP_PTS, "sp"),
    "other_endpoint": (f"WITH {_SUP_PAIRS} SELECT id1, id2, CASE WHEN id1 IN (p1, p2) THEN id2 "
                       "WHEN id2 IN (p1, p2) THEN id1 ELSE 0 END AS other FROM pr, np"),
    "merge_step_min": _merge_step_sql("min"),
    "merge_step_max": _merge_step_sql("max"),
    "merge_step_avg": _merge_step_sql("avg"),
    "merge_step_wavg": _merge_step_sql("wavg"),
    "pairwise_blocks_supplier": _PAIR_SUP,
    "second_step_avg": _second_step_sql("avg"),
    "second_step_wavg": _second_step_sql("wavg"),
    "ranked_ids_customer": ("SELECT row_number() OVER (ORDER BY c_custkey) AS id, "
                            "round(CAST(c_acctbal AS DOUBLE), 6) AS x FROM customer"),
    "weighted_sq_embeddings": (
        f"WITH {O.EMB_PTS}, {O.long_points('ep')}, "
        "cl AS (SELECT e.label, pl.pos, avg(pl.x) AS v FROM ep e JOIN pl ON pl.id = e.id GROUP BY e.label, pl.pos), "
        "cv AS (SELECT label, list(v ORDER BY pos) AS c FROM cl GROUP BY label), "
        f"w AS (SELECT [{', '.join(str(x) for x in WEIGHTS)}] AS w) "
        "SELECT e.id, round(list_reduce(list_transform(range(1, len(w.w) + 1), "
        "lambda i: CAST(w.w[i] AS DOUBLE) * ((e.f[i] - cv.c[i]) * (e.f[i] - cv.c[i]))), "
        "lambda x, y: x + y), 6) AS wsq FROM ep e JOIN cv ON cv.label = e.label, w"),
    "feature_prefix": (f"WITH {O.EMB_PTS} SELECT id, len(f[1:{PREFIX_NV}]) AS nv, "
                       f"round(list_reduce(list_transform(f[1:{PREFIX_NV}], lambda x: x * x), "
                       "lambda x, y: x + y), 6) AS sq_norm FROM ep"),
    "to_double": ("SELECT s_suppkey, CASE WHEN split_part(s_name, '#', 2) = '' THEN 0.0 "
                  "ELSE CAST(split_part(s_name, '#', 2) AS DOUBLE) END AS num FROM supplier"),
    "median_acctbal": ("SELECT c_nationkey, round(median(c_acctbal), 6) AS median FROM customer "
                       "GROUP BY c_nationkey"),
    "median_price_by_flag": ("SELECT l_returnflag, round(median(l_extendedprice), 6) AS median FROM lineitem "
                             "GROUP BY l_returnflag"),
    "median_quantity": "SELECT round(median(l_quantity), 6) AS median FROM lineitem",
    "label_centroids": (f"WITH {O.EMB_PTS}, {O.long_points('ep')} SELECT CAST(e.label AS BIGINT) AS cluster, "
                        "CAST(pl.pos - 1 AS BIGINT) AS pos, "
                        "round(avg(pl.x), 6) AS value FROM ep e JOIN pl ON pl.id = e.id GROUP BY 1, 2"),
    "label_sizes": "SELECT CAST(label AS BIGINT) AS cluster, count(*) AS size FROM embeddings GROUP BY label",
    "label_linkage_min": _label_linkage_sql("min"),
    "label_linkage_max": _label_linkage_sql("max"),
    "label_linkage_avg": _label_linkage_sql("avg"),
    "linkage_min_supplier": _linkage_sql(O.SUP_PTS, "sp", "min"),
    "linkage_max_supplier": _linkage_sql(O.SUP_PTS, "sp", "max"),
    "linkage_avg_supplier": _linkage_sql(O.SUP_PTS, "sp", "avg"),
    "linkage_wavg_supplier": _linkage_sql(O.SUP_PTS, "sp", "wavg"),
    "linkage_min_tied": _linkage_sql(O.TIED_PTS, "tp", "min"),
    "linkage_max_tied": _linkage_sql(O.TIED_PTS, "tp", "max"),
    "linkage_avg_tied": _linkage_sql(O.TIED_PTS, "tp", "avg"),
    "linkage_wavg_tied": _linkage_sql(O.TIED_PTS, "tp", "wavg"),
    "linkage_min_points_embeddings": _linkage_sql(O.EMB_PTS, "ep", "min"),
    "linkage_min_ranges_tied": _linkage_sql(O.TIED_PTS, "tp", "min"),
    "stored_merges_supplier": f"{_SUP_AVG} SELECT cluster, point1, point2 FROM mg",
    "stored_assignments_supplier": f"{_SUP_AVG}, {O.climb('sp', [CUT_K])} SELECT id, cluster FROM lab",
    "linkage_avg_embeddings": _linkage_sql(O.EMB_PTS, "ep", "avg"),
    "cut_supplier": f"{_SUP_AVG}, {O.climb('sp', [CUT_K])} SELECT id, cluster FROM lab",
    "members_supplier": (
        f"{_SUP_AVG}, root AS (SELECT point1, point2 FROM mg WHERE cluster = (SELECT 2 * n - 1 FROM nn)), "
        "tg AS (SELECT point1 AS t FROM root UNION ALL SELECT point2 FROM root), "
        "ch AS (SELECT cluster, point1 AS child FROM mg UNION ALL SELECT cluster, point2 FROM mg), "
        "dn(t, node) AS (SELECT t, t FROM tg UNION ALL SELECT dn.t, ch.child FROM dn JOIN ch ON ch.cluster = dn.node) "
        "SELECT t AS cluster, node AS id FROM dn, nn WHERE node <= nn.n"),
    "cluster_of_supplier": (
        f"{_SUP_AVG}, half AS (SELECT mg.* FROM mg, nn WHERE cluster <= 2 * nn.n - {CUT_K}), "
        "hp AS (SELECT point1 AS node, cluster AS up FROM half UNION ALL SELECT point2, cluster FROM half), "
        "cl(id, node) AS (SELECT id, id FROM sp UNION ALL SELECT cl.id, hp.up FROM cl JOIN hp ON hp.node = cl.node) "
        "SELECT id, max(node) AS cluster FROM cl GROUP BY id"),
    "is_cluster_supplier": (
        f"{_SUP_AVG}, ids AS (SELECT unnest(range(1, 2 * n)) AS id FROM nn) "
        "SELECT ids.id, EXISTS (SELECT 1 FROM mg, nn WHERE mg.cluster = ids.id "
        f"AND mg.cluster <= 2 * nn.n - {CUT_K}) AS is_cluster FROM ids"),
    "singletons_supplier": "SELECT s_suppkey + 1 AS id, s_suppkey + 1 AS cluster FROM supplier",
    "merge_members_supplier": (
        f"{_SUP_AVG}, ch AS (SELECT cluster, point1 AS child FROM mg UNION ALL SELECT cluster, point2 FROM mg), "
        "dn(cluster, node) AS (SELECT cluster, child FROM ch "
        "UNION ALL SELECT dn.cluster, ch.child FROM dn JOIN ch ON ch.cluster = dn.node) "
        "SELECT cluster, node AS id FROM dn, nn WHERE node <= nn.n"),
    "merge_lines_supplier": (f"{_SUP_AVG} SELECT cluster, concat_ws(',', CAST(cluster AS VARCHAR), "
                             "CAST(point1 AS VARCHAR), CAST(point2 AS VARCHAR)) AS line FROM mg"),
    "dendrogram_supplier": (f"{_SUP_AVG} SELECT point1 - 1 AS p1, point2 - 1 AS p2, round(height, 6) AS dist, "
                            "size AS count FROM mg"),
    "midpoints_supplier": f"{_MIDPOINTS} SELECT node AS cluster, round(v[1], 6) AS c0, round(v[2], 6) AS c1 FROM fin, nn WHERE node > nn.n",
    "midpoint_predict_supplier": (
        f"{_MIDPOINTS}, cen AS (SELECT 1 AS k, CAST(node - nn.n - 1 AS INTEGER) AS center, v AS c FROM fin, nn WHERE node > nn.n), "
        f"{O.predict_sql('sp')} SELECT id, center, round(d2, 6) AS d2 FROM pr"),
    "levels_supplier": (f"{_SUP_AVG}, {O.climb('sp', range(1, 8))} "
                        "SELECT id, CAST(k AS BIGINT) AS k, cluster FROM lab WHERE k = id % 7 + 1"),
    "centers_fallback_supplier": _fallback_sql(CUT_K, 4),
    "file_report_supplier": _report_sql(O.SUP_PTS, "sp", REPORT_KS, _SUP_AVG) + _REPORT_SEL,
    "centers_supplier": (f"{_SUP_CENTERS} SELECT center, cluster, size, round(c[1], 6) AS c0, "
                         "round(c[2], 6) AS c1 FROM cen"),
    "predict_supplier": f"{_SUP_CENTERS}, {O.predict_sql('sp')} SELECT id, center, round(d2, 6) AS d2 FROM pr",
    "predict_balls_supplier": f"{_SUP_CENTERS}, {O.predict_sql('sp')} SELECT id, center, round(d2, 6) AS d2 FROM pr",
    "predict_blocks_supplier": (f"{_SUP_CENTERS}, {O.predict_sql('sp')} "
                                "SELECT id, center, round(d2, 6) AS d2 FROM pr"),
    "cost_supplier": f"{_SUP_CENTERS}, {O.predict_sql('sp')} SELECT round(sum(d2), 6) AS cost FROM pr",
    "group_by_center_supplier": (f"{_SUP_CENTERS}, {O.predict_sql('sp')} "
                                 "SELECT center, count(*) AS size FROM pr GROUP BY center"),
    "silhouette_labels": (f"WITH {O.EMB_PTS}, {O.long_points('ep')}, {_LAB_LABELS}, {O.indices_sql('ep', 'asg')} "
                          "SELECT round(b, 6) AS b, round(a, 6) AS a, round(silhouette, 6) AS silhouette FROM sil"),
    "silhouette_blocks_labels": (f"WITH {O.EMB_PTS}, {O.long_points('ep')}, {_LAB_LABELS}, {O.indices_sql('ep', 'asg')} "
                                 "SELECT round(b, 6) AS b, round(a, 6) AS a, round(silhouette, 6) AS silhouette FROM sil"),
    "dunn_labels": _ratio_sql("dn", "dunn"),
    "dunn_average_labels": _ratio_sql("dav", "dunn_average"),
    "dunn_min_max_labels": _ratio_sql("mm", "dunn_min_max"),
    "dunn_min_max_bounded_labels": _ratio_sql("mm", "dunn_min_max"),
    "dunn_centroids_labels": _ratio_sql("dc", "dunn_centroids"),
    "bd_indices_labels": (
        f"WITH {O.EMB_PTS}, {O.long_points('ep')}, "
        "lab AS (SELECT 0 AS k, id, label AS cluster FROM ep), "
        "cenl AS (SELECT a.k, a.cluster, pl.pos, avg(pl.x) AS v FROM lab a JOIN pl ON pl.id = a.id "
        "GROUP BY a.k, a.cluster, pl.pos), "
        "cen AS (SELECT k, CAST(cluster AS INTEGER) AS center, list(v ORDER BY pos) AS c FROM cenl GROUP BY k, cluster), "
        f"{O.predict_sql('ep')}, {O.bd_sql()} "
        "SELECT round(silhouette_bd, 6) AS silhouette_bd, round(dunn_bd, 6) AS dunn_bd, "
        "round(davis_bouldin, 6) AS davis_bouldin, round(wssse, 6) AS wssse FROM bd"),
    "report_supplier": _report_sql(O.SUP_PTS, "sp", REPORT_KS, _SUP_AVG) + _REPORT_SEL,
    "best_k_supplier": (_report_sql(O.SUP_PTS, "sp", REPORT_KS, _SUP_AVG)
                        + _BEST.format(sel=_REPORT_SEL)),
    "report_embeddings": (_report_sql(O.EMB_PTS, "ep", REPORT_KS,
                                      f"WITH RECURSIVE {O.EMB_PTS}, {O.greedy_linkage('ep', 'avg')}")
                          + _REPORT_SEL),
    "grid_embeddings": _grid_sql(),
}
