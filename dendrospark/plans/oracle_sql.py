"""DuckDB SQL that states each registered query independently of the Spark
plan: greedy one-merge-per-step linkage as a recursive CTE, brute-force pair
sums for the indices.  Used only as the correctness oracle.

Point CTEs expose ``(id, f)`` with ``f`` a ``DOUBLE[]``.
"""

from __future__ import annotations

SUP_PTS = ("sp AS (SELECT s_suppkey + 1 AS id, "
           "[CAST(s_acctbal AS DOUBLE), CAST(s_nationkey AS DOUBLE)] AS f FROM supplier)")
TIED_PTS = "tp AS (SELECT s_suppkey + 1 AS id, [CAST(s_nationkey AS DOUBLE)] AS f FROM supplier)"
EMB_PTS = ("ep AS (SELECT vec_id + 1 AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f, "
           "label FROM embeddings)")


def sqd(u: str, v: str) -> str:
    """Squared Euclidean distance of two lists, summed left to right."""
    return (f"list_reduce(list_transform(range(1, len({u}) + 1), "
            f"lambda i: ({u}[i] - {v}[i]) * ({u}[i] - {v}[i])), lambda x, y: x + y)")


def r6(x: str) -> str:
    return f"round({x}, 6)"


def greedy_linkage(pts: str, strategy: str) -> str:
    """CTEs ``nn(n)``, ``lk`` (recursive) and ``mg(cluster, point1, point2,
    height, size)``: merge the closest pair, one per step; clusters are named
    by their smallest leaf while the steps run.  Ties go to the smallest pair
    of such names (d, a, b); under single linkage to the smallest pair of leaves
    at that distance, kept in c as p * 2^32 + q."""
    agg = {
        "min": "min(t.d), NULL::DOUBLE, arg_min(t.c, {'d': t.d, 'c': t.c})",
        "max": "max(t.d), NULL::DOUBLE, NULL::BIGINT",
        "wavg": "avg(t.d), NULL::DOUBLE, NULL::BIGINT",
        "avg": "sum(t.s) / sum(t.c), sum(t.s), sum(t.c)",
    }[strategy]
    dist = f"sqrt({sqd('x.f', 'y.f')})"
    first_c = "x.id * 4294967296 + y.id" if strategy == "min" else "1"
    order = "d, c" if strategy == "min" else "d, a, b"
    return f"""
nn AS (SELECT count(*) AS n FROM {pts}),
lk(step, kind, a, b, d, s, c, sz, h, cid, p1, p2) AS (
  SELECT 0, 'E', x.id, y.id, {dist}, {dist}, ({first_c})::BIGINT, NULL::BIGINT, NULL::DOUBLE,
         NULL::BIGINT, NULL::BIGINT, NULL::BIGINT
  FROM {pts} x JOIN {pts} y ON x.id < y.id
  UNION ALL
  SELECT 0, 'N', id, NULL, NULL, NULL, NULL, 1, 0.0, id, NULL, NULL FROM {pts}
  UNION ALL
  SELECT * FROM (
    WITH cur AS (SELECT * FROM lk WHERE kind <> 'M'),
    bst AS (SELECT a AS ba, b AS bb, d AS bd, step AS bstep FROM cur WHERE kind = 'E'
            ORDER BY {order} LIMIT 1),
    na AS (SELECT cur.sz AS sa, cur.h AS ha, cur.cid AS ca FROM cur, bst
           WHERE cur.kind = 'N' AND cur.a = bst.ba),
    nb AS (SELECT cur.sz AS sb, cur.h AS hb, cur.cid AS cb FROM cur, bst
           WHERE cur.kind = 'N' AND cur.a = bst.bb),
    t AS (SELECT CASE WHEN e.a IN (bst.ba, bst.bb) THEN e.b ELSE e.a END AS o, e.d, e.s, e.c
          FROM cur e, bst
          WHERE e.kind = 'E' AND (e.a IN (bst.ba, bst.bb) OR e.b IN (bst.ba, bst.bb))
            AND NOT (e.a = bst.ba AND e.b = bst.bb))
    SELECT bst.bstep + 1, 'E', e.a, e.b, e.d, e.s, e.c, NULL, NULL, NULL, NULL, NULL
    FROM cur e, bst
    WHERE e.kind = 'E' AND e.a NOT IN (bst.ba, bst.bb) AND e.b NOT IN (bst.ba, bst.bb)
    UNION ALL
    SELECT bst.bstep + 1, 'E', least(t.o, bst.ba), greatest(t.o, bst.ba), {agg},
           NULL, NULL, NULL, NULL, NULL
    FROM t, bst GROUP BY t.o, bst.ba, bst.bstep
    UNION ALL
    SELECT bst.bstep + 1, 'N', e.a, NULL, NULL, NULL, NULL, e.sz, e.h, e.cid, NULL, NULL
    FROM cur e, bst WHERE e.kind = 'N' AND e.a NOT IN (bst.ba, bst.bb)
    UNION ALL
    SELECT bst.bstep + 1, 'N', bst.ba, NULL, NULL, NULL, NULL, na.sa + nb.sb,
           greatest(bst.bd, na.ha, nb.hb), nn.n + bst.bstep + 1, NULL, NULL
    FROM bst, na, nb, nn
    UNION ALL
    SELECT bst.bstep + 1, 'M', NULL, NULL, NULL, NULL, NULL, na.sa + nb.sb,
           greatest(bst.bd, na.ha, nb.hb), nn.n + bst.bstep + 1,
           CASE WHEN na.ca <= nn.n AND nb.cb <= nn.n THEN least(na.ca, nb.cb)
                ELSE greatest(na.ca, nb.cb) END,
           CASE WHEN na.ca <= nn.n AND nb.cb <= nn.n THEN greatest(na.ca, nb.cb)
                ELSE least(na.ca, nb.cb) END
    FROM bst, na, nb, nn
  )
),
mg AS (SELECT cid AS cluster, p1 AS point1, p2 AS point2, h AS height, sz AS size
       FROM lk WHERE kind = 'M')"""


def climb(pts: str, ks: list[int]) -> str:
    """CTEs ``par``, ``cl`` (recursive) and ``lab(k, id, cluster)``: each
    point's topmost ancestor among merges numbered <= 2n - k."""
    klist = ", ".join(str(k) for k in ks)
    return f"""
par AS (SELECT point1 AS node, cluster AS up FROM mg UNION ALL SELECT point2, cluster FROM mg),
cl(k, id, node) AS (
  SELECT kk.k, p.id, p.id FROM {pts} p, (SELECT unnest([{klist}]) AS k) kk
  UNION ALL
  SELECT cl.k, cl.id, par.up FROM cl JOIN par ON par.node = cl.node, nn
  WHERE par.up <= 2 * nn.n - cl.k
),
lab AS (SELECT k, id, max(node) AS cluster FROM cl GROUP BY k, id)"""


def long_points(pts: str) -> str:
    """CTE ``pl(id, pos, x)``: one row per vector component."""
    return f"pl AS (SELECT id, generate_subscripts(f, 1) AS pos, unnest(f) AS x FROM {pts})"


def centers_of(asg: str) -> str:
    """CTE ``cen(k, center, cluster, size, c)`` from an assignment
    ``asg(k, id, cluster)`` and ``pl``: mean per cut cluster, centers numbered
    by cluster id within each k."""
    return f"""
cenl AS (SELECT a.k, a.cluster, pl.pos, avg(pl.x) AS v, count(*) AS m
         FROM {asg} a JOIN pl ON pl.id = a.id GROUP BY a.k, a.cluster, pl.pos),
cen AS (SELECT k, cluster, max(m) AS size, list(v ORDER BY pos) AS c,
               CAST(row_number() OVER (PARTITION BY k ORDER BY cluster) - 1 AS INTEGER) AS center
        FROM cenl GROUP BY k, cluster)"""


def predict_sql(pts: str, cen: str = "cen") -> str:
    """CTE ``pr(k, id, center, d2)``: nearest center, ties to the lower index."""
    return f"""
prall AS (SELECT c.k, p.id, c.center, {sqd('p.f', 'c.c')} AS d2 FROM {pts} p JOIN {cen} c ON TRUE),
pr AS (SELECT k, id, center, d2 FROM (
         SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY d2, center) AS rn FROM prall)
       WHERE rn = 1)"""


def indices_sql(pts: str, asg: str) -> str:
    """Brute-force pair CTEs over ``asg(k, id, c)``:
    ``sil(k, b, a, silhouette)``, ``dn(k, inter, intra, dunn)``,
    ``dav(k, inter, intra, dunn_average)``, ``mm(k, inter, intra, dunn_min_max)``,
    ``dc(k, inter, intra, dunn_centroids)``.  Needs ``pl``."""
    return f"""
pd AS (SELECT x.id AS i, y.id AS j, {sqd('x.f', 'y.f')} AS d2 FROM {pts} x JOIN {pts} y ON x.id <> y.id),
sz AS (SELECT k, c, count(*) AS m FROM {asg} GROUP BY k, c),
pc AS (SELECT a1.k, a1.id AS i, a2.c AS cj, sum(pd.d2) AS tot
       FROM {asg} a1 JOIN pd ON pd.i = a1.id JOIN {asg} a2 ON a2.k = a1.k AND a2.id = pd.j
       GROUP BY a1.k, a1.id, a2.c),
ag AS (SELECT a.k, a.id, a.c AS ci, si.m AS mi, sj.c AS cj, sj.m AS mj, coalesce(pc.tot, 0.0) AS tot
       FROM {asg} a JOIN sz si ON si.k = a.k AND si.c = a.c
       JOIN sz sj ON sj.k = a.k
       LEFT JOIN pc ON pc.k = a.k AND pc.i = a.id AND pc.cj = sj.c),
pab AS (SELECT k, id,
          max(CASE WHEN cj = ci THEN (CASE WHEN mi > 1 THEN tot / (mi - 1) ELSE 'NaN'::DOUBLE END) END) AS a,
          coalesce(min(CASE WHEN cj <> ci THEN tot / mj END), 0.0) AS b
        FROM ag GROUP BY k, id),
sil AS (SELECT k, avg(b) AS b, avg(a) AS a,
          avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 'NaN'::DOUBLE END) AS silhouette
        FROM pab GROUP BY k),
cs AS (SELECT k, ci, cj, sum(tot) AS t, max(mi) AS mi, max(mj) AS mj FROM ag GROUP BY k, ci, cj),
dn AS (SELECT k, inter, intra, CASE WHEN intra > 0 THEN inter / intra END AS dunn FROM (
         SELECT k, min(CASE WHEN ci <> cj THEN t / (mi * mj) END) AS inter,
                max(CASE WHEN ci = cj AND mi > 1 THEN t / (mi * (mi - 1)) END) AS intra
         FROM cs GROUP BY k)),
dav AS (SELECT k, inter, intra,
          CASE WHEN isnan(intra) THEN 'NaN'::DOUBLE WHEN intra > 0 THEN inter / intra END AS dunn_average
        FROM (SELECT k, avg(CASE WHEN ci <> cj THEN t / (mi * mj) END) AS inter,
                     avg(CASE WHEN ci = cj THEN (CASE WHEN mi > 1 THEN t / (mi * (mi - 1))
                                                     ELSE 'NaN'::DOUBLE END) END) AS intra
              FROM cs GROUP BY k)),
mm AS (SELECT k, inter, intra, CASE WHEN intra > 0 THEN inter / intra END AS dunn_min_max FROM (
         SELECT a1.k, min(CASE WHEN a1.c <> a2.c THEN pd.d2 END) AS inter,
                max(CASE WHEN a1.c = a2.c THEN pd.d2 END) AS intra
         FROM pd JOIN {asg} a1 ON a1.id = pd.i JOIN {asg} a2 ON a2.k = a1.k AND a2.id = pd.j
         GROUP BY a1.k)),
mul AS (SELECT a.k, a.c, pl.pos, avg(pl.x) AS v FROM {asg} a JOIN pl ON pl.id = a.id GROUP BY a.k, a.c, pl.pos),
mu AS (SELECT k, c, list(v ORDER BY pos) AS mv FROM mul GROUP BY k, c),
dc AS (SELECT i.k, i.inter, w.intra, CASE WHEN w.intra > 0 THEN i.inter / w.intra END AS dunn_centroids
       FROM (SELECT x.k, min({sqd('x.mv', 'y.mv')}) AS inter FROM mu x JOIN mu y ON x.k = y.k AND x.c < y.c
             GROUP BY x.k) i
       JOIN (SELECT k, max(sp) AS intra FROM (
               SELECT a.k, a.c, avg({sqd('p.f', 'm.mv')}) AS sp
               FROM {asg} a JOIN {pts} p ON p.id = a.id JOIN mu m ON m.k = a.k AND m.c = a.c
               GROUP BY a.k, a.c) GROUP BY k) w ON w.k = i.k)"""


def bd_sql(pr: str = "pr", cen: str = "cen") -> str:
    """CTE ``bd(k, silhouette_bd, dunn_bd, davis_bouldin, wssse)``."""
    return f"""
wss AS (SELECT k, sum(d2) AS wssse, count(*) AS npts, max(d2) AS maxd FROM {pr} GROUP BY k),
cp AS (SELECT a.k, a.center AS ia, b.center AS ib, {sqd('a.c', 'b.c')} AS d2c, a.c <> b.c AS dv
       FROM {cen} a JOIN {cen} b ON a.k = b.k AND a.center <> b.center),
cc AS (SELECT k, avg(CASE WHEN dv THEN d2c END) AS inter, min(CASE WHEN dv THEN d2c END) AS mina
       FROM cp GROUP BY k),
kc AS (SELECT k, count(*) AS kreq FROM {cen} GROUP BY k),
spd AS (SELECT k, center, avg(d2) AS sp FROM {pr} GROUP BY k, center),
db AS (SELECT k, sum(rmax) AS dbsum FROM (
         SELECT cp.k, cp.ia, max(CASE WHEN cp.d2c > 0 THEN (sa.sp + sb.sp) / cp.d2c ELSE 'inf'::DOUBLE END) AS rmax
         FROM cp JOIN spd sa ON sa.k = cp.k AND sa.center = cp.ia
                 JOIN spd sb ON sb.k = cp.k AND sb.center = cp.ib
         GROUP BY cp.k, cp.ia) GROUP BY k),
bd AS (SELECT w.k,
         CASE WHEN greatest(cc.inter, w.wssse / w.npts) > 0
              THEN (cc.inter - w.wssse / w.npts) / greatest(cc.inter, w.wssse / w.npts) END AS silhouette_bd,
         CASE WHEN w.maxd > 0 THEN cc.mina / w.maxd END AS dunn_bd,
         db.dbsum / kc.kreq AS davis_bouldin, w.wssse
       FROM wss w LEFT JOIN cc ON cc.k = w.k LEFT JOIN kc ON kc.k = w.k LEFT JOIN db ON db.k = w.k)"""
