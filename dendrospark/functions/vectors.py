"""Column expressions over ``ARRAY<DOUBLE>`` feature vectors.

Everything here is a built-in higher-order function, so it stays inside
whole-stage codegen on the JVM; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)


def same_size(v1: ColumnOrName, v2: ColumnOrName, expr: Column,
              what: str = "vectors") -> Column:
    """``expr`` when both arrays have the same length, else a runtime error
    (the reference raises on a dimension mismatch)."""
    a, b = _c(v1), _c(v2)
    return F.when(F.size(a) == F.size(b), expr).otherwise(
        F.raise_error(F.lit(f"dimension mismatch between {what}")))


def sq_euclidean(v1: ColumnOrName, v2: ColumnOrName, check: bool = False,
                 dim: int | None = None) -> Column:
    """sum of squared component differences, summed left to right.

    With ``dim`` known the sum is unrolled into plain indexed arithmetic,
    which whole-stage codegen compiles (higher-order functions such as
    ``zip_with``/``aggregate`` are evaluated interpreted, row by row);
    without it, the higher-order form handles any length.  The unrolled form
    takes the dimension as validated (``vector_dim`` over the table): a
    per-row size check around 64 unrolled terms would push the generated
    method past the codegen limit and fall back to interpretation."""
    a, b = _c(v1), _c(v2)
    if dim:
        e = F.lit(0.0)
        for i in range(dim):
            d = a[i] - b[i]
            e = e + d * d
        return e
    else:
        e = _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    return same_size(a, b, e) if check else e


def euclidean(v1: ColumnOrName, v2: ColumnOrName, check: bool = True,
              dim: int | None = None) -> Column:
    """Euclidean distance; raises on a dimension mismatch."""
    return F.sqrt(sq_euclidean(v1, v2, check=check, dim=dim))


def weighted_sq_euclidean(v1: ColumnOrName, v2: ColumnOrName,
                          weights: ColumnOrName) -> Column:
    """sum_i w_i (v1_i - v2_i)^2 over the length of the weights."""
    a, b, w = _c(v1), _c(v2), _c(weights)
    n = F.size(w)
    d = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y))
    return _sum(F.zip_with(w, d, lambda wi, di: wi.cast("double") * di))


def sq_norm(v: ColumnOrName) -> Column:
    return _sum(F.transform(_c(v), lambda x: x * x))


def vmid(v1: ColumnOrName, v2: ColumnOrName) -> Column:
    """Unweighted midpoint of two vectors (used by C7)."""
    return F.zip_with(_c(v1), _c(v2), lambda x, y: (x + y) / 2.0)


def to_double_or_zero(s: ColumnOrName) -> Column:
    """empty string -> 0.0, otherwise a numeric parse.  Under ANSI mode
    the cast raises on text that is not a number, as the reference does."""
    c = _c(s)
    return F.when(c == "", F.lit(0.0)).otherwise(c.cast("double"))


def other_endpoint(id1: ColumnOrName, id2: ColumnOrName,
                   p1: ColumnOrName, p2: ColumnOrName) -> Column:
    """the end of the pair (id1, id2) that is not one of the merged
    p1/p2; 0 when neither end is."""
    a, b, x, y = _c(id1), _c(id2), _c(p1), _c(p2)
    return (F.when(a.isin(x, y), b)
            .when(b.isin(x, y), a)
            .otherwise(F.lit(0).cast("long")))


def vector_dim(df: DataFrame, col: str = "features") -> int:
    """Dimension of a vector column, checked to be the same on every row."""
    r = df.agg(F.min(F.size(col)).alias("lo"), F.max(F.size(col)).alias("hi")).first()
    if r is None or r["lo"] is None:
        return 0
    if r["lo"] != r["hi"]:
        raise ValueError(f"dimension mismatch: vectors of size {r['lo']} and {r['hi']}")
    return int(r["lo"])


def vector_sums(df: DataFrame, keys: list[str], col: str, dim: int,
                with_sq: bool = True) -> DataFrame:
    """Per group: n, component-wise sum ARRAY<DOUBLE>, and sum of squared norms.

    One hash aggregate with ``dim`` sum buffers: partial aggregation happens
    map side, so a hot group costs one row per map task in the shuffle.
    """
    aggs = [F.count(F.lit(1)).alias("n"),
            F.array(*[F.sum(F.col(col)[i]) for i in range(dim)]).alias("s")]
    if with_sq:
        aggs.append(F.sum(sq_norm(col)).alias("q"))
    return df.groupBy(*keys).agg(*aggs)


def mean_vectors(df: DataFrame, keys: list[str], col: str, dim: int,
                 out: str = "centroid") -> DataFrame:
    """Component-wise mean per group -> (keys..., n, centroid)."""
    s = vector_sums(df, keys, col, dim, with_sq=False)
    return s.select(*keys, "n",
                    F.transform("s", lambda x: x / F.col("n")).alias(out))
