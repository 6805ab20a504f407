"""Scans (S1-S4) and sinks (K1-K4).

Points are ``(id LONG, features ARRAY<DOUBLE>)`` with ids 1..n; merge
tables are ``(cluster, point1, point2[, height, size])``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import global_rank

MERGE_SCHEMA = "cluster LONG, point1 LONG, point2 LONG"


def read_points(spark: SparkSession, path: str, delimiter: str = ",",
                order_by: str | None = None) -> DataFrame:
    """S1 + S2: header-less delimited text, every column numeric, packed into
    one ``features`` array.  Ids follow the files' names and, within a file,
    its lines, however the scan is split; ``order_by`` names a column (``_c0``,
    ``_c1``, ...) to number by instead.  A field that is no number is an error
    (ANSI cast); an empty one is null."""
    raw = spark.read.option("header", "false").option("delimiter", delimiter).csv(path)
    cols = raw.columns
    # a split's rows are numbered in the order of its lines
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
             F.monotonically_increasing_id().alias("_line")]
    packed = raw.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("features"),
                        *([F.col(order_by).cast("double").alias("_key")] if order_by else []), *place)
    keys = [*(["_key"] if order_by else []), "_file", "_block", "_line"]
    return with_point_ids(packed, keys).select("id", "features")


def points_from_table(df: DataFrame, key: str, feature_cols: list[str] | None = None,
                      vector_col: str | None = None, dense_key: bool = True) -> DataFrame:
    """Points from a table with a key column.  ``dense_key`` means the key
    already runs 0..n-1 (id = key + 1, no ranking pass; ``linkage`` checks it);
    otherwise ids are assigned by a distributed rank over the key."""
    if vector_col is not None:
        feats = F.transform(vector_col, lambda x: x.cast("double"))
    else:
        feats = F.array(*[F.col(c).cast("double") for c in feature_cols])
    if dense_key:
        return df.select((F.col(key) + 1).cast("long").alias("id"), feats.alias("features"))
    packed = df.select(F.col(key), feats.alias("features"))
    return with_point_ids(packed, [key]).drop(key)


def with_point_ids(df: DataFrame, order_cols: list[str] | None) -> DataFrame:
    """Dense 1-based ``id``.  With ``order_cols`` the rank follows them
    (range-partitioned sort + per-partition offsets, no single-task window);
    without, it follows the scan order of the input."""
    ranked = global_rank(df, order_cols, out="id", start=1)
    return ranked.select("id", *[c for c in df.columns])


def take_features(points: DataFrame, nv: int, col: str = "features") -> DataFrame:
    """S3: keep the first ``nv`` components of each vector."""
    return points.withColumn(col, F.slice(col, 1, nv))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """Text ``cluster,point1,point2`` lines."""
    return spark.read.csv(path, schema=MERGE_SCHEMA, header=False)


def merge_lines(merges: DataFrame) -> DataFrame:
    """K1 formatter: one ``cluster,point1,point2`` line per merge."""
    return merges.select("cluster", F.concat_ws(",", "cluster", "point1", "point2").alias("line"))


def write_merges(merges: DataFrame, path: str, line_sep: str = "\n") -> None:
    """K1: ``cluster,point1,point2`` lines in the order of cluster ids, through
    a range-partitioned sort: the part files follow one another."""
    (merges.select("cluster", "point1", "point2").orderBy("cluster")
     .write.mode("overwrite").option("lineSep", line_sep).csv(path))


def write_assignments(assignments: DataFrame, path: str) -> None:
    """K2: ``id,cluster`` sorted by point id (range-partitioned sort)."""
    assignments.select("id", "cluster").orderBy("id").write.mode("overwrite").csv(path)


def scipy_dendrogram(merges: DataFrame) -> DataFrame:
    """K3 projection: SciPy linkage rows (0-based children, height, count)."""
    return merges.orderBy("cluster").select(
        (F.col("point1") - 1).alias("p1"), (F.col("point2") - 1).alias("p2"),
        F.col("height").alias("dist"), F.col("size").alias("count"))


def write_dendrogram(merges: DataFrame, path: str) -> None:
    """K3: SciPy 4-column linkage matrix as CSV, part files in order."""
    scipy_dendrogram(merges).write.mode("overwrite").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """K4: one row per K (the report is |K| rows)."""
    report.orderBy("k").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
