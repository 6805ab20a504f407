"""Session helpers: building a local session for tests/bench, and the
shared scratch area used to cut lineage between iterative rounds.

The scratch area lives under ``spark.checkpoint.dir`` (a shared folder on a
cluster).  Library code only *reads* that setting; ``ensure_checkpoint_dir``
fills it in for local runs (tests, bench, the driver smoke check) when it is
unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Upper bound, in bytes, for anything this package broadcasts explicitly.
# Every explicit broadcast checks its estimated size against it first.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "dendrospark") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by the cluster, or None if unset."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    return d or None


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it
    (a cluster that installs it, or gets it by --py-files, is not affected)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the checkpoint folder.  Where it is unset, ``fallback`` is set,
    or a temporary folder if the master is local; executors of a cluster could
    not see one, so there it is an error."""
    share_package(spark)
    d = checkpoint_dir(spark)
    if d is None:
        if not fallback and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = fallback or tempfile.mkdtemp(prefix="dendrospark-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir() or d
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


class Scratch:
    """Per-run folder of Parquet tables under the checkpoint dir.

    ``put`` writes a DataFrame and returns it re-read, which cuts lineage and
    resets size estimates; the files sit in the shared folder, so a lost
    executor only costs a re-read, never a recomputation of earlier rounds.
    """

    def __init__(self, spark: SparkSession, tag: str = "run"):
        base = checkpoint_dir(spark)
        if base is None:
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative operators need a "
                "shared folder to cut lineage (call ensure_checkpoint_dir in "
                "local runs)")
        self.spark = spark
        self.root = f"{base.rstrip('/')}/dendrospark-{tag}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        p = self.path(name)
        df.write.mode("overwrite").parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)      # no job to infer it

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(self.path(name))

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a finished round's table through the Hadoop FileSystem of
        the checkpoint folder (keeps scratch space O(one round))."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        try:
            p.getFileSystem(conf).delete(p, True)
        except Py4JJavaError as e:      # left behind, but results do not depend on it
            warnings.warn(f"could not delete {self.path(name)}: {e.java_exception}", stacklevel=2)


def fits_broadcast(rows: int, bytes_per_row: int,
                   limit: int = DEFAULT_BROADCAST_BYTES) -> bool:
    return rows * bytes_per_row <= limit

