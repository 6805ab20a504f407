"""Distributed dense ranking (the building block behind point ids and merge
numbering).

``row_number()`` over a window without ``partitionBy`` moves every row into
one task.  Instead: range-partitioned sort, reliable checkpoint (which
freezes partition order and contents), per-partition counts (one row per
partition), their running offsets (a table as small as the partition
count), and ``offset + position in partition`` for every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def global_rank(df: DataFrame, order_cols: list | None, out: str = "rank",
                start: int = 0) -> DataFrame:
    sorted_df = df.orderBy(*order_cols) if order_cols else df
    frozen = sorted_df.checkpoint(eager=True)
    tagged = frozen.withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_p", F.shiftright("_mid", _POS_BITS))
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: bounded by the partition count, safe to window
    # and to broadcast
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    pos = F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    return (tagged.join(F.broadcast(offsets), "_p")
            .withColumn(out, (F.col("_off") + pos + F.lit(start)).cast("long"))
            .drop("_mid", "_p", "_off"))
