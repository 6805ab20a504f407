import os

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from dendrospark.functions.vectors import mean_vectors
from dendrospark.operators.centers import predict
from dendrospark.streaming import predict_stream

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
def test_predict_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/embeddings.parquet")
    schema = src.schema
    pts = lambda df: df.select((F.col("vec_id") + 1).alias("id"),
                               F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    lab = pts(src).join(src.select((F.col("vec_id") + 1).alias("id"), F.col("label").alias("cluster")), "id")
    cent = mean_vectors(lab, ["cluster"], "features", 64).select(
        F.lit(0).alias("k"), F.col("cluster").cast("int").alias("center"), "centroid")
    batch = {r.id: r.center for r in predict(pts(src), cent, ks=[0], dim=64).collect()}
    stream = pts(spark.readStream.schema(schema).option("pathGlobFilter", "embeddings.parquet").parquet(SF))
    q = (predict_stream(stream, cent, ks=[0], dim=64).select("id", "center")
         .writeStream.format("memory").queryName("assign_stream")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.id: r.center for r in spark.sql("SELECT * FROM assign_stream").collect()}
    assert got == batch
