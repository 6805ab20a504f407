"""Models that learn from all documents."""

import pytest
from pyspark.sql import functions as F

from dendrospark.llm import langid, toxicity


def test_language_profiles_count_every_document(spark):
    """More documents than the former bound of 8192 a language."""
    docs = spark.range(9000).selectExpr("id AS doc_id", "'abc' AS text", "'xx' AS lang")
    p = langid.learn(docs.unionByName(docs.limit(1).selectExpr("-1L AS doc_id", "repeat('z ', 20000) AS text", "lang")))
    assert p.grams[p.ranks[:-1, 0] == 0].tolist() == langid.grams("z")[:1].tolist()     # 20,000 z against 9,000 a
    got = docs.unionByName(docs)
    counted = []
    whole = langid.identify
    langid.identify = lambda d, *a, **k: counted.append(d.count()) or whole(d, *a, **k)
    try:
        langid.floors(got, p)
    finally:
        langid.identify = whole
    assert counted == [18000]


@pytest.mark.parametrize("per_shard", [32768, 3000])
def test_toxicity_learns_from_every_labelled_document(spark, per_shard):
    """Words of documents beyond the former bound of 4000 a label, in one shard and several."""
    late = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), "doc_id"), 11) / F.lit(float(1 << 53)) >= 4000 / 4500
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), F.lit("xx").alias("lang"))
    text = F.when(late, F.when(F.col("toxic") == 1, "vile").otherwise("calm")).otherwise(
        F.when(F.col("toxic") == 1, "mean").otherwise("kind"))
    docs = rows.withColumn("text", F.concat_ws(" ", F.lit("a"), text, F.lit("word")))
    net = toxicity.learn(docs, rows.select("doc_id", "toxic"), per_shard=per_shard)
    vile, calm, mean, kind = net.score([f"a {w} word" for w in ("vile", "calm", "mean", "kind")])
    assert min(vile, mean) > 0.9 and max(calm, kind) < 0.1
    assert 0.1 < net.thresholds["xx"] < 0.9
