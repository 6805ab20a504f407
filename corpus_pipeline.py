"""Corpus pipeline: raw documents to packed training sequences.

``run(spark, sf_dir)`` applies STAGES to ``documents``.  A stage takes (spark,
docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's docs.  All stages but the last return the columns of
``documents``; each decision takes effect: rejected documents and near copies
are gone, repeated passages are cut out of ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark.llm import langid, packing, simhash, suffix_dedup, toxicity
from dendrospark.llm.common import fold, scratch, table
from dendrospark.session import fits_broadcast


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold of their language.
    The classifier learns from the labelled documents outside fold 2 of 4."""
    net = toxicity.learn(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    return toxicity.score(docs, net, keep=True)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or in none of the languages that the
    documents outside fold 2 of 4 are marked with: those below the floor of the
    language they resemble most, which the same documents set."""
    known = docs.where(fold("doc_id", 4) != 2)
    profiles = langid.learn(known)
    return langid.identify(docs, profiles, keep_from=langid.floors(known, profiles))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group whose SimHash
    fingerprints (3-word shingles) are linked by at most 2 bits.  A null id
    counts as a large one made from the text, so any document with an id comes
    first.  Rows that repeat an id and text count as one."""
    made = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    named = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), made))
    work = scratch(spark, "near-copies")
    found = simhash.near_duplicates(named.select(F.col("_id").alias("doc_id"), "text"), 3, 2)
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.expr("doc_id = component_id")).alias("first"))
    gone = work.put(ids.where("NOT first").select("_id"), "gone")
    keys = ["_id", F.xxhash64("text").alias("_text")]
    twice = work.put(named.select(*keys).groupBy("_id", "_text").count().where("count > 1").select("_id", "_text"), "twice")
    gone, twice = (F.broadcast(x) if fits_broadcast(x.count(), 64) else x for x in (gone, twice))
    # texts stay where they are, but those of rows that repeat
    kept = named.select(*docs.columns, *keys).join(gone, "_id", "left_anti")
    once = kept.join(twice, ["_id", "_text"], "left_anti")
    again = kept.join(twice, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"])
    return once.unionByName(again).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 200-byte strings that occur elsewhere out of the texts."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece in sequences of at most 4096 tokens."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

#: The stages learn models, follow links and pack greedily; SQL cannot state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.put(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
