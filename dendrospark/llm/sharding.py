"""Jump consistent hashing (native): stable keys to shards without a ring.

The published generator (Lamping and Veach 2014) is stepped on columns: the
64-bit state ``key * 2862933555777941757 + 1`` is kept as two unsigned 32-bit
halves, multiplied by 16-bit limbs, so that no long overflows under ANSI mode.
The buckets a key jumps through do not depend on the shard count, so its shard
for n shards is the last jump below n, and one walk answers n and n + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, whole_text

MULTIPLIER = 2862933555777941757
_MH, _ML = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW32 = 0xFFFFFFFF


def _u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_LOW32))


def _mul32(hi16: Column, lo16: Column, m: int) -> Column:
    """(hi16 * 2^16 + lo16) * m mod 2^32."""
    return F.shiftleft((hi16 * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16) + _u32(lo16 * F.lit(m))


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of (hi * 2^32 + lo) * MULTIPLIER + 1 mod 2^64."""
    l0, l1 = lo.bitwiseAND(F.lit(0xFFFF)), F.shiftright(lo, 16)
    h0, h1 = hi.bitwiseAND(F.lit(0xFFFF)), F.shiftright(hi, 16)
    t0, t1 = l0 * F.lit(_ML), l1 * F.lit(_ML)
    low = _u32(t0) + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = (F.shiftright(low, 32) + F.shiftright(t0, 32) + F.shiftright(t1, 16)
            + _mul32(h1, h0, _ML) + _mul32(l1, l0, _MH))
    return _u32(high), _u32(low)


def jump_shards(key: Column, shards: int) -> Column:
    """Struct ``(shard, grown_shard)`` of a long key for ``shards`` and
    ``shards + 1`` shards.  A null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    n1 = F.lit(shards + 1)
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("g"),
                     F.lit(0).cast("long").alias("j"),
                     _u32(F.shiftright(key, 32)).alias("hi"), _u32(key).alias("lo"))

    def walk(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        # the state's top 31 bits pick how far the key jumps
        jump = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1)))
        moved = F.struct(F.when(s["j"] < F.lit(shards), s["j"]).otherwise(s["b"]).alias("b"),
                         s["j"].alias("g"), jump.cast("long").alias("j"),
                         hi.alias("hi"), lo.alias("lo"))
        return F.when(s["j"] < n1, moved).otherwise(s)

    # bucket numbers grow with every jump, so shards + 1 steps always suffice
    return F.aggregate(F.sequence(F.lit(1), n1), start, walk,
                       lambda s: F.struct(s["b"].cast("int").alias("shard"),
                                          s["g"].cast("int").alias("grown_shard")))


def shard_documents(docs: DataFrame, shards: int = 24, slot_rows: int = 100_000) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot,
    grown_shard``.  The law is ``key``: the shard follows from ``doc_id`` and
    the shard count alone, so equal texts may lie in different shards.

    ``slot`` numbers the rows of a shard from 0 without gaps.  Each shard is
    cut into hash buckets of about ``slot_rows`` rows, rows are numbered within
    a bucket and the counts of earlier buckets are added, so no task ever holds
    a whole shard.  Only six narrow columns are shuffled.

    Null text: no bytes, crc32 0.  Null doc_id: key 0.  Repeated doc_ids share
    a shard and get slots of their own.  Other columns are ignored.
    """
    binary = whole_text().cast("binary")
    rows = (docs.select("doc_id", (F.octet_length(whole_text()).cast("long") + 8).alias("size"),
                        F.crc32(binary).alias("text_crc32"))
            .withColumn("at", jump_shards(F.col("doc_id"), shards))
            .select("doc_id", "size", "text_crc32", "at.shard", "at.grown_shard"))
    n = docs.count()
    buckets = blocks_for(n, shards * slot_rows)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # shards x buckets rows: one for each slot_rows documents
    from pyspark.sql import Window
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("i", F.row_number().over(within))
    return numbered.join(first, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("i") - 1).cast("long").alias("slot"), "grown_shard")


def op8_jump_sharding(spark, sf_dir):
    """All documents in shards 0 to 23."""
    from .common import table
    return shard_documents(table(spark, sf_dir, "documents"), 24)


#: The same walk on DuckDB's unsigned 128-bit integers, and CRC-32 bit by bit.
ORACLE = """
WITH RECURSIVE walk AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS b, 0::BIGINT AS g, 0::BIGINT AS j,
         CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END AS k
  FROM documents
  UNION ALL
  SELECT doc_id, CASE WHEN j < 24 THEN j ELSE b END, j,
         CAST(floor((j + 1) * (2147483648.0::DOUBLE / (((k2 >> 33) + 1)::DOUBLE))) AS BIGINT), k2
  FROM (SELECT doc_id, b, g, j,
               -- (kh * 2^32 + kl) * m + 1 mod 2^64, by halves that fit 128 bits
               ((((k >> 32) * 2862933555777941757) % 4294967296) * 4294967296
                 + (k % 4294967296) * 2862933555777941757 + 1) % 18446744073709551616 AS k2
        FROM walk WHERE j < 25)
),
placed AS (SELECT doc_id, max_by(b, j)::INT AS shard, max_by(g, j)::INT AS grown_shard FROM walk GROUP BY doc_id),
bits AS (
  SELECT list_transform(range(256), lambda i:
           list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]), lambda c, z:
             CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hexed AS (SELECT r, hex(encode(text)) AS h, strlen(text) AS n FROM d),
crcs AS (
  SELECT r, CASE WHEN n = 0 THEN 0 ELSE xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(n), lambda i:
             (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
           lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8))) END AS crc
  FROM hexed, bits)
SELECT d.doc_id, (strlen(d.text) + 8)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY d.doc_id, strlen(d.text), crc) - 1)::BIGINT AS slot, grown_shard
FROM d JOIN crcs USING (r) JOIN placed USING (doc_id)
"""
