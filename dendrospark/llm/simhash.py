"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The perfect
binary Golay code [23, 12, 7] covers every 23-bit word; the indices of all
codewords within 4 bits of it (one, or six where the nearest is 3 away) are
keys that any two words at most 2 bits apart have in common.  Fingerprints 2
bits apart leave one of three segments untouched (pigeonhole), so the keys
``(segment X exactly, a Golay index of segment Y)`` for the pairs A-B, B-C and
C-A bring every such pair together.  Pairs that meet are verified on all bits.

A key that more than ``bucket`` fingerprints share is not paired off: its
fingerprints meet instead on the words at most one bit away from them, which
two of them share exactly if they are at most 2 bits apart, and which at most
65 fingerprints can share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import byte_slices, release_memory, scratch, table, whole_text
from .components import components

#: Generator polynomial of the [23, 12, 7] code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
SEED = 42
RADIUS = 2


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(text: str, size: int, chunk: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles of a text, in chunks."""
    words = text.encode().lower().split()          # bytes: ASCII case, ASCII space
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    size = min(size, len(words))
    first = starts[:len(words) - size + 1].tolist()
    last = (starts + lengths)[size - 1:].tolist()
    one = xxhash.xxh64_intdigest
    for i in range(0, len(first), chunk):
        spans = zip(first[i:i + chunk], last[i:i + chunk])
        hashes = [one(joined[a:b], SEED) for a, b in spans]
        yield np.array(hashes, dtype=np.uint64)


def fingerprint(text: str, size: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingle hashes."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, size):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist())


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fp LONG)`` of every document."""
    def run(batches):
        release_memory()
        for b in batches:
            for part in byte_slices(b, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                fps = np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id LONG, fp LONG")


# ------------------------------------------------------------------ Golay keys
def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 high bits, and for each of the 2048 syndromes its
    error patterns of at most 4 bits, -1 where there are fewer than 6."""
    from itertools import combinations
    unit = [_remainder(1 << i) for i in range(23)]
    high = np.array([_remainder(i << 11) for i in range(4096)], dtype=np.int64)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = 0
            for i in at:
                s ^= unit[i]
            found[s].append(sum(1 << i for i in at))
    return high, np.array([x + [-1] * (6 - len(x)) for x in found], dtype=np.int64)


def golay_indices(words: np.ndarray, high: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """12-bit indices of the codewords within 4 bits of each 23-bit word, one
    row of 6 for each (-1: none)."""
    errors = patterns[(words & 0x7FF) ^ high[words >> 11]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def golay_keys(fps: np.ndarray, high: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of all keys of unsigned fingerprints."""
    a = (fps & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (fps >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fps >> np.uint64(46)).astype(np.int64)
    rows, keys = [], []
    for kind, (exact, fuzzy) in enumerate(((a, b), (b, c), (c, a))):
        index = golay_indices(fuzzy, high, patterns)
        at, k = np.nonzero(index >= 0)
        rows.append(at)
        keys.append((np.int64(kind) << 35) | (exact[at] << 12) | index[at, k])
    return np.concatenate(rows), np.concatenate(keys)


def candidate_keys(fps: DataFrame) -> DataFrame:
    """``(fp, rep)`` -> ``(key, fp, rep)``, up to 18 rows for each."""
    def run(batches):
        high, patterns = golay_tables()
        for b in batches:
            fp = b.column("fp").to_numpy()
            rep = b.column("rep").to_numpy()
            at, key = golay_keys(fp.view(np.uint64), high, patterns)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at]), pa.array(rep[at])],
                                             ["key", "fp", "rep"])

    return fps.mapInArrow(run, "key LONG, fp LONG, rep LONG")


# ----------------------------------------------------------------------- links
def links(fps: DataFrame, work: Scratch, radius: int = RADIUS, bucket: int = 64) -> DataFrame:
    """Links ``(a, b)`` between the ``rep`` of distinct fingerprints at most
    ``radius`` (0 to 2) bits apart; fingerprints of a crowded key are linked
    through their common neighbours, in stars."""
    if not 0 <= radius <= 2:
        raise ValueError("Golay keys of this layout cover 0 to 2 differing bits")
    keys = work.put(candidate_keys(fps), "keys")
    # a table of its own, so that Spark can split a hot key of the join
    sizes = work.put(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    met = work.put(keys.join(sizes, "key"), "met")
    small = met.where(F.col("n") <= bucket)
    x = small.select("key", F.col("fp").alias("f1"), F.col("rep").alias("a"))
    y = small.select("key", F.col("fp").alias("f2"), F.col("rep").alias("b"))
    apart = F.bit_count(F.col("f1").bitwiseXOR(F.col("f2")))
    near = x.join(y, (x["key"] == y["key"]) & (F.col("f1") < F.col("f2")) & (apart <= radius))
    crowded = met.where(F.col("n") > bucket).select("fp", "rep").distinct()
    one = F.lit(1).cast("long")
    flips = [F.col("fp").bitwiseXOR(F.shiftleft(one, i)) for i in range(64)]
    balls = crowded.select("fp", "rep", F.explode(F.array("fp", *flips)).alias("word"))
    # at most 65 fingerprints lie within one bit of a word
    met_there = balls.groupBy("word").agg(F.collect_list(F.struct("rep", "fp")).alias("reps")).where(
        F.size("reps") > 1)
    if radius == 2:
        first = met_there.select("reps", F.array_min("reps").alias("x"))
    else:
        first = met_there.select("reps", F.explode("reps").alias("x"))
    stars = first.select("x", F.explode("reps").alias("y")).where(
        F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).where("a <> b")
    return near.select("a", "b").unionByName(stars.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = RADIUS, bucket: int = 64) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document; documents
    whose fingerprints differ in at most ``radius`` bits are linked.

    Fewer words than ``size``: one shingle of all words.  No word (null, empty
    or blank text): fingerprint zero, linked like any other.  Null doc_ids take
    part; component_id is the smallest id that is not null, null if there is
    none.  Repeated rows are returned as often.  Other columns are ignored; an
    empty table gives an empty result.
    """
    work = scratch(docs.sparkSession, "simhash")
    prints = work.put(fingerprints(docs, size), "prints")
    # the distinct fingerprints are the nodes: an id may be null or stand for several texts
    reps = work.put(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "reps")
    linked = components(links(reps.select("fp", F.col("fp").alias("rep")), work, radius, bucket), work)
    named = work.put(reps.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
                     .select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark, sf_dir):
    """SimHash components of all documents: 3-word shingles, at most 2 bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, RADIUS)
