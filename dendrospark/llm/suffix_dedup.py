"""Repeated byte strings, found on a sparse suffix array sorted deep-shallow.

Wanted is every byte that some string of ``length`` bytes covers which starts
at another place, too.  Sorting a suffix for each byte of a corpus would move
each byte hundreds of times, so suffixes are first met by *anchors*: a window
of ``length`` bytes is filed under its smallest hash of ``GRAM`` bytes (the
leftmost of equals).  Equal windows have equal anchors at equal places, so
windows filed under different hashes never need comparing.  An anchor's windows
start side by side; their bytes are its *context*.

1. Anchors whose hash occurs once are dropped; no window of theirs repeats.
2. If a hash has one context only, all its windows repeat.
3. Of any other hash, each different context is fetched once, and the suffixes
   at all its window starts are sorted: multikey quicksort on 8-byte words down
   to a shallow depth, then a blind trie for each group that is still tied.
   Suffixes that share ``length`` bytes are repeats of each other.  Hashes with
   very many contexts, too many for one task, compare 128-bit digests of their
   windows in a shuffle instead.
4. The repeated windows' bytes are joined back to the texts as spans.

Identical texts are one text with several copies throughout.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ..session import Scratch
from .common import blocks_for, scratch, table, whole_text

LENGTH, GRAM = 200, 32
#: Bytes looked through at a time; longer texts go in overlapping segments.
SEGMENT = 1 << 18
#: 8-byte words that the multikey quicksort looks at before the blind tries.
SHALLOW = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


# --------------------------------------------------------------------- anchors
def gram_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes in a row, at least GRAM of them."""
    h = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)) * _MIX
    h ^= h >> np.uint64(32)
    h = h[:-8] * _MIX + h[8:]
    h ^= h >> np.uint64(29)
    h = h[:-16] * _MIX + h[16:]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h


def segment_anchors(raw: bytes, length: int) -> tuple[np.ndarray, ...]:
    """``(hash, first window start, last window start)`` of a segment."""
    h = gram_hashes(raw)
    place = np.uint64(SEGMENT * 2 - 1)
    v = (h & ~place) | np.arange(len(h), dtype=np.uint64)       # leftmost of the smallest
    span, step = length - GRAM + 1, 1
    while step * 2 <= span:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if step < span:
        v = np.minimum(v[:step - span], v[span - step:])
    at = (v & place).astype(np.int64)
    cut = np.flatnonzero(at[1:] != at[:-1])
    first = np.concatenate(([0], cut + 1))
    return h[at[first]], first, np.concatenate((cut, [len(at) - 1]))


def anchors(raw: bytes, length: int = LENGTH):
    """``(hash, context digest, start, windows - 1)`` of all anchors."""
    digest = xxhash.xxh64_intdigest
    for base in range(0, max(0, len(raw) - length + 1), SEGMENT):
        part = raw[base:base + SEGMENT + length - 1]
        h, first, last = segment_anchors(part, length)
        contexts = [digest(part[a:b + length]) for a, b in zip(first.tolist(), last.tolist())]
        yield h, np.array(contexts, dtype=np.uint64), first + base, last - first


ANCHORS = "key LONG, ctx LONG, t1 LONG, t2 LONG, start LONG, more INT"


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """All anchors of ``(t1, t2, text)``."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                found = [(k, *x) for k, text in enumerate(part.column("text").to_pylist())
                         for x in anchors(text.encode(), length)]
                if not found:
                    continue
                own, h, ctx, start, more = zip(*found)
                row = np.repeat(own, [len(x) for x in h])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(ctx).view(np.int64)),
                     part.column("t1").take(pa.array(row)), part.column("t2").take(pa.array(row)),
                     pa.array(np.concatenate(start)), pa.array(np.concatenate(more).astype(np.int32))],
                    ["key", "ctx", "t1", "t2", "start", "more"])

    return texts.mapInArrow(run, ANCHORS)


# ---------------------------------------------------------- deep-shallow sorting
class Suffixes:
    """Suffixes of joined contexts, each compared on ``length`` bytes."""

    def __init__(self, raw: bytes, starts: np.ndarray, length: int):
        padded = raw + bytes(8)
        self.words = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))     # sorts as the bytes do
        self.starts, self.length = starts, length
        self.depth = -(-length // 8)

    def word(self, items: np.ndarray, d: int | np.ndarray) -> np.ndarray:
        """The d-th 8-byte word of each item; bytes beyond ``length`` are 0."""
        w = self.words[self.starts[items] + 8 * d].astype(np.uint64)
        over = 8 * (d + 1) - self.length
        return np.where(over > 0, w >> np.uint64(8) * np.maximum(over, 0).astype(np.uint64)
                        if isinstance(over, np.ndarray) else (w >> np.uint64(8 * max(over, 0))), w)

    def shallow(self) -> tuple[np.ndarray, np.ndarray]:
        """Multikey quicksort by words, all groups of a depth together: items
        still tied at the shallow depth, and the number of their group."""
        items, group = np.arange(len(self.starts)), np.zeros(len(self.starts), dtype=np.int64)
        for d in range(min(SHALLOW, self.depth)):
            if not len(items):
                break
            items, group = self._split(items, group, self.word(items, d))
        return items, group

    @staticmethod
    def _split(items, group, *keys) -> tuple[np.ndarray, np.ndarray]:
        """Sorts the items of each group by the keys; those alone are done."""
        order = np.lexsort((*keys[::-1], group))
        items, group = items[order], group[order]
        new = np.ones(len(items), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        number = np.cumsum(new) - 1
        tied = np.bincount(number)[number] > 1
        return items[tied], number[tied]

    def repeats(self) -> np.ndarray:
        """Which suffixes share all ``length`` bytes with another."""
        out = np.zeros(len(self.starts), dtype=bool)
        items, group = self.shallow()
        while len(items):
            # Blind tries of all groups at once.  The first item of a group is
            # its trie's spine; every other one leaves it at the first word
            # where they differ, and those that leave at the same word of the
            # same depth form the trie below.  Those that never leave it equal.
            lead = np.ones(len(items), dtype=bool)
            lead[1:] = group[1:] != group[:-1]
            spine = items[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            left_at = np.full(len(items), self.depth)
            word = np.zeros(len(items), dtype=np.uint64)
            going = np.flatnonzero(~lead)
            for d in range(SHALLOW, self.depth):
                if not len(going):
                    break
                w = self.word(items[going], d)
                off = w != self.word(spine[going], d)
                left_at[going[off]], word[going[off]] = d, w[off]
                going = going[~off]
            same = ~lead & (left_at == self.depth)
            out[items[same]] = True
            out[spine[same]] = True
            rest = ~lead & ~same
            items, group = self._split(items[rest], group[rest], left_at[rest], word[rest])
        return out


def merged(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Sorted windows as ranges that neither overlap nor touch."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate(([0], gap + 1))].tolist(),
                    (starts[np.concatenate((gap, [len(starts) - 1]))] + length).tolist()))


COVERED = "key LONG, ctx LONG, spans ARRAY<STRUCT<a: INT, b: INT>>"


def sort_contexts(contexts: DataFrame, length: int, buckets: int) -> DataFrame:
    """``(key, ctx, bytes)`` -> the ranges of each context that repeated
    windows cover.  Windows are compared with those of contexts of the same
    key; a bucket sorts those of many keys at once."""
    def run(bucket, rows):
        raw = rows.column("bytes").to_pylist()
        key = rows.column("key").to_numpy()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        windows = sizes - length + 1
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(raw)), windows)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = Suffixes(b"".join(raw), first[owner] + offset, length).repeats()
        ends = np.searchsorted(owner[hit], np.arange(len(raw) + 1))
        spans = [merged(offset[hit][a:b], length) for a, b in zip(ends[:-1], ends[1:])]
        some = [i for i, s in enumerate(spans) if s]
        return pa.table({"key": pa.array(key[some]), "ctx": rows.column("ctx").take(pa.array(some, pa.int64())),
                         "spans": pa.array([[{"a": a, "b": b} for a, b in spans[i]] for i in some],
                                           pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))})

    bucket = F.pmod("key", F.lit(buckets)).alias("bucket")
    return contexts.select(bucket, "key", "ctx", "bytes").groupBy("bucket").applyInArrow(run, COVERED)


def match_crowded(contexts: DataFrame, length: int, work: Scratch) -> DataFrame:
    """The same for keys with more contexts than one task should hold: digests
    of all windows are counted in a shuffle."""
    def windows(batches):
        for b in batches:
            for key, ctx, raw in zip(*(b.column(c).to_pylist() for c in ("key", "ctx", "bytes"))):
                n = len(raw) - length + 1
                d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i:i + length]) for i in range(n)]), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n), pa.array([ctx] * n), pa.array(np.arange(n, dtype=np.int32)),
                     pa.array(d[::2]), pa.array(d[1::2])], ["key", "ctx", "i", "h1", "h2"])

    w = contexts.select("key", "ctx", "bytes").mapInArrow(windows, "key LONG, ctx LONG, i INT, h1 LONG, h2 LONG")
    often = work.put(w.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "windows")
    hit = w.join(often, ["h1", "h2"]).groupBy("key", "ctx").agg(F.sort_array(F.collect_set("i")).alias("at"))

    def ranges(batches):
        for b in batches:
            spans = [[{"a": x, "b": y} for x, y in merged(np.array(at), length)] for at in b.column("at").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("ctx"),
                 pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["key", "ctx", "spans"])

    return hit.mapInArrow(ranges, COVERED)


# ----------------------------------------------------------------------- spans
def _named(docs: DataFrame) -> DataFrame:
    """Two independent 64-bit hashes name a text."""
    return docs.withColumn("t1", F.xxhash64(whole_text())).withColumn("t2", F.xxhash64(F.lit(1), whole_text()))


#: Rows that a Python function looks at together.
ROWS = 256


def _squeezed(df: DataFrame) -> DataFrame:
    """``text`` as compressed bytes, for shuffles (null stays null)."""
    schema = StructType([StructField(f.name, BinaryType()) if f.name == "text" else f for f in df.schema.fields])

    def run(batches):
        for b in slices(batches):
            raw = [None if t is None else zlib.compress(t.encode(), 1) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(raw, pa.binary()) if n == "text" else b.column(n) for n in schema.names], schema.names)

    return df.mapInArrow(run, schema)


def slices(batches, rows: int = ROWS):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _contexts(squeezed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of ``wanted`` contexts ``(key, ctx, rep)``, each read once from
    one copy of its text."""
    one = Window.partitionBy("t1", "t2").orderBy(F.lit(1))
    texts = squeezed.select("t1", "t2", "text", F.row_number().over(one).alias("r")).where("r = 1").drop("r")
    places = wanted.select("rep.t1", "rep.t2", F.struct("key", "ctx", "crowded", "rep.start", "rep.more").alias("x"))
    places = places.groupBy("t1", "t2").agg(F.collect_list("x").alias("xs"))     # at most a text's anchors

    def run(batches):
        for b in slices(batches):
            texts_, found = b.column("text"), b.column("xs").flatten()
            owner = np.repeat(np.arange(b.num_rows), np.array(b.column("xs").value_lengths()))
            start, more = found.field("start").to_pylist(), found.field("more").to_pylist()
            out, last, raw = [], -1, b""
            for i, at, n in zip(owner.tolist(), start, more):
                if i != last:
                    last, raw = i, zlib.decompress(texts_[i].as_py())
                out.append(raw[at:at + n + length])
            yield pa.RecordBatch.from_arrays(
                [found.field("key"), found.field("ctx"), found.field("crowded"), pa.array(out, pa.binary())],
                ["key", "ctx", "crowded", "bytes"])

    return texts.join(places, ["t1", "t2"]).select("text", "xs").mapInArrow(
        run, "key LONG, ctx LONG, crowded BOOLEAN, bytes BINARY")


def text_spans(docs: DataFrame, work: Scratch, length: int = LENGTH, crowd: int = 4096) -> DataFrame:
    """``(t1, t2, spans)``: what repeated strings cover in each different text,
    as ranges of bytes that may overlap.  Texts without any are left out."""
    named = _named(docs.select("text")).where(F.octet_length("text") >= length)
    rows = anchor_rows(named, length)
    # a table of its own: both sides of the join are then shuffles that Spark can
    # split where a key is hot
    often = work.put(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "often")
    met = work.put(rows.join(often, "key"), "met")
    place = F.struct("t1", "t2", "start", "more")
    contexts = met.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("rep"))
    contexts = work.put(contexts, "contexts")
    kinds = work.put(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    contexts = contexts.join(kinds, "key")
    full = contexts.where("n > 1").select(
        "key", "ctx", F.array(F.struct(F.lit(0).alias("a"), (F.col("rep.more") + length).alias("b"))).alias("spans"))
    wanted = contexts.where("kinds > 1").withColumn("crowded", F.col("kinds") > crowd)
    fetched = work.put(_contexts(_squeezed(named), wanted, length), "fetched")
    sizes = fetched.agg(F.count(F.lit(1))).first()[0]
    sorted_ = sort_contexts(fetched.where("NOT crowded"), length, blocks_for(sizes, 2048))
    covered = sorted_.unionByName(match_crowded(fetched.where("crowded"), length, work)).unionByName(full)
    # a context that occurs several times is covered whole; joined once more,
    # that range takes in the sorted ones
    hit = met.join(covered, ["key", "ctx"]).select("t1", "t2", "start", F.explode("spans").alias("s"))
    return hit.groupBy("t1", "t2").agg(F.collect_set(F.struct(
        (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))).alias("spans"))


def _joined(docs: DataFrame, length: int, crowd: int) -> DataFrame:
    """``docs`` with compressed ``text`` and ``_suffix_dedup_spans``, which may
    overlap."""
    work = scratch(docs.sparkSession, "suffix-dedup")
    found = text_spans(docs, work, length, crowd)
    hidden = ["_suffix_dedup_t1", "_suffix_dedup_t2"]
    named = docs.withColumn(hidden[0], F.xxhash64(whole_text())).withColumn(hidden[1], F.xxhash64(F.lit(1), whole_text()))
    found = found.select(F.col("t1").alias(hidden[0]), F.col("t2").alias(hidden[1]), F.col("spans").alias(SPANS))
    return _squeezed(named).join(found, hidden, "left").drop(*hidden)


SPANS = "_suffix_dedup_spans"


def _apart(spans: list[dict] | None) -> list[dict]:
    out: list[dict] = []
    for x in sorted(spans or [], key=lambda x: x["a"]):
        if out and x["a"] <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], x["b"])
        else:
            out.append(x)
    return out


def each_text(joined: DataFrame, schema: StructType, columns) -> DataFrame:
    """``columns(raw, spans, batch)`` gives the columns that ``schema`` has
    beside those of ``joined``, from the bytes (None: null) and spans of the
    texts of a batch."""
    def run(batches):
        for b in slices(batches):
            raw = [None if t is None else zlib.decompress(t) for t in b.column("text").to_pylist()]
            made = columns(raw, [_apart(x) for x in b.column(SPANS).to_pylist()], b)
            yield pa.RecordBatch.from_arrays([made[n] if n in made else b.column(n) for n in schema.names], schema.names)

    return joined.mapInArrow(run, schema)


def repeats(docs: DataFrame, length: int = LENGTH, crowd: int = 4096) -> DataFrame:
    """All columns of ``docs`` with ``spans ARRAY<STRUCT<a, b>>``, the byte
    ranges of ``text`` (UTF-8) that repeated strings of ``length`` bytes cover,
    sorted and apart.  Matches do not cross documents; a string may repeat
    within one.  A column named ``spans`` is replaced.

    Null, empty and short texts have no spans; all of a text of at least
    ``length`` bytes that occurs twice is covered.  Null ids and repeated rows
    are documents like others; an empty table gives an empty result.
    """
    docs = docs.drop("spans")
    span = StructType([StructField("a", LongType()), StructField("b", LongType())])
    schema = StructType([*docs.schema.fields, StructField("spans", ArrayType(span))])
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def columns(raw, spans, _):
        return {"text": pa.array([None if r is None else r.decode() for r in raw], pa.string()),
                "spans": pa.array(spans, kind)}

    return each_text(_joined(docs, length, crowd), schema, columns)


def kept_bytes(raw: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(raw[at:s["a"]])
        at = s["b"]
    out.append(raw[at:])
    return b"".join(out)


def whole_characters(raw: bytes, spans: list[dict]) -> list[dict]:
    """Spans drawn in to characters that they cover whole."""
    out = []
    for s in spans:
        a, b = s["a"], s["b"]
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append({"a": a, "b": b})
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = 4096) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (whole characters
    only) and ``n_chars``, if there is one, counted anew.  Cases as for
    ``repeats``; a text of which nothing is left is empty."""
    schema = docs.schema

    def columns(raw, spans, b):
        texts = [None if r is None else kept_bytes(r, whole_characters(r, s)).decode() for r, s in zip(raw, spans)]
        made = {"text": pa.array(texts, pa.string())}
        if "n_chars" in schema.names:
            old = b.column("n_chars")
            made["n_chars"] = pa.array([n if not s else len(t) for n, s, t in zip(old.to_pylist(), spans, texts)], old.type)
        return made

    return each_text(_joined(docs, length, crowd), schema, columns)


def op7_suffix_array_dedup(spark, sf_dir):
    """What repeated 200-byte strings leave of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def columns(raw, spans, _):
        raw = [r or b"" for r in raw]
        sha = [hashlib.sha256(kept_bytes(r, s)).hexdigest() for r, s in zip(raw, spans)]
        return {"n_bytes": pa.array([len(r) for r in raw], pa.int64()),
                "n_removed": pa.array([sum(x["b"] - x["a"] for x in s) for s in spans], pa.int64()),
                "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept_sha256": pa.array(sha, pa.string())}

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType),
                         *[StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
                         StructField("kept_sha256", StringType())])
    return each_text(_joined(docs, LENGTH, 4096), schema, columns)
