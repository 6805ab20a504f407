"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut at spaces into words of one or a few pre-tokens.  A batch of
documents keeps, for each text, the sequence of its words as ranks in the
batch's list of distinct words: the positions.  The distinct words alone are
shuffled by hash, each is encoded once, pre-token by pre-token, however many
batches hold it, and its ids go back to those batches, where the sequences are
put together again by position.  Words of one batch and one hash bucket travel
as one compressed row, so a word that fills a third of all texts is one entry
per batch.

Decoding joins ids with the table of token bytes, whose size the vocabulary
bounds.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_for, table, whole_text

#: A space amid white space, before which a text can't be cut on its own.
UNSAFE = re.compile(r"\s (?=\s|\Z)")
BATCH_ROWS, BATCH_CHARS = 1000, 4_000_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks.  The file
    lies with the installed package, on the driver too."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# ----------------------------------------------------------------------- words
class Splitter:
    """Texts as indices of distinct words: stretches that start at a space.

    A single space starts a new pre-token unless it stands amid white space, so
    the pre-tokens of a text are those of its words, one after another.  A text
    with such a space is cut into its pre-tokens instead."""

    def __init__(self, pattern: str):
        import regex
        self.find = regex.compile(pattern).findall
        #: a key in a tuple stands for itself, any other for itself behind a space
        self.index: dict[str | tuple[str], int] = {}

    def split(self, text: str) -> list[int]:
        index = self.index
        if UNSAFE.search(text):
            return [index.setdefault((w,), len(index)) for w in self.find(text)]
        first, *rest = text.split(" ")
        out = [index.setdefault((first,), len(index))] if first else []
        out += [index.setdefault(w, len(index)) for w in rest]
        return out

    def words(self) -> list[bytes]:
        return [(k[0] if isinstance(k, tuple) else " " + k).encode() for k in self.index]


def _pack(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, one byte plane after another, entropy coded."""
    planes = a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    z = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_HUFFMAN_ONLY)
    return z.compress(planes) + z.flush()


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_list(items: list[bytes]) -> tuple[bytes, bytes]:
    return _pack(np.fromiter(map(len, items), np.uint32, len(items))), zlib.compress(b"".join(items), 1)


def _unpack_list(lengths: bytes, joined: bytes) -> list[bytes]:
    ends = np.cumsum(_unpack(lengths)).tolist()
    raw = zlib.decompress(joined)
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


#: Of each batch, one row for its documents: their ids, how many words each has
#: (``lengths``), all words as frequency ranks (``body``), and where a rank's
#: word stands among the batch's words by bucket (``places``).  One row for each
#: of its buckets holds words (``lengths``, ``body``).  ``sign`` is a checksum of
#: the batch's words in that order.
SPLIT = "batch LONG, sign LONG, bucket INT, doc_ids ARRAY<LONG>, places BINARY, lengths BINARY, body BINARY"


def split_words(docs: DataFrame, pattern: str, buckets: int, of_documents: bool) -> DataFrame:
    """The documents' rows of every batch, or its buckets' rows.  Batches
    follow from the order of a task's rows, which the files fix."""
    def run(batches):
        task, number = TaskContext.get().partitionId() << 32, 0
        schema = pa.schema([("batch", pa.int64()), ("sign", pa.int64()), ("bucket", pa.int32()),
                            ("doc_ids", pa.list_(pa.int64())), ("places", pa.binary()), ("lengths", pa.binary()),
                            ("body", pa.binary())])

        def rows(ids, sequences, raw):
            nonlocal number
            batch = task | number
            number += 1
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            by_bucket = np.argsort(bucket, kind="stable")
            ordered = [raw[i] for i in by_bucket.tolist()]
            sign = zlib.crc32(b"\0".join(ordered))
            if of_documents:
                n = np.fromiter(map(len, sequences), np.int64, len(sequences))
                flat = np.fromiter(chain.from_iterable(sequences), np.int64, n.sum())
                by_count = np.argsort(-np.bincount(flat, minlength=len(raw)), kind="stable")
                rank, place = np.empty((2, len(raw)), dtype=np.int64)
                rank[by_count] = place[by_bucket] = np.arange(len(raw))
                yield {"batch": batch, "sign": sign, "doc_ids": ids, "places": _pack(place[by_count]),
                       "lengths": _pack(n), "body": _pack(rank[flat])}
                return
            bounds = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1, append=-1)).tolist()
            for a, b in zip(bounds[:-1], bounds[1:]):
                lengths, body = _pack_list(ordered[a:b])
                yield {"batch": batch, "sign": sign, "bucket": int(bucket[by_bucket[a]]), "lengths": lengths, "body": body}

        def closed(ids, sequences, splitter):
            return pa.RecordBatch.from_pylist(list(rows(ids, sequences, splitter.words())), schema=schema)

        ids, sequences, chars, splitter = [], [], 0, Splitter(pattern)
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if len(ids) >= BATCH_ROWS or (ids and chars + len(text) > BATCH_CHARS):
                    yield closed(ids, sequences, splitter)
                    ids, sequences, chars, splitter = [], [], 0, Splitter(pattern)
                ids.append(doc)
                sequences.append(splitter.split(text))
                chars += len(text)
        if ids:
            yield closed(ids, sequences, splitter)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(run, SPLIT)


# -------------------------------------------------------------------- encoding
#: The encoder of this process, by the run that it was built for.
_BUILT: dict[str, object] = {}


def _encoder(run: str, vocabulary, pattern: str):
    """The encoder of a broadcast vocabulary, built once in a worker process."""
    if run not in _BUILT:
        import tiktoken
        _BUILT.clear()
        _BUILT[run] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=vocabulary.value, special_tokens={})
    return _BUILT[run]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``(doc_id, ids ARRAY<INT>)`` of every whole text; each match of
    ``pattern`` is encoded on its own, without special tokens.  ``docs`` is
    read twice and must give its rows in the same order, as files do; write a
    result whose order may change to a table first.

    Null or empty text: no ids.  Null doc_ids and repeated rows are encoded
    like others; other columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(ranks)     # as large as the vocabulary
    buckets, name = blocks_for(docs.count(), 1024), uuid.uuid4().hex

    def once(key, rows):
        """All batches' words of one bucket: ids of each row's words."""
        bpe = _encoder(name, vocabulary, pattern)
        known: dict[bytes, bytes] = {}
        out = []
        for lengths, body in zip(rows.column("lengths").to_pylist(), rows.column("body").to_pylist()):
            words = _unpack_list(lengths, body)
            for w in words:
                if w not in known:
                    known[w] = np.array(bpe.encode_ordinary(w.decode()), dtype="<u4").tobytes()
            coded = [known[w] for w in words]
            ids = np.frombuffer(b"".join(coded), dtype="<u4")
            out.append((_pack(np.fromiter(map(len, coded), np.int64, len(coded)) // 4), _pack(ids)))
        return pa.table({"batch": rows.column("batch"), "sign": rows.column("sign"), "bucket": rows.column("bucket"),
                         "lengths": pa.array([x for x, _ in out], pa.binary()),
                         "body": pa.array([x for _, x in out], pa.binary())})

    coded = (split_words(docs, pattern, buckets, False).select("batch", "sign", "bucket", "lengths", "body")
             .groupBy("bucket").applyInArrow(once, "batch LONG, sign LONG, bucket INT, lengths BINARY, body BINARY"))

    def joined(key, left, right):
        """A batch's documents and its words' ids, in the order of buckets."""
        order = np.argsort(right.column("bucket").to_numpy(), kind="stable")
        lengths, bodies = right.column("lengths").to_pylist(), right.column("body").to_pylist()
        empty = [np.zeros(0, dtype="<u4")]
        n = np.concatenate([_unpack(lengths[i]) for i in order] or empty).astype(np.int64)
        ids = np.concatenate([_unpack(bodies[i]) for i in order] or empty)
        docs_, out = [], []
        signs = set(right.column("sign").to_pylist())
        for r in left.to_pylist():
            if signs - {r["sign"]}:
                raise ValueError("the documents came in another order when they were read again")
            place = _unpack(r["places"]).astype(np.int64)
            count = n[place]                                 # ids of each rank's word
            first = (np.cumsum(n) - n)[place]                # where they start
            ranks_, per_doc = _unpack(r["body"]), _unpack(r["lengths"]).astype(np.int64)
            size = count[ranks_]
            ends = np.cumsum(size)
            flat = ids[np.repeat(first[ranks_] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_doc)))]
            out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32))))
            docs_ += r["doc_ids"]
        return pa.table({"doc_id": pa.array(docs_, pa.int64()),
                         "ids": pa.chunked_array(out, pa.list_(pa.int32()))})

    return (split_words(docs, pattern, buckets, True).drop("bucket").groupBy("batch")
            .cogroup(coded.groupBy("batch")).applyInArrow(joined, "doc_id LONG, ids ARRAY<INT>"))


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """All columns with ``bytes``, the decoded ``ids``; null ids decode to
    null, and an id outside the vocabulary raises.  A column named ``bytes`` is
    replaced."""
    from pyspark.sql.types import BinaryType, StructField, StructType
    own = [f for f in coded.schema.fields if f.name != "bytes"]
    schema = StructType([*own, StructField("bytes", BinaryType())])
    token_bytes = coded.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})

    def run(batches):
        by_id = token_bytes.value
        tokens = pa.array([by_id.get(i) for i in range(max(by_id, default=-1) + 1)], pa.large_binary())
        for b in (whole.slice(i, 128) for whole in batches for i in range(0, whole.num_rows, 128)):
            ids = b.column("ids")
            flat = ids.flatten()
            if len(flat) and (flat.null_count or pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(tokens)):
                raise ValueError("an id lies outside the vocabulary")
            met = tokens.take(flat)
            if met.null_count:
                raise ValueError("an id lies outside the vocabulary")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int64()), met)
            raw = pc.if_else(pc.is_valid(ids), pc.binary_join(lists, pa.scalar(b"", pa.large_binary())),
                             pa.scalar(None, pa.large_binary()))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in own], raw.cast(pa.binary())], schema.names)

    return coded.mapInArrow(run, schema)


def op9_byte_bpe(spark, sf_dir):
    """Ids of all documents, and the bytes that they decode to, as digests."""
    import public_tokenizers
    ranks = read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    decoded = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2("bytes", 256).alias("decoded_sha256"))
