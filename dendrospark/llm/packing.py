"""Vector bin packing of training examples by the dot-product heuristic.

A sequence has three capacities: tokens, segments (pieces of examples) and
loss-bearing tokens.  While a sequence is open, the waiting item whose demand
vector has the largest dot product with the remaining capacities, both in
shares of the whole capacities, goes in, if it fits every one of them (Panigrahy
et al. 2011).  Items are kept by size class, so a step looks at one row of
numbers per class.  When nothing fits and cutting is allowed, the head of the
best waiting item fills the gap; the last sequence of a task is cut into powers
of two, which need no padding.

Each task packs its own documents in windows of bounded size, in one pass and
without a shuffle.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_CACHES, byte_slices, table, whole_text

#: Capacities of a sequence: tokens, segments, loss-bearing tokens.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 256, 4096


class Item(NamedTuple):
    """A piece of an example: tokens ``start`` to ``start + length`` of example
    ``ref``, the last ``loss`` of which bear loss."""
    ref: int
    start: int
    length: int
    loss: int

    def cut(self, n: int) -> tuple[Item, Item]:
        """Head of n tokens and the rest; loss-bearing tokens are the last."""
        tail = min(self.loss, self.length - n)
        return (Item(self.ref, self.start, n, self.loss - tail),
                Item(self.ref, self.start + n, self.length - n, tail))


class Packer:
    """Packs the items of one window after another into sequences.

    Waiting items lie in classes of like length (16 for each doubling) and like
    share of loss (4), each a queue; a class stands for its items by the vector
    of its first one.  A sequence is emitted as a list of items.
    """

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS,
                 cut: bool = True):
        if min(tokens, segments, loss) < 1:
            raise ValueError("capacities must be positive")
        self.caps = np.array([tokens, segments, loss], dtype=np.int64)
        self.cut = cut
        self.n_classes = 64 * (int(np.log2(tokens)) + 2)
        self.queues: list[deque[Item]] = [deque() for _ in range(self.n_classes)]
        #: demand of the first item of each class; a class without one never fits
        self.first = np.full((self.n_classes, 3), np.iinfo(np.int64).max // 2, dtype=np.int64)
        self.waiting = self.tokens = 0

    def _class(self, x: Item) -> int:
        if x.length == 0:
            return 0
        size = int(16 * np.log2(x.length))
        return min(self.n_classes - 1, 4 * size + min(3, 4 * x.loss // x.length))

    def add(self, x: Item) -> list[list[Item]]:
        """Takes an item; whole sequences cut off a longer one are returned."""
        full = []
        limit = int(min(self.caps[0], self.caps[2]))
        while x.length > self.caps[0] or x.loss > self.caps[2]:
            if not self.cut:
                raise ValueError(f"an example of {x.length} tokens, {x.loss} with loss, fits no sequence")
            head, x = x.cut(min(limit, x.length - 1))
            full.append([head])
        c = self._class(x)
        self.queues[c].append(x)
        if len(self.queues[c]) == 1:
            self.first[c] = (x.length, 1, x.loss)
        self.waiting += 1
        self.tokens += x.length
        return full

    def _pop(self, c: int) -> Item:
        x = self.queues[c].popleft()
        if self.queues[c]:
            y = self.queues[c][0]
            self.first[c] = (y.length, 1, y.loss)
        else:
            self.first[c] = np.iinfo(np.int64).max // 2
        self.waiting -= 1
        self.tokens -= x.length
        return x

    def sequence(self) -> list[Item]:
        """Fills one sequence from what waits."""
        left, out = self.caps.copy(), []
        while self.waiting:
            fits = np.flatnonzero((self.first <= left).all(axis=1))
            if len(fits):
                demand = self.first[fits] / self.caps
                best = int(fits[np.argmax(demand @ (left / self.caps))])
                x = self._pop(best)
            else:
                if not self.cut or left.min() == 0:
                    break
                # the longest waiting item gives its head
                best = int(np.argmax(np.where(self.first[:, 0] <= self.caps[0], self.first[:, 0], -1)))
                if self.first[best, 0] <= 1:
                    break
                x = self._pop(best)
                n = int(min(left[0], x.length - 1))
                if x.cut(n)[0].loss > left[2]:
                    n -= x.cut(n)[0].loss - int(left[2])
                if n < 1:
                    self.add(x)
                    break
                x, rest = x.cut(n)
                self.add(rest)
            out.append(x)
            left -= (x.length, 1, x.loss)
        total = int(self.caps[0] - left[0])
        if self.cut and self.waiting and total & (total - 1):
            # closed by another limit than tokens: a power of two is not padded
            excess = total - (1 << total.bit_length() - 1) if total < self.caps[0] else 0
            while excess:
                x = out.pop()
                if x.length > excess:
                    head, x = x.cut(x.length - excess)
                    out.append(head)
                excess -= x.length
                self.add(x)
        return out

    def last(self) -> Iterator[list[Item]]:
        """What waits at the end.  A part-filled sequence is cut at powers of
        two, which are not padded."""
        while self.waiting:
            seq = self.sequence()
            total = sum(x.length for x in seq)
            if not self.cut or total == self.caps[0] or total & (total - 1) == 0:
                yield seq
                continue
            size = 1 << (total.bit_length() - 1)
            part: list[Item] = []
            for x in seq:
                while x.length:
                    n = min(size, x.length)
                    head, x = x.cut(n) if n < x.length else (x, x._replace(length=0))
                    part.append(head)
                    size -= n
                    total -= n
                    if not size:
                        yield part
                        part, size = [], 1 << max(0, total.bit_length() - 1)


# ------------------------------------------------------------------ token ids
#: Letters of the Latin blocks whose lower case is one letter, then ASCII signs
#: but the apostrophe, which may begin a contraction.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE files write for each byte: printable
    bytes for themselves, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of a ``tokenizers`` file whose normaliser drops white space: texts
    are split at ASCII white space, and each distinct word is encoded once.

    If the file lower-cases, splits letters from signs and maps bytes to
    letters, a Latin word and the signs behind it are looked up separately, the
    word straight in the BPE model.  Any other word goes through the whole
    tokenizer.  At most ``keep`` words, and as many parts of words, are kept in mind,
    in two halves: when the newer half is full, words that it has not met are
    forgotten.  ``spec`` is the text of the tokenizer file, ``plain`` whether it
    does so (read from it if not given)."""

    def __init__(self, spec: str, end: int, keep: int = 1 << 18, plain: bool | None = None):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.end = np.array([end], dtype="<u4").tobytes()
        self.keep = keep
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.older_parts: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.plain = self.splits_plain_words(json.loads(spec)) if plain is None else plain

    @staticmethod
    def splits_plain_words(spec: dict) -> bool:
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        return ([x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
                and [x["type"] for x in pre] == ["Split", "ByteLevel"] and not pre[1]["add_prefix_space"]
                and pre[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
                and spec["model"]["type"] == "BPE")

    def _whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _core(self, core: str, spelt: str) -> bytes:
        """Ids of a lower-case word, spelt in byte letters, straight from the model."""
        got = self.older_parts.get(core)
        if got is None:
            ids = [t.id for t in self.model.tokenize(spelt)]
            got = struct.pack(f"<{len(ids)}I", *ids)
        self.parts[core] = got
        return got

    def _word(self, coded: bytes) -> bytes:
        if self.plain and coded.isalpha():          # ASCII letters alone
            core = coded.lower().decode()
            a = self.parts.get(core)
            return self._core(core, core) if a is None else a
        word = coded.decode()
        plain = PLAIN.fullmatch(word) if self.plain else None
        if plain is None:
            return self._whole(word)
        core, signs = plain[1].lower(), plain[2]
        a, b = self.parts.get(core), self.parts.get(signs)
        if a is None:
            a = self._core(core, core if core.isascii() else "".join([self.letters[c] for c in core.encode()]))
        if b is None:
            b = self.older_parts.get(signs)
            b = self.parts[signs] = self._whole(signs) if b is None else b
        return a + b

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id."""
        out, known, older = [], self.known, self.older
        for t in texts:
            words = t.encode().split()
            for w in set(words).difference(known):
                ids = older.get(w)
                known[w] = self._word(w) if ids is None else ids
            out.append(b"".join([known[w] for w in words]) + self.end)
            if 2 * len(known) > self.keep:
                self.older, self.known = older, known = known, {}
            if 2 * len(self.parts) > self.keep:
                self.older_parts, self.parts = self.parts, {"": b""}
        return out


@lru_cache(maxsize=1)
def _encoder(spec: str, end: int, plain: bool) -> WordEncoder:
    """The encoder of a worker process, which serves one task after another."""
    return WordEncoder(spec, end, plain=plain)


WORKER_CACHES.append(_encoder)

PIECES = ("doc_id LONG, start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG, sequence_id LONG, "
          "offset LONG, loss_tokens LONG")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, tokens: int = MAX_TOKENS,
                   segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, window: int = 4096,
                   window_tokens: int = 1 << 21) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, loss_tokens``.

    A document's ids are those of the tokenizer file without special tokens,
    then ``end``.  All ids of a plain document bear loss but the first, which
    nothing precedes.  A task packs windows of ``window`` pieces or
    ``window_tokens`` tokens; what a window leaves unfilled waits for the next.
    A sequence that the segment or loss limit closes, and the last ones, end at
    powers of two, which are not padded.  The driver reads the tokenizer file
    and broadcasts it.  ``sequence_id`` is the task's
    partition in the high and a counter in the low 32 bits.

    Null or empty text: the end id alone.  Null doc_ids and repeated rows are
    packed like others; other columns are ignored; an empty table gives none.
    """
    with open(tokenizer, encoding="utf-8") as file:
        text = file.read()
    plain = WordEncoder.splits_plain_words(json.loads(text))
    spec = docs.sparkSession.sparkContext.broadcast(text)          # a vocabulary file

    def run(batches):
        pa.default_memory_pool().release_unused()                  # what earlier work in this process left
        encoder, packer = _encoder(spec.value, end, plain), Packer(tokens, segments, loss)
        task = TaskContext.get().partitionId() << 32
        kept: dict[int, tuple] = {}        # documents with ids still waiting: (doc_id, ids, ids left)
        number = count = 0

        def rows(sequences):
            nonlocal count
            out = []
            for seq in sequences:
                at = 0
                for x in seq:
                    doc, ids, left = kept[x.ref]
                    crc = zlib.crc32(memoryview(ids)[4 * x.start:4 * (x.start + x.length)])
                    out.append((doc, x.start, x.length, crc, len(ids) // 4, task | count, at, x.loss))
                    at += x.length
                    if left == x.length:
                        del kept[x.ref]
                    else:
                        kept[x.ref] = (doc, ids, left - x.length)
                count += 1
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 8)],
                [f.split()[0] for f in PIECES.split(", ")])

        for b in batches:
            for part in (s.slice(i, 256) for s in byte_slices(b, "text", 1 << 20) for i in range(0, s.num_rows, 256)):
                ids_of = encoder.encode(part.column("text").to_pylist())
                ready = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), ids_of):
                    n = len(ids) // 4
                    kept[number] = (doc, ids, n)
                    ready += packer.add(Item(number, 0, n, n - 1))
                    number += 1
                while packer.waiting > window or packer.tokens > window_tokens:
                    ready.append(packer.sequence())
                yield rows(ready)
        yield rows(packer.last())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS,
                  loss: int = MAX_LOSS, window: int = 4096) -> DataFrame:
    """Instruction data: whole examples ``(example_id, n_tokens, n_loss)`` in
    sequences that keep all three limits -> ``example_id, n_tokens, n_loss,
    sequence_id, slot, offset``.

    Null counts are 0; loss-bearing tokens beyond ``n_tokens`` are an error,
    and so is an example that fits no sequence.  Null ids and repeated rows are
    packed like others; an empty table gives none.
    """
    names = ["example_id", "n_tokens", "n_loss", "sequence_id", "slot", "offset"]

    def run(batches):
        packer = Packer(tokens, segments, loss, cut=False)
        task, count, kept = TaskContext.get().partitionId() << 32, 0, {}

        def rows(sequences):
            nonlocal count
            out = []
            for seq in sequences:
                at = 0
                for slot, x in enumerate(seq):
                    out.append((kept.pop(x.ref), x.length, x.loss, task | count, slot, at))
                    at += x.length
                count += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 6)], names)

        number = 0
        for b in batches:
            for ref, n, m in zip(*(b.column(c).to_pylist() for c in names[:3])):
                if m > n:
                    raise ValueError(f"example {ref}: {m} of {n} tokens bear loss")
                kept[number] = ref
                packer.add(Item(number, 0, n, m))
                number += 1
                if packer.waiting > window:
                    yield rows([packer.sequence()])
        yield rows(packer.last())

    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in names[1:3]]
    return examples.select(F.col("example_id").cast("long").alias("example_id"), *counts).mapInArrow(
        run, ", ".join(f"{n} LONG" for n in names))


def op3_packing(spark, sf_dir):
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
