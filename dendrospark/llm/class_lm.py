"""Brown class-based bigram language model.

Exchange clustering moves words between a fixed number of classes while the
likelihood of the class bigrams grows; then

    p(w | v) = (c(w) + a) * (share * t(class v, class w) / D(class w) + (1 - share) / D)

with smoothed class transitions t, and D the smoothed mass of a class or of all
words: emission within the class, mixed with the plain word frequency.  The
factor c(w) + a is the same in both, so a text's score is a sum over its words'
counts plus a sum over its class bigrams.

Word counts come from all training texts.  The exchange on the driver moves
*units*: each of the most frequent words by itself, and the other words by their
last bytes.  Every other word then gets the class of its own that the same gain
finds best, from its neighbours' counts in a shuffle; the endings' classes are
left to words that training never saw.  Counts and classes of the common words
go to the tasks in a table of bounded size; those of all others are joined in a
shuffle, where no key is frequent.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import byte_slices, fold, scratch, table, whole_text

#: The end of a text, a token that no word equals.
END = b"\n"
SUFFIX = 4
#: Smoothing added to each count.
ADD = 0.1


def tokens(text: str) -> list[bytes]:
    out = text.encode().lower().split()      # bytes: ASCII case, ASCII space
    out.append(END)
    return out


def count_words(docs: DataFrame, keep: int = 1 << 19) -> DataFrame:
    """``(word BINARY, n LONG)`` over all texts.  A task adds up at most
    ``keep`` words at a time."""
    def run(batches):
        found: Counter[bytes] = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()))],
                                             ["word", "n"])
            found.clear()
            return out

        for b in batches:
            for text in b.column("text").to_pylist():
                found.update(tokens(text))
                if len(found) > keep:
                    yield flushed()
        if found:
            yield flushed()

    return docs.select(whole_text().alias("text")).mapInArrow(run, "word BINARY, n LONG").groupBy("word").agg(
        F.sum("n").alias("n"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The smallest count, out of eight steps to each doubling, that at most
    ``most`` words reach."""
    step = F.floor(F.log2("n") * 8).cast("int")
    rows = {r["s"]: r["types"] for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("types")).collect()}
    total, least = 0, max(rows, default=0) + 1
    for s in sorted(rows, reverse=True):
        total += rows[s]
        if total > most:
            break
        least = s
    return int(np.ceil(2 ** (least / 8) - 1e-9))


class Vocabulary(NamedTuple):
    """Common words by count, most frequent first, of which the first
    ``n_units`` are units of their own; then suffix units, then the rest."""
    words: list[bytes]
    counts: np.ndarray
    n_units: int
    suffixes: list[bytes]
    unit_counts: np.ndarray      # tokens of each unit
    unit_types: np.ndarray       # different words of each unit
    n: int                       # training tokens
    v: int                       # different training tokens

    @property
    def units(self) -> int:
        return self.n_units + len(self.suffixes) + 1


class Encoder:
    """Words to unit and to place in the table of common words (-1: none)."""

    def __init__(self, v: Vocabulary):
        self.place = {w: i for i, w in enumerate(v.words)}
        self.suffix = {s: v.n_units + i for i, s in enumerate(v.suffixes)}
        self.rest = v.units - 1
        n = v.n_units
        self.unit_of = np.array([i if i < n else self.unit(w) for i, w in enumerate(v.words)] or [self.rest],
                                dtype=np.int64)

    def unit(self, word: bytes) -> int:
        """Unit of a word that is none of its own."""
        return self.suffix.get(word[-SUFFIX:], self.rest)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        units = self.unit_of[at]
        for i in np.flatnonzero(at < 0).tolist():
            units[i] = self.unit(words[i])
        return at, units


def vocabulary(counts: DataFrame, common: int, units: int, suffixes: int) -> Vocabulary:
    if units + suffixes + 1 > 1 << 16:
        raise ValueError(f"{units} words and {suffixes} endings: a unit's number has 16 bits")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = frequent_from(counts, common)
    rows = sorted(((r["n"], bytes(r["word"])) for r in counts.where(F.col("n") >= least).collect()),
                  key=lambda x: (-x[0], x[1]))
    own = max(least, frequent_from(counts, units))
    n_units = sum(1 for c, _ in rows if c >= own)
    tails = (counts.where(F.col("n") < own).groupBy(F.expr(f"substring(word, -{SUFFIX}, {SUFFIX})").alias("s"))
             .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))
             .orderBy(F.desc("n"), "s").limit(suffixes).collect())
    c = np.array([c for c, _ in rows], dtype=np.int64)
    unit_counts = np.concatenate((c[:n_units], [r["n"] for r in tails], [0])).astype(np.int64)
    unit_types = np.concatenate((np.ones(n_units), [r["types"] for r in tails], [0])).astype(np.int64)
    unit_counts[-1], unit_types[-1] = n - unit_counts.sum(), v - unit_types.sum()
    return Vocabulary([w for _, w in rows], c, n_units, [bytes(r["s"]) for r in tails], unit_counts, unit_types,
                      int(n), int(v))


def end_unit(v: Vocabulary) -> int:
    return v.words.index(END) if END in v.words[:v.n_units] else Encoder(v).unit(END)


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One run of numbers after another, each as bytes."""
    starts = np.concatenate(([0], np.cumsum(lengths))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths),
                                 [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(values.tobytes())])


def numbers(col: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """What binaries() was given."""
    offset = np.dtype(np.int64 if pa.types.is_large_binary(col.type) else np.int32)
    _, starts, data = col.buffers()
    ends = np.frombuffer(starts, offset, len(col) + 1, col.offset * offset.itemsize).astype(np.int64)
    kind = np.dtype(kind)
    return (np.frombuffer(data, kind, (ends[-1] - ends[0]) // kind.itemsize, ends[0]).astype(np.int64),
            np.diff(ends) // kind.itemsize)


def encoded_corpus(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """``(doc_id, held_out, at, units, rare)``: each text cut into tokens once,
    for everything that follows.  ``at``: each token's place among the common
    words, or -1 - k for the text's k-th rare word; ``units``: each token's
    unit; ``rare``: the rare words, each once."""
    held = docs.sparkSession.sparkContext.broadcast(v)
    held_out = F.col("held_out") if "held_out" in docs.columns else F.lit(False)

    def run(batches):
        encoder = Encoder(held.value)
        for batch in batches:
            for b in byte_slices(batch, "text", 1 << 21):
                texts = [tokens(t) for t in b.column("text").to_pylist()]
                n = np.fromiter(map(len, texts), np.int64, len(texts))
                flat = [w for t in texts for w in t]
                at, units = encoder.encode(flat)
                rare: list[dict[bytes, int]] = [{} for _ in texts]
                unknown = np.flatnonzero(at < 0)
                owner = np.searchsorted(np.cumsum(n), unknown, "right")
                at[unknown] = [-1 - rare[o].setdefault(flat[j], len(rare[o]))
                               for o, j in zip(owner.tolist(), unknown.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), binaries(at.astype("<i4"), n),
                     binaries(units.astype("<u2"), n), lists([list(r) for r in rare], pa.binary())],
                    ["doc_id", "held_out", "at", "units", "rare"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                       whole_text().alias("text")).mapInArrow(
        run, "doc_id LONG, held_out BOOLEAN, at BINARY, units BINARY, rare ARRAY<BINARY>")


def rare_words(b: pa.RecordBatch, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which tokens are rare words, and each one's place among all rows' rare
    words, one row's after another."""
    held = pc.list_value_length(b.column("rare")).to_numpy().astype(np.int64)
    unknown = np.flatnonzero(at < 0)
    owner = np.searchsorted(np.cumsum(n), unknown, "right")
    return unknown, (np.cumsum(held) - held)[owner] - 1 - at[unknown], b.column("rare").flatten()


def neighbours(corpus: DataFrame, classes: np.ndarray, n_classes: int, end: int, rows: int = 1024) -> np.ndarray:
    """(unit, 2 * classes): how often each class follows and precedes a unit.
    As many tasks as cores add up, then one row of blocks for each is summed;
    the result's size is set by the units and classes alone."""
    spark = corpus.sparkSession
    held = spark.sparkContext.broadcast(classes)
    units = len(classes)

    def run(batches):
        cls = held.value
        total = np.zeros((2, units * n_classes), dtype=np.int64)
        for batch in batches:
            for b in byte_slices(batch, "units", 1 << 21):
                u = numbers(b.column("units"), "<u2")[0]
                before = np.concatenate(([end], u[:-1]))       # a slice begins with a text
                total[0] += np.bincount(before * n_classes + cls[u], minlength=units * n_classes)
                total[1] += np.bincount(u * n_classes + cls[before], minlength=units * n_classes)
        both = np.concatenate((total[0].reshape(units, -1), total[1].reshape(units, -1)), axis=1)
        blocks = [(i // rows, zlib.compress(both[i:i + rows].tobytes(), 1)) for i in range(0, units, rows)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()),
                                          pa.array([x for _, x in blocks], pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                x = np.frombuffer(zlib.decompress(raw), dtype=np.int64)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                                         ["block", "counts"])

    schema = "block INT, counts BINARY"
    parts = max(2, spark.sparkContext.defaultParallelism)
    done = corpus.select("units").coalesce(parts).mapInArrow(run, schema).repartition(parts, "block").mapInArrow(add, schema)
    out = np.zeros((units, 2 * n_classes), dtype=np.int64)
    for r in done.collect():
        x = np.frombuffer(bytes(r["counts"]), dtype=np.int64).reshape(-1, 2 * n_classes)
        out[r["block"] * rows:r["block"] * rows + len(x)] += x
    return out


def exchange(around: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """One sweep: each unit, the most frequent first, moves to the class where
    its class bigrams are likeliest, given those of all others."""
    c = n_classes
    right, left = around[:, :c].astype(float), around[:, c:].astype(float)
    size = right.sum(axis=1)
    after, before = np.zeros((c, c)), np.zeros((c, c))       # [class, class that follows | precedes]
    np.add.at(after, classes, right)
    np.add.at(before, classes, left)
    total = np.bincount(classes, weights=size, minlength=c)
    out = classes.copy()
    log_after, log_before, log_total = np.log(after + 0.5), np.log(before + 0.5), np.log(total + 1)
    for u in np.argsort(-size, kind="stable").tolist():
        if not size[u]:
            continue
        a = out[u]
        log_after[a], log_before[a] = np.log(after[a] - right[u] + 0.5), np.log(before[a] - left[u] + 0.5)
        log_total[a] = np.log(total[a] - size[u] + 1)
        b = int(np.argmax(log_after @ right[u] + log_before @ left[u] - 2 * size[u] * log_total))
        if b != a:
            after[a] -= right[u]
            before[a] -= left[u]
            total[a] -= size[u]
            after[b] += right[u]
            before[b] += left[u]
            total[b] += size[u]
            out[u] = b
        log_after[b], log_before[b], log_total[b] = np.log(after[b] + 0.5), np.log(before[b] + 0.5), np.log(total[b] + 1)
    return out


class Model(NamedTuple):
    vocabulary: Vocabulary
    classes: np.ndarray          # of each unit
    mix: np.ndarray              # log10 of the factor beside c(w) + ADD, by class before and class
    end_class: int
    own: np.ndarray | None = None    # classes of the common words, where they have their own

    def of_places(self, encoder: Encoder) -> np.ndarray:
        """Classes of the common words by place."""
        return self.classes[encoder.unit_of] if self.own is None else self.own


def mixed(v: Vocabulary, transitions: np.ndarray, mass: np.ndarray, kinds: np.ndarray, share: float) -> np.ndarray:
    """``Model.mix`` from the counts of class bigrams, of the tokens and of the
    different words of each class."""
    prior = (mass + 1) / (mass + 1).sum()
    smooth = (transitions + 10 * prior) / (transitions.sum(axis=1, keepdims=True) + 10)
    # each class, like the whole, keeps the mass of one word that was never seen
    return np.log10(share * smooth / (mass + ADD * (kinds + 1)) + (1 - share) / (v.n + ADD * (v.v + 1)))


def learn(docs: DataFrame, work: Scratch, n_classes: int = 64, sweeps: int = 4, share: float = 0.9,
          common: int = 1 << 18, units: int = 8192, suffixes: int = 4096) -> tuple[Model, DataFrame]:
    """Model of the units and table of counts from all texts of ``docs``.
    ``common`` bounds the words that are sent to tasks, ``units`` and
    ``suffixes`` those that the exchange moves; classes_of_words() gives the
    other words their own class."""
    counts = work.put(count_words(docs), "counts")
    v = vocabulary(counts, common, units, suffixes)
    classes = np.arange(v.units, dtype=np.int64) % n_classes
    transitions = np.zeros((n_classes, n_classes))
    end = end_unit(v)
    if v.n:
        corpus = work.put(encoded_corpus(docs, v), "corpus")
        for i in range(sweeps + 1):
            around = neighbours(corpus, classes, n_classes, end)
            if i < sweeps:
                classes = exchange(around, classes, n_classes)
        np.add.at(transitions, classes, around[:, :n_classes].astype(float))
    mass = np.bincount(classes, weights=v.unit_counts, minlength=n_classes)
    kinds = np.bincount(classes, weights=v.unit_types, minlength=n_classes)
    return Model(v, classes, mixed(v, transitions, mass, kinds, share), int(classes[end]), None), counts


def contexts(corpus: DataFrame, model: Model, most: int = 1 << 21) -> DataFrame:
    """``(word BINARY, code ARRAY<SHORT>, n ARRAY<INT>)``: how often each class
    follows (code: the class) and precedes (classes + the class) every word
    that is no unit, in parts of about ``most`` neighbours."""
    held = corpus.sparkSession.sparkContext.broadcast((model.vocabulary.words, model.vocabulary.n_units, model.classes,
                                                       2 * len(model.mix)))

    def run(batches):
        common, n_units, classes, c2 = held.value
        names: dict[bytes, int] = {}                            # rare words, numbered after the common ones
        keys: list[np.ndarray] = []

        def flushed():
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            first = np.flatnonzero(np.diff(key // c2, prepend=-1))
            rare = list(names)
            words = [common[k] if k < len(common) else rare[k - len(common)] for k in (key[first] // c2).tolist()]
            starts = pa.array(np.append(first, len(key)), pa.int32())
            names.clear()
            keys.clear()
            for i in range(0, len(words), 1 << 16):
                at = starts.slice(i, min(1 << 16, len(words) - i) + 1)
                lo, hi = at[0].as_py(), at[-1].as_py()
                at = pc.subtract(at, pa.scalar(lo, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[i:i + (1 << 16)], pa.binary()),
                     pa.ListArray.from_arrays(at, pa.array((key[lo:hi] % c2).astype(np.int16))),
                     pa.ListArray.from_arrays(at, pa.array(n[lo:hi].astype(np.int32)))], ["word", "code", "n"])

        for batch in batches:
            for b in byte_slices(batch, "at", 1 << 21):
                at, n = numbers(b.column("at"), "<i4")
                cls = classes[numbers(b.column("units"), "<u2")[0]]
                unknown, place, rare = rare_words(b, at, n)
                rare = rare.dictionary_encode()
                known = np.array([names.setdefault(w, len(names)) for w in rare.dictionary.to_pylist()], dtype=np.int64)
                at[unknown] = len(common) + known[rare.indices.to_numpy().astype(np.int64)[place]]
                other = np.flatnonzero(at >= n_units)
                # the slice's last token, an end, also stands before its first
                keys += [at[other] * c2 + np.roll(cls, -1)[other], at[other] * c2 + c2 // 2 + np.roll(cls, 1)[other]]
                if sum(map(len, keys)) > most:
                    yield from flushed()
        if keys:
            yield from flushed()

    return corpus.select("at", "units", "rare").mapInArrow(run, "word BINARY, code ARRAY<SHORT>, n ARRAY<INT>")


def best_classes(around: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The class that exchange() would move each word to, by itself, from its
    class ``own``; ``after`` and ``before`` count the classes that follow and
    precede each class."""
    c = len(after)
    right, left, total = around[:, :c], around[:, c:], after.sum(axis=1)
    size = right.sum(axis=1)
    gain = (right @ np.log(after + 0.5).T + left @ np.log(before + 0.5).T
            - 2 * size[:, None] * np.log(total + 1))
    gain[np.arange(len(own)), own] = (
        (right * np.log(after[own] - right + 0.5)).sum(axis=1) + (left * np.log(before[own] - left + 0.5)).sum(axis=1)
        - 2 * size * np.log(total[own] - size + 1))
    return np.argmax(gain, axis=1)


def assigned(parts: DataFrame, model: Model, after: np.ndarray, before: np.ndarray) -> DataFrame:
    """``(word BINARY, n LONG, class INT)`` of every word of contexts()."""
    held = parts.sparkSession.sparkContext.broadcast((model, after, before))

    def run(batches):
        m, after, before = held.value
        encoder, c = Encoder(m.vocabulary), len(m.mix)
        last, sums = None, np.zeros((1, 2 * c))                 # of the word that the batch before ended with

        def row(names, around):
            own = m.classes[np.array([encoder.unit(w) for w in names], dtype=np.int64)]
            best = best_classes(around, own, after, before)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(around[:, :c].sum(axis=1).astype(np.int64)),
                                               pa.array(best.astype(np.int32))], ["word", "n", "class"])

        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                b = batch.slice(i, 4096)
                words = b.column("word").to_pylist()
                names = [w for w, x in zip(words, [last, *words]) if w != x]
                first = 0 if last is None else 1                # row 0 is that of the word before
                group = np.cumsum([w != x for w, x in zip(words, [last, *words])]) + first - 1
                at = np.repeat(group, pc.list_value_length(b.column("code")).to_numpy()) * 2 * c
                around = np.bincount(at + b.column("code").flatten().to_numpy(), weights=b.column("n").flatten().to_numpy(),
                                     minlength=(len(names) + first) * 2 * c).reshape(-1, 2 * c)
                if first:
                    names.insert(0, last)
                    around[0] += sums[0]
                last, sums = names[-1], around[-1:]
                if len(names) > 1:
                    yield row(names[:-1], around[:-1])
        if last is not None:
            yield row([last], sums)

    return parts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word BINARY, n LONG, class INT")


def lists(rows: list, kind) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def cut(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One list of the given length after another."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.astype(np.int32)))


def with_found(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """``found``: place in ``keys``, count and class (-1: none) of the keys that
    the lookup table holds."""
    keys = rows.select("row", F.posexplode("keys").alias("k", "word"))
    found = keys.join(lookup, "word").groupBy("row").agg(
        F.collect_list(F.struct("k", "n", F.coalesce("class", F.lit(-1)).alias("class"))).alias("found"))
    return rows.join(found, "row", "left")


def found_in(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's keys begin among all; of ``found``, the place among all
    keys, count and class."""
    lengths = pc.list_value_length(b.column("keys")).to_numpy()
    first = np.cumsum(lengths) - lengths
    parent = np.repeat(first, pc.fill_null(pc.list_value_length(b.column("found")), 0).to_numpy(zero_copy_only=False))
    k, n, cls = (x.to_numpy().astype(np.int64) for x in b.column("found").flatten().flatten())
    return first, parent + k, n, cls


def resolved(b: pa.RecordBatch, name: str, first: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and class of each entry of a list of classes and rare words."""
    row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(name)).to_numpy())
    x = b.column(name).flatten().to_numpy().astype(np.int64)
    out = x.copy()
    out[x < 0] = cls[first[row[x < 0]] - 1 - x[x < 0]]
    return row, out


def class_bigrams(corpus: DataFrame, model: Model, lookup: DataFrame, work: Scratch) -> np.ndarray:
    """How often each class follows each, with every word in its own class."""
    c = len(model.mix)
    held = corpus.sparkSession.sparkContext.broadcast((model.own, model.end_class))

    def read(batches):
        places, end = held.value
        row, known = TaskContext.get().partitionId() << 40, np.zeros(c * c, dtype=np.int64)

        def record(rare, first, second, known):
            return pa.RecordBatch.from_arrays(
                [pa.array([row]), lists([rare], pa.binary()), cut(first, np.array([len(first)])),
                 cut(second, np.array([len(second)])), lists([known], pa.int64())],
                ["row", "keys", "first", "second", "known"])

        for batch in batches:
            for b in byte_slices(batch, "at", 1 << 20):
                at, n = numbers(b.column("at"), "<i4")
                unknown, place, rare = rare_words(b, at, n)
                rare = rare.dictionary_encode()
                code = places[np.maximum(at, 0)]
                code[unknown] = -1 - rare.indices.to_numpy().astype(np.int64)[place]
                before = np.concatenate(([end], code[:-1]))
                before[np.cumsum(n) - n] = end                  # a text follows an end
                left = (before < 0) | (code < 0)
                known += np.bincount(before[~left] * c + code[~left], minlength=c * c)
                if left.any():
                    yield record(rare.dictionary.to_pylist(), before[left], code[left], [])
                    row += 1
        yield record([], np.zeros(0), np.zeros(0), known)

    def add(batches):
        total = np.zeros(c * c, dtype=np.int64)
        for b in batches:
            total += b.column("known").flatten().to_numpy().reshape(-1, c * c).sum(axis=0)
            first, at, _, found = found_in(b)
            cls = np.zeros(int(pc.sum(pc.list_value_length(b.column("keys"))).as_py() or 0), dtype=np.int64)
            cls[at] = found
            total += np.bincount(resolved(b, "first", first, cls)[1] * c + resolved(b, "second", first, cls)[1], minlength=c * c)
        yield pa.RecordBatch.from_arrays([lists([total], pa.int64())], ["total"])

    rows = work.put(corpus.select("at", "rare").mapInArrow(
        read, "row LONG, keys ARRAY<BINARY>, first ARRAY<INT>, second ARRAY<INT>, known ARRAY<LONG>"), "bigrams")
    sums = with_found(rows, lookup).mapInArrow(add, "total ARRAY<LONG>")
    return sum((np.array(r["total"], dtype=float) for r in sums.toLocalIterator()), np.zeros(c * c)).reshape(c, c)


def classes_of_words(docs: DataFrame, model: Model, work: Scratch, share: float = 0.9) -> tuple[Model, DataFrame]:
    """The model with a class for every word of ``docs``, the texts that it was
    learned from with the same ``work``, and a table ``(word, n, class)`` of the words that are no
    units.  Under END and an ending, it also has the class with the most tokens
    of each ending that is no unit."""
    v, c = model.vocabulary, len(model.mix)
    spark = docs.sparkSession
    if not v.n:
        return model, spark.createDataFrame([], "word BINARY, n LONG, class INT")
    corpus = work.get("corpus")
    around = neighbours(corpus, model.classes, c, end_unit(v))
    after, before = np.zeros((c, c)), np.zeros((c, c))
    np.add.at(after, model.classes, around[:, :c].astype(float))
    np.add.at(before, model.classes, around[:, c:].astype(float))
    words = work.put(assigned(contexts(corpus, model), model, after, before), "classes")

    least = int(v.counts[-1]) if len(v.counts) else v.n + 1
    # the common words in the order of the vocabulary: only their classes reach the driver
    common = words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").select("class").toArrow()
    own = np.concatenate((model.classes[:v.n_units], common.column("class").to_numpy(),
                          np.zeros(int(not v.words)))).astype(np.int64)
    end_class = (int(own[v.words.index(END)]) if END in v.words
                 else words.where(F.col("word") == F.lit(END)).first()["class"])

    mass = np.bincount(own[:v.n_units], weights=v.counts[:v.n_units], minlength=c)
    kinds = np.bincount(own[:v.n_units], minlength=c).astype(float)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        mass[r["class"]] += r["n"]
        kinds[r["class"]] += r["kinds"]
    ending = F.expr(f"substring(word, -{SUFFIX}, {SUFFIX})")
    tails = (words.groupBy(ending.alias("s"), "class").agg(F.sum("n").alias("n")).groupBy("s")
             .agg(F.max_by("class", F.struct("n", "class")).alias("class"))
             .select(F.concat(F.lit(END), "s").alias("word"), F.lit(0).cast("long").alias("n"), "class"))
    model = model._replace(own=own, end_class=end_class)
    less = words.where(F.col("n") < least)
    model = model._replace(mix=mixed(v, class_bigrams(corpus, model, less, work), mass, kinds, share))
    return model, work.put(less.unionByName(tails), "lookup")


SCORED = ("row LONG, doc_id LONG, held_out BOOLEAN, n_tokens LONG, n_known LONG, log_counts DOUBLE, "
          "log_mix DOUBLE, keys ARRAY<BINARY>, times ARRAY<INT>, slot ARRAY<INT>, ending ARRAY<INT>, "
          "first ARRAY<INT>, second ARRAY<INT>")


def score_common(corpus: DataFrame, model: Model) -> DataFrame:
    """What a task knows of each document of encoded_corpus() by itself; the
    words whose count it does not know with the class of their ending, and the
    pairs of classes with such words.  An ending that is no unit is a key too,
    0 times, with the word that has it as ``slot``."""
    held = corpus.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        encoder, row = Encoder(m.vocabulary), TaskContext.get().partitionId() << 40
        places = m.of_places(encoder)
        log_count = np.log10(np.append(m.vocabulary.counts, 0) + ADD)
        for batch in batches:
            for b in byte_slices(batch, "at", 1 << 20):
                at, n = numbers(b.column("at"), "<i4")
                starts = np.cumsum(n) - n
                unknown, place, words = rare_words(b, at, n)
                times = np.bincount(place, minlength=len(words)).tolist()
                known = at >= 0
                code = np.where(known, places[np.maximum(at, 0)], at)
                before = np.concatenate(([m.end_class], code[:-1]))
                before[starts] = m.end_class                    # a text follows an end
                left = (before < 0) | ~known
                pairs = np.add.reduceat(left.astype(np.int64), starts)
                rare = b.column("rare").to_pylist()
                more = [[(k, w) for k, w in enumerate(r) if w[-SUFFIX:] not in encoder.suffix] for r in rare]
                at_first = np.cumsum([0, *map(len, rare)]).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + len(n))), b.column("doc_id"), b.column("held_out"),
                    pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(np.where(known, log_count[np.maximum(at, 0)], 0.0), starts)),
                    pa.array(np.add.reduceat(
                        np.where(left, 0.0, m.mix[np.maximum(before, 0), np.maximum(code, 0)]), starts)),
                    lists([[*r, *(END + w[-SUFFIX:] for _, w in x)] for r, x in zip(rare, more)], pa.binary()),
                    lists([[*times[i:j], *(0 for _ in x)] for i, j, x in zip(at_first, at_first[1:], more)], pa.int32()),
                    lists([[*range(len(r)), *(k for k, _ in x)] for r, x in zip(rare, more)], pa.int32()),
                    lists([[int(m.classes[encoder.unit(w)]) for w in (*r, *(w for _, w in x))]
                           for r, x in zip(rare, more)], pa.int32()),
                    cut(before[left], pairs), cut(code[left], pairs)],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "log_mix", "keys", "times",
                     "slot", "ending", "first", "second"])
                row += len(n)

    return corpus.select("doc_id", "held_out", "at", "rare").mapInArrow(run, SCORED)


def score(docs: DataFrame, model: Model, counts: DataFrame, work: Scratch) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity`` of ``(doc_id, held_out, text)``.  ``counts`` is the table of
    learn(), where rare words have the class of their ending, or of
    classes_of_words().

    Null or empty text: the end alone.  Null doc_ids and repeated rows are
    scored like others; an empty table gives an empty result; with nothing to
    learn from, every token is unknown.
    """
    return score_encoded(work.put(encoded_corpus(docs, model.vocabulary), "to-score"), model, counts, work)


def score_encoded(corpus: DataFrame, model: Model, counts: DataFrame, work: Scratch) -> DataFrame:
    """score() of encoded_corpus()."""
    v = model.vocabulary
    least = int(v.counts[-1]) if len(v.counts) else 1
    scored = work.put(score_common(corpus, model), "scored")
    less = counts.where(F.col("n") < least) if len(v.counts) else counts
    if "class" not in less.columns:
        less = less.withColumn("class", F.lit(None).cast("int"))
    mix = corpus.sparkSession.sparkContext.broadcast(model.mix)

    def run(batches):
        for b in batches:
            first, at, n, found = found_in(b)
            times, slot, cls = (b.column(x).flatten().to_numpy().astype(np.int64) for x in ("times", "slot", "ending"))
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("keys")).to_numpy())
            count, cls = np.zeros(len(cls), dtype=np.int64), cls.copy()
            count[at] = n
            whole = times[at] > 0
            for these in (~whole & (found >= 0), whole & (found >= 0)):     # a word's own class replaces its ending's
                cls[first[row[at[these]]] + slot[at[these]]] = found[these]
            owner, before = resolved(b, "first", first, cls)
            pairs = mix.value[before, resolved(b, "second", first, cls)[1]]
            sums = [np.bincount(row, weights=times * (count > 0), minlength=b.num_rows).astype(np.int64),
                    np.bincount(row, weights=times * np.log10(count + ADD), minlength=b.num_rows),
                    np.bincount(owner, weights=pairs, minlength=b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), b.column("n_tokens"),
                 pc.add(b.column("n_known"), pa.array(sums[0])), pc.add(b.column("log_counts"), pa.array(sums[1])),
                 pc.add(b.column("log_mix"), pa.array(sums[2]))],
                ["doc_id", "held_out", "n_tokens", "n_known", "logs", "log_mix"])

    whole = with_found(scored, less).mapInArrow(
        run, "doc_id LONG, held_out BOOLEAN, n_tokens LONG, n_known LONG, logs DOUBLE, log_mix DOUBLE")
    score_ = F.col("logs") + F.col("log_mix")
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(v.n + ADD * (v.v + 1))))).alias("base_score"),
        score_.alias("score"), F.pow(F.lit(10.0), -score_ / F.col("n_tokens")).alias("perplexity"))


def op5_class_lm(spark, sf_dir):
    """Scores of all documents; learned outside fold 0 of 10."""
    work = scratch(spark, "class-lm")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 10) == 0).alias("held_out"))
    known = docs.where("NOT held_out")
    model, _ = learn(known, work)
    model, words = classes_of_words(known, model, work)
    texts = work.put(encoded_corpus(docs.where("held_out"), model.vocabulary), "held-out")
    if model.vocabulary.n:
        texts = texts.unionByName(work.get("corpus"))
    return score_encoded(texts, model, words, work)
