"""Quality by the vote of the nearest labelled documents.

A document becomes counts of hashed terms: three-character pieces of the text,
pieces of its shape (letters, capitals, digits and signs, runs collapsed), and
how much of it repeats.  Latent semantic analysis of a bounded labelled sample
(damped counts times inverse document frequency, truncated singular vectors)
gives every document a short vector.  The labelled vectors go to all tasks; each
document is compared with every one of them, block by block, by its exact
cosine, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import byte_slices, fold, table, whole_text

PIECES = SHAPES = 1 << 11
#: Lengths of word sequences whose repetition is measured, and levels of it.
REPEATS, LEVELS = (1, 2, 5), 10
TERMS = PIECES + SHAPES + len(REPEATS) * LEVELS + LEVELS
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[:] = ord("x")
_CLASS[:128] = np.arange(128)
_CLASS[ord("a"):ord("z") + 1] = ord("x")
_CLASS[ord("A"):ord("Z") + 1] = ord("X")
_CLASS[ord("0"):ord("9") + 1] = ord("9")
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _hashed(symbols: np.ndarray, width: int) -> np.ndarray:
    """Rows of all three-symbol pieces in a table of ``width`` rows."""
    if len(symbols) < 3:
        return np.zeros(0, np.int64)
    s = symbols.astype(np.uint32)
    mixed = (s[:-2] << np.uint32(16) | s[1:-1] << np.uint32(8) | s[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(32 - (width - 1).bit_length())).astype(np.int64)


def _level(share: float) -> int:
    return min(LEVELS - 1, int(share * LEVELS))


def counts(text: str) -> np.ndarray:
    """Damped counts of all terms of a whole text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    shape = _CLASS[raw]
    shape = shape[np.flatnonzero(np.diff(shape, prepend=0))]
    out = np.zeros(TERMS, dtype=np.float32)
    for at, width, rows in ((0, PIECES, _hashed(_LOWER[raw], PIECES)), (PIECES, SHAPES, _hashed(shape, SHAPES))):
        block = np.log1p(np.bincount(rows, minlength=width)).astype(np.float32)
        out[at:at + width] = block / max(1e-9, float(np.sqrt(block @ block)))
    # shares of word sequences that occurred before, and the text's size
    words = text.split()
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    key, at = ids, PIECES + SHAPES
    for length in range(1, max(REPEATS) + 1):
        if length > 1:
            key = key[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[length - 1:] if len(key) > 1 else key[:0]
        if length in REPEATS:
            share = 1 - len(np.unique(key)) / len(key) if len(key) else 0.0
            out[at + _level(share)] = 0.7
            at += LEVELS
    out[at + min(LEVELS - 1, len(words).bit_length())] = 0.2
    return out


@dataclass
class Voters:
    """Weights of the terms, axes of the latent space, and the labelled rows:
    unit vectors, labels and the rows that each stands for."""
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    neighbours: int = 32
    sharpness: float = 8.0

    def latent(self, terms: np.ndarray) -> np.ndarray:
        v = (terms * self.idf) @ self.axes
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)

    def nearest(self, vectors: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and rows of the nearest labelled vectors of each vector:
        exact products with one block of labelled vectors after the other; equal
        cosines (to six decimals) go to the earlier row.  Those of the nearest are
        added up in double precision, so the rows measured together do not matter."""
        n = len(vectors)
        best = np.zeros((n, 0), dtype=np.int64)
        for first in range(0, len(self.vectors), block):
            near = np.rint(vectors @ self.vectors[first:first + block].T * 1e6).astype(np.int64)
            rank = (near << 32) - np.arange(first, first + near.shape[1])
            best = np.concatenate((best, rank), axis=1)
            if best.shape[1] > self.neighbours:
                best = np.partition(best, best.shape[1] - self.neighbours, axis=1)[:, -self.neighbours:]
        best = -np.sort(-best, axis=1)
        rows = -best & 0xFFFFFFFF
        near = np.empty(rows.shape)
        for k in range(rows.shape[1]):
            near[:, k] = (vectors.astype(float) * self.vectors[rows[:, k]]).sum(axis=1)
        return near, rows

    def score(self, texts: list[str]) -> np.ndarray:
        """Share of label 1 in the neighbours' weighted vote."""
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        near, rows = self.nearest(self.latent(np.stack([counts(t) for t in texts])))
        vote = np.maximum(near, 0) ** self.sharpness * self.weights[rows]
        total = vote.sum(axis=1)
        hit = (vote * self.labels[rows]).sum(axis=1)
        return np.round(np.where(total > 0, hit / np.where(total > 0, total, 1), self.prior), 9)


def latent_axes(terms: np.ndarray, size: int, rounds: int = 4, seed: int = 5) -> np.ndarray:
    """Right singular vectors of the ``size`` largest singular values, by
    subspace iteration."""
    size = min(size, *terms.shape)
    q = np.random.default_rng(seed).normal(size=(terms.shape[1], min(terms.shape[1], size + 16)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(terms.T @ (terms @ q))
    _, _, v = np.linalg.svd(terms @ q, full_matrices=False)
    return (q @ v.T)[:, :size].astype(np.float32)


def fit(terms: np.ndarray, labels: np.ndarray, weights: np.ndarray, size: int = 32, neighbours: int = 32) -> Voters:
    """Voters from the term counts, labels and weights of the labelled rows."""
    seen = (terms > 0).sum(axis=0)
    idf = np.log((1 + len(terms)) / (1 + seen)).astype(np.float32) + 0.1
    empty = np.zeros((0, 0), dtype=np.float32)
    prior = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.5
    model = Voters(idf, empty, empty, labels.astype(np.float64), weights.astype(np.float64), prior, neighbours)
    if len(terms):
        model.axes = latent_axes(terms * idf, size)
        model.vectors = model.latent(terms)
    return model


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 2048, size: int = 32, neighbours: int = 32) -> Voters:
    """Voters from ``docs (doc_id, text)`` and ``labels (doc_id, quality)``.

    The bounded sample: about ``per_label`` ids of each label, those with the
    smallest hash; only these ids are broadcast to the documents, and their term
    counts (``TERMS`` numbers a document, whatever its length) reach the driver.
    Each voter stands for as many labelled ids as the sample left out.  Labels
    other than 0 and 1 and null ids teach nothing; an id with both labels counts
    as 0.  Documents that repeat an id all vote.
    """
    y = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.col("quality").cast("int")).alias("y"))
    found = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, per_label / found.get(k, 1)) for k in (0, 1)}
    at = F.xxhash64(F.lit("quality"), "doc_id")
    place = F.shiftrightunsigned(at, 11) / F.lit(float(1 << 53))
    chosen = y.where(place < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).withColumn("at", at)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("at", "y", "text")

    def run(batches):
        for b in batches:
            for part in byte_slices(b, "text"):
                terms = [counts(t) for t in part.column("text").to_pylist()]
                at = [np.flatnonzero(t) for t in terms]
                yield pa.RecordBatch.from_arrays(
                    [part.column("at"), part.column("y"), pa.array(at, pa.list_(pa.int32())),
                     pa.array([t[i] for t, i in zip(terms, at)], pa.list_(pa.float32()))], ["at", "y", "term", "n"])

    sample = rows.mapInArrow(run, "at LONG, y INT, term ARRAY<INT>, n ARRAY<FLOAT>").collect()
    sample.sort(key=lambda r: (r["at"], r["y"], r["term"], r["n"]))
    terms = np.zeros((len(sample), TERMS), dtype=np.float32)
    for i, r in enumerate(sample):
        terms[i, r["term"]] = r["n"]
    return fit(terms, np.array([r["y"] for r in sample], dtype=np.int64),
               np.array([1 / share[r["y"]] for r in sample]), size, neighbours)


def score(docs: DataFrame, model: Voters) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1, higher: label 1 likelier),
    read from the whole ``text`` alone; a column ``score`` of ``docs`` is replaced.

    Null text counts as empty; an empty text has a vector of its own (its size)
    and a vote like any other.  Without labelled rows every score is 0.5.
    Repeated rows and null ids are scored like others; an empty table gives an
    empty result.  The labelled vectors (a bounded sample) are broadcast.
    """
    own = [f for f in docs.schema.fields if f.name != "score"]
    schema = StructType([*own, StructField("score", DoubleType())])
    voters = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for part in byte_slices(b, "text", 1 << 20):
                s = voters.value.score([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in own], pa.array(s)], schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in own]).mapInArrow(run, schema)


def op12_neighbour_quality(spark, sf_dir):
    """Quality of every whole text; learned outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    model = learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
