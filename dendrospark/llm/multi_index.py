"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: principal axes of a bounded sample, turned by the
rotation that brings them closest to the corners of a cube (ITQ), one bit an
axis.  A block's codes are cut into substrings, each with an index of its own.
If two codes differ in at most r bits, one of m substrings differs in at most
r // m (pigeonhole): probing every bucket that near in each index retrieves all
codes within r bits, which are verified on the whole code and reranked by the
cosine of the original vectors.

The radius is read from the same sample, as the one that holds nearly all true
neighbours there; neighbours in the whole table are nearer still.  A block in
which too few codes lie within it is probed with a growing radius.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .vectors import finite, matrix, nearest_of, search

BITS, SUBSTRING = 64, 16


class Codes(NamedTuple):
    mean: np.ndarray
    axes: np.ndarray             # (dim, bits)
    radius: int

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def of(self, units: np.ndarray) -> np.ndarray:
        on = (units - self.mean) @ self.axes > 0
        packed = np.zeros((len(units), 8), dtype=np.uint8)
        packed[:, :(self.bits + 7) // 8] = np.packbits(on, axis=1, bitorder="little")
        return packed.view("<u8").ravel()


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, k: int, rounds: int = 30, asked: int = 256, covered: float = 0.99) -> Codes:
    """Rotated codes and the radius that covers a share of the true k nearest
    of the first ``asked`` sample rows."""
    units = unit_rows(sample)
    mean = units.mean(axis=0)
    _, _, axes = np.linalg.svd(units - mean, full_matrices=False)
    axes = axes[:BITS].T
    flat = (units - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        corners = np.where(flat @ turn > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(flat.T @ corners)
        turn = u @ vt
    codes = Codes(mean, axes @ turn, 0)
    near = units[:asked] @ units.T
    near[np.arange(len(near)), np.arange(len(near))] = -2
    top = np.argsort(-near, axis=1)[:, :min(k, len(units) - 1)]
    bits = codes.of(units)
    away = np.bitwise_count(bits[:len(near), None] ^ bits[top])
    return codes._replace(radius=int(np.quantile(away, covered)) if away.size else 0)


class Block:
    """Indexes of a block's codes: for each substring, its different values
    and which of them each row has."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        self.parts = max(1, -(-bits // SUBSTRING))
        self.index = [np.unique(self._substring(codes, j), return_inverse=True) for j in range(self.parts)]

    @staticmethod
    def _substring(codes, j: int):
        return codes >> np.uint64(j * SUBSTRING) & np.uint64((1 << SUBSTRING) - 1)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """All rows whose code is at most ``radius`` bits away."""
        hit = np.zeros(len(self.codes), dtype=bool)
        for j, (values, row_value) in enumerate(self.index):
            probed = np.bitwise_count(values ^ self._substring(code, j)) <= radius // self.parts
            hit |= probed[row_value]
        at = np.flatnonzero(hit)
        return at[np.bitwise_count(self.codes[at] ^ code) <= radius]


def nearest(points: DataFrame, queries: DataFrame, k: int = 5, sample: int = 8192) -> DataFrame:
    """The k nearest rows found to each query by cosine: ``query_id, rank,
    vec_id, score``.  Both tables are ``(id, v ARRAY<DOUBLE>)``; a row with the
    query's id is not its neighbour.

    Codes are fitted to about ``sample`` rows, those with the smallest hash of
    their id; every row is indexed.  Null ids, and vectors that are null, zero
    or hold a null or non-finite component, take no part; rows that repeat
    another's id and vector count once.  Ties go to the smaller id.  An empty
    table gives an empty result.
    """
    whole = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    points, queries = whole(points), whole(queries)
    n = points.count()
    place = F.shiftrightunsigned(F.xxhash64(F.lit("codes"), "id"), 11) / F.lit(float(1 << 53))
    chosen = points.where(place < min(1.0, sample / max(n, 1))).orderBy("id").select("v").toArrow().column("v")
    by_dim: dict[int, Codes] = {}
    lengths = np.array([len(x) for x in chosen])
    for dim in np.unique(lengths).tolist():
        own = matrix(chosen.combine_chunks().filter(lengths == dim), np.float64)
        if len(own) > 2 * k:
            by_dim[dim] = fit(own, k)

    def best(x, ids, asked, asked_ids):
        codes = by_dim.get(x.shape[1], Codes(np.zeros(x.shape[1]), np.zeros((x.shape[1], 1)), 0))
        norms, units = np.linalg.norm(x, axis=1), unit_rows(x)
        block = Block(codes.of(units), codes.bits)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        for code, q, own in zip(codes.of(unit_rows(asked)), asked, asked_ids):
            radius = codes.radius
            at = block.within(code, radius)
            while count[at].sum() <= k and radius < codes.bits:
                radius += 4
                at = block.within(code, radius)
            scores = (x[at] * q).sum(axis=1) / (norms[at] * np.linalg.norm(q))
            yield nearest_of(scores, [ids[i] for i in at.tolist()], own, k)

    return search(points, queries, k, "DOUBLE", best)


def op6_multi_index_hashing(spark, sf_dir):
    """The 5 nearest of every 50th vector."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(points, points.where("id % 50 = 0"), 5)
