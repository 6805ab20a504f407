"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed into two rows of an embedding table, whose sum stands for the
word.  Filters that span one, two and three words slide over the whole text;
each filter's largest response is one feature (max pooling), a logistic layer
turns the features into a score.  Only the windows that a filter picked get a
gradient.  The scores are calibrated by cross-fitting: each labelled row is
scored by a network that did not see it, and these scores also give each
language the threshold of the best F1.

``learn`` trains on every labelled document.  Their words lie in shards by the
hash of the id; in an epoch each shard takes the networks through its documents
by itself, and the mean of the shards, weighted by documents, starts the next.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast
from .common import blocks_for, byte_slices, fold, release_memory, scratch, table, whole_text

WORDS = re.compile(r"\w+")
WIDTHS = (1, 2, 3)
ROWS = 1 << 15
#: Tokens scored at a time; longer texts go in overlapping pieces.
PIECE = 1 << 15
#: Blocks in which a network's numbers travel.
BLOCKS = 32
#: Steps of calibration scores to one unit of the logit.
BINS = 256


def hashed(words: list[str]) -> np.ndarray:
    """Two rows of the embedding table for each word."""
    return _rows(np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words)))


def _rows(crc: np.ndarray) -> np.ndarray:
    """The same from the CRC-32 of the words; a row of borders if there is none."""
    if not len(crc):
        return np.full((1, 2), 2 * ROWS)
    return np.stack((crc & np.uint64(ROWS - 1), ROWS + (crc >> np.uint64(15) & np.uint64(ROWS - 1))), axis=1).astype(np.int64)


@dataclass
class Network:
    """Embeddings (2 * ROWS + 1, dim; the last row is the border, all zero),
    filters by width (width, dim, filters), their biases, the logistic layer,
    calibration and thresholds."""
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.3

    def pooled(self, vectors: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list]:
        """Largest response of every filter in each text.  ``vectors`` are the
        embedded tokens of the texts, with two border rows after each text;
        also returns the responses by width."""
        out, all_responses = [], []
        for w, (f, b) in zip(WIDTHS, zip(self.filters, self.biases)):
            n = len(vectors) - w + 1
            r = vectors[:n] @ f[0]
            for j in range(1, w):
                r += vectors[j:j + n] @ f[j]
            bounds = np.stack((starts, ends), axis=1).ravel()
            bounds = bounds[:-1] if ends[-1] >= n else bounds      # the last text ends with the responses
            out.append(np.maximum.reduceat(r, bounds, axis=0)[::2] + b)
            all_responses.append(r)
        return np.concatenate(out, axis=1), all_responses

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return self.embedding[rows[:, 0]] + self.embedding[rows[:, 1]]

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -50, 50)))

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities of whole texts, to 12 decimals: the last
        bits depend on which texts are scored together."""
        return np.round(self.probability(self.logits(texts)), 12)

    def logit(self, rows: np.ndarray) -> float:
        """The logistic layer's sum for the tokens of one text."""
        best = np.full(len(self.weights), -np.inf, dtype=np.float32)
        for a in range(0, len(rows), PIECE):
            part = np.concatenate((rows[a:a + PIECE + 2], np.full((2, 2), 2 * ROWS)))
            got, _ = self.pooled(self.embed(part), np.array([0]), np.array([len(part) - 2]))
            best = np.maximum(best, got[0])
        return float(best.astype(np.float64) @ self.weights + self.bias)

    def logits(self, texts: list[str]) -> np.ndarray:
        """The logistic layer's sums for whole texts."""
        tokens = [WORDS.findall(t.lower()) for t in texts]
        pieces, owner = [], []
        for i, words in enumerate(tokens):
            for a in range(0, max(1, len(words)), PIECE):
                # a piece also holds the two words that end its last windows
                pieces.append(words[a:a + PIECE + 2])
                owner.append(i)
        features = np.full((len(texts), sum(f.shape[2] for f in self.filters)), -np.inf, dtype=np.float32)
        first = 0
        while first < len(pieces):
            last, n = first, 0
            while last < len(pieces) and (last == first or n + len(pieces[last]) <= PIECE):
                n += len(pieces[last]) + 3
                last += 1
            part = pieces[first:last]
            names = {}
            flat, starts, ends = [], [], []
            for words in part:
                starts.append(len(flat))
                flat += [names.setdefault(w, len(names)) for w in words] or [-1]
                ends.append(len(flat))
                flat += [-1, -1]
            vectors = np.zeros((len(names) + 1, self.embedding.shape[1]), dtype=np.float32)
            if names:
                vectors[:-1] = self.embed(hashed(list(names)))
            got, _ = self.pooled(vectors[np.array(flat)], np.array(starts), np.array(ends))
            np.maximum.at(features, owner[first:last], got)
            first = last
        return features.astype(np.float64) @ self.weights + self.bias


def _start(tokens: list[np.ndarray], labels: np.ndarray, dim: int, filters: int,
           rng: np.random.Generator) -> Network:
    seen = np.zeros((2, 2 * ROWS + 1))
    for rows, y in zip(tokens, labels):
        seen[y, np.unique(rows)] += 1
    return _start_counted(seen, np.bincount(labels, minlength=2), dim, filters, rng)


def _start_counted(seen: np.ndarray, n: np.ndarray, dim: int = 8, filters: int = 8,
                   rng: np.random.Generator | None = None) -> Network:
    """Small random weights; the first dimension starts as the smoothed log
    odds of a row by the documents that hold it, and the first filters read it.
    ``seen`` and ``n`` count documents by label, with each row and in all."""
    rng = rng or np.random.default_rng(7)
    e = rng.normal(0, 0.1, (2 * ROWS + 1, dim)).astype(np.float32)
    share = (seen + 3 * (seen.sum(axis=0) + 1) / (n.sum() + 1) * 0.5 + 2) / (n[:, None] + 6)
    e[:, 0] = np.log(share[1] / share[0]) / 2
    e[-1] = 0
    fs = [rng.normal(0, 0.2, (w, dim, filters)).astype(np.float32) for w in WIDTHS]
    for f in fs:
        f[:, 0, : filters // 2] += 1.0
    weights = rng.normal(0, 0.1, filters * len(WIDTHS))
    weights.reshape(len(WIDTHS), filters)[:, : filters // 2] += 0.5
    return Network(e, fs, [np.zeros(filters, dtype=np.float32) for _ in WIDTHS], weights)


def _tokens(text: str) -> np.ndarray:
    words = WORDS.findall(text.lower())
    return hashed(words) if words else np.full((1, 2), 2 * ROWS)


class Trainer:
    """AdaGrad steps on the logistic loss of a network."""

    def __init__(self, net: Network, rate: float = 0.05):
        self.net, self.rate, self.bias_moment = net, rate, 1e-3
        self.moments = [np.full(p.shape, 1e-3, dtype=np.float32) for p in self._params()]

    def _params(self) -> list[np.ndarray]:
        return [self.net.embedding, *self.net.filters, *self.net.biases, self.net.weights]

    def numbers(self) -> np.ndarray:
        """All parameters and moments, one behind the other."""
        own = [*self._params(), [self.net.bias], *self.moments, [self.bias_moment]]
        return np.concatenate([np.ravel(x).astype(np.float32) for x in own])

    def take(self, numbers: np.ndarray) -> Trainer:
        """Sets all of them."""
        at = 0
        for group, last in ((self._params(), "bias"), (self.moments, "moment")):
            for p in group:
                p[...] = numbers[at:at + p.size].reshape(p.shape)
                at += p.size
            if last == "bias":
                self.net.bias = float(numbers[at])
            else:
                self.bias_moment = float(numbers[at])
            at += 1
        return self

    def epoch(self, tokens: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, batch: int = 16) -> None:
        """One pass over all rows, ``batch`` at a time."""
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            self._step([tokens[i] for i in part], y[part])

    def _step(self, tokens: list[np.ndarray], y: np.ndarray) -> None:
        net, moments, rate = self.net, self.moments, self.rate
        dim, filters = net.embedding.shape[1], net.filters[0].shape[2]
        border = np.full((2, 2), 2 * ROWS)
        rows = np.concatenate([x for t in tokens for x in (t, border)])
        lengths = np.array([len(t) for t in tokens])
        starts = np.concatenate(([0], np.cumsum(lengths + 2)[:-1]))
        vectors = net.embed(rows)
        features, responses = net.pooled(vectors, starts, starts + lengths)
        features = features.astype(np.float64)
        err = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.bias, -30, 30))) - y
        back = err[:, None] * net.weights / len(y)       # gradient at the pooled features
        steps = [(net.weights, moments[-1], features.T @ err / len(y))]
        touched, pulls = [], []
        for k, (w, f, r) in enumerate(zip(WIDTHS, net.filters, responses)):
            g = back[:, k * filters:(k + 1) * filters].astype(np.float32)
            # the window each filter picked in each text
            at = np.stack([s + np.argmax(r[s:s + n], axis=0) for s, n in zip(starts, lengths)])
            grad = np.zeros_like(f)
            for j in range(w):
                x = vectors[at + j]                          # texts, filters, dim
                grad[j] = np.einsum("tf,tfd->df", g, x)
                pulls.append((g[:, :, None] * f[j].T[None]).reshape(-1, dim))
                touched.append(rows[(at + j).ravel()])
            steps.append((f, moments[1 + k], grad))
            steps.append((net.biases[k], moments[1 + len(WIDTHS) + k], g.sum(axis=0)))
        for p, m, g in steps:
            m += g * g
            p -= rate * g / np.sqrt(m)
        mean = float(err.mean())
        self.bias_moment += mean ** 2
        net.bias -= rate * mean / self.bias_moment ** 0.5
        pull = np.concatenate(pulls)
        at, where = np.unique(np.concatenate(touched).T.ravel(), return_inverse=True)
        total = np.zeros((len(at), dim), dtype=np.float32)
        np.add.at(total, where, np.concatenate((pull, pull)))
        total[at == 2 * ROWS] = 0
        moments[0][at] += total * total
        net.embedding[at] -= rate * total / np.sqrt(moments[0][at])


def train(tokens: list[np.ndarray], y: np.ndarray, dim: int = 8, filters: int = 8, epochs: int = 6,
          rate: float = 0.05, batch: int = 16, seed: int = 7) -> Network:
    """A network, not yet calibrated, from rows in memory."""
    rng = np.random.default_rng(seed)
    trainer = Trainer(_start(tokens, y, dim, filters, rng), rate)
    for _ in range(epochs if len(y) else 0):
        trainer.epoch(tokens, y, rng, batch)
    return trainer.net


def fit(texts: list[str], labels: list[int], languages: list[str | None], weights: list[float],
        folds: int = 4) -> Network:
    """Trains on all rows, and calibrates on scores that networks trained
    without the row give it, ``folds`` of them.  ``weights`` count the rows
    in the calibration."""
    y = np.array(labels, dtype=np.int64)
    tokens = [_tokens(t) for t in texts]
    z = np.zeros(len(y))
    for k in range(folds):
        other, own = np.arange(len(y)) % folds != k, np.flatnonzero(np.arange(len(y)) % folds == k)
        if len(own):
            net = train([tokens[i] for i in np.flatnonzero(other)], y[other])
            z[own] = net.logits([texts[i] for i in own])
    net = train(tokens, y)
    _calibrate(net, z, y, np.array([x or "" for x in languages]), np.array(weights, dtype=float))
    return net


def _calibrate(net: Network, z, y, languages, weights, least: int = 20) -> None:
    """Platt scaling by Newton steps, then the threshold of the best weighted
    F1: of each language with ``least`` toxic rows or more, else of all; an
    even chance where all have fewer."""
    net.default = 0.5
    if len(set(y.tolist())) < 2:
        return
    toxic = (y * weights).sum()
    target = np.where(y == 1, 1 - 1 / (2 + toxic), 1 / (2 + weights.sum() - toxic))   # Platt's soft targets
    x = np.stack((z, np.ones_like(z)), axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weights * q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weights * (q - target)) + 1e-3 * (beta - [1.0, 0.0]))
        beta -= np.clip(step, -1, 1)
    net.scale, net.shift = float(max(beta[0], 0.05)), float(beta[1])
    score = net.probability(z)

    def best(mask) -> float:
        order = np.argsort(-score[mask])
        s, hit, w = score[mask][order], y[mask][order], weights[mask][order]
        f1 = 2 * np.cumsum(hit * w) / (np.cumsum(w) + (hit * w).sum())
        f1[:-1][s[1:] == s[:-1]] = -1              # equal scores fall on one side
        i = int(np.argmax(f1))
        below = s[i + 1] if i + 1 < len(s) else 0.0
        return float((s[i] + below) / 2)       # midway to the next score

    if toxic >= least:
        net.default = best(np.ones(len(y), dtype=bool))
    for language in sorted(set(languages.tolist()) - {""}):
        if ((own := languages == language) * y * weights).sum() >= least:
            net.thresholds[language] = best(own)


def _marked(docs: DataFrame, labels: DataFrame, folds: int, per_shard: int) -> tuple[DataFrame, int]:
    """Every labelled document ``(shard, at, fold, toxic, lang, words)`` in the order
    of its shard, stored, and the number of labels.  ``words`` are CRC-32 of the words;
    copies of an id lie in one shard and fold."""
    y = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = y.count()
    shards = blocks_for(n, per_shard)
    rows = docs.select("doc_id", whole_text().alias("text"), "lang").join(
        F.broadcast(y) if fits_broadcast(n, 32) else y, "doc_id")
    at = F.xxhash64(F.lit("toxicity"), "doc_id")
    rows = rows.select(F.pmod(at, F.lit(shards)).cast("int").alias("shard"), at.alias("at"),
                       F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int").alias("fold"), "toxic", "lang", "text")
    kept = ["shard", "at", "fold", "toxic", "lang"]

    def cut(batches):
        release_memory()
        for b in batches:
            for part in byte_slices(b, "text"):
                words = [np.fromiter((zlib.crc32(w.encode()) for w in WORDS.findall(t.lower())), "<u4").tobytes()
                         for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(words, pa.binary())], [*kept, "words"])

    coded = rows.mapInArrow(cut, "shard INT, at LONG, fold INT, toxic INT, lang STRING, words BINARY")
    ordered = coded.repartitionById(shards, "shard").sortWithinPartitions("shard", "at", "toxic", "words")
    return scratch(docs.sparkSession, "toxicity").put(ordered, "words"), n


class _Tokens:
    """Tokens of the texts of a batch of ``_marked`` rows, each made when asked for."""

    def __init__(self, batch):
        self.words = batch.column("words")

    def __len__(self) -> int:
        return len(self.words)

    def __getitem__(self, i: int) -> np.ndarray:
        if i >= len(self):
            raise IndexError(i)
        return _rows(np.frombuffer(self.words[int(i)].as_py(), "<u4").astype(np.uint64))


def _decoded(batch) -> tuple[_Tokens, np.ndarray]:
    """Tokens and labels of a batch of ``_marked`` rows."""
    return _Tokens(batch), batch.column("toxic").to_numpy().astype(np.int64)


def _in_blocks(name: int, shard: int, n: int, values: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(values, BLOCKS)
    return pa.RecordBatch.from_arrays(
        [pa.array([x] * BLOCKS, k) for x, k in ((name, pa.int32()), (shard, pa.int32()))]
        + [pa.array(range(BLOCKS), pa.int32()), pa.array([n] * BLOCKS, pa.int64()),
           pa.array([p.tobytes() for p in parts], pa.binary())], ["name", "shard", "block", "n", "numbers"])


BLOCK_ROWS = "name INT, shard INT, block INT, n LONG, numbers BINARY"


def _together(rows: DataFrame, kind: str, mean: bool) -> dict[int, np.ndarray]:
    """Sums, or means weighted by ``n``, of the arrays of each name; what reaches
    the driver is one array a name, whatever the input."""
    def add(key, group):
        group = group.sort_by([("shard", "ascending"), ("n", "ascending")])
        n = group["n"].to_numpy()
        total = sum(np.frombuffer(x.as_py(), kind) * (float(k) if mean else 1.0) for x, k in zip(group["numbers"], n))
        total = (total / n.sum() if mean else total).astype(kind)
        return pa.table({"name": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
                         "numbers": pa.array([total.tobytes()], pa.binary())})
    got = rows.groupBy("name", "block").applyInArrow(add, "name INT, block INT, numbers BINARY").collect()
    out: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r["name"], r["block"])):
        out.setdefault(r["name"], []).append(np.frombuffer(r["numbers"], kind))
    return {k: np.concatenate(v) for k, v in out.items()}


def _document_counts(marked: DataFrame, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each fold and label that hold each row, and all of them."""
    def count(batches):
        seen = np.zeros((folds, 2, 2 * ROWS + 2))
        for b in batches:
            for f, rows, y in zip(b.column("fold").to_pylist(), *_decoded(b)):
                seen[f, y, np.unique(rows)] += 1
                seen[f, y, -1] += 1
        if seen.any():
            yield _in_blocks(0, 0, 1, seen.ravel())
    got = _together(marked.mapInArrow(count, BLOCK_ROWS), "<f8", mean=False)
    seen = got.get(0, np.zeros(folds * 2 * (2 * ROWS + 2))).reshape(folds, 2, -1)
    return seen[:, :, :-1], seen[:, :, -1]


def _trained(marked: DataFrame, start: list[np.ndarray], epochs: int) -> list[np.ndarray]:
    """Numbers of all networks after ``epochs``; network k learns from all folds but
    k, the last from all.  A shard's rows are met in batches, each in a random order."""
    context, folds = marked.sparkSession.sparkContext, len(start) - 1
    each = [marked.where(F.col("fold") != k).select(F.lit(k).alias("name"), "shard", "toxic", "words") for k in range(folds + 1)]
    state = start
    for e in range(epochs):
        sent = context.broadcast(state)                     # as many networks, whatever the input

        def run(batches, sent=sent, e=e):
            own, trainer, n = None, None, 0
            for b in batches:
                names, shards = b.column("name").to_numpy(), b.column("shard").to_numpy()
                cuts = np.flatnonzero((names[1:] != names[:-1]) | (shards[1:] != shards[:-1])) + 1
                for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                    if i == j:
                        continue
                    if own != (at := (int(names[i]), int(shards[i]))):
                        if n:
                            yield _in_blocks(*own, n, trainer.numbers())
                        own, n, trainer = at, 0, Trainer(_empty()).take(sent.value[at[0]])
                    tokens, y = _decoded(b.slice(i, j - i))
                    trainer.epoch(tokens, y, np.random.default_rng([7, e, at[1], n]))
                    n += j - i
            if n:
                yield _in_blocks(*own, n, trainer.numbers())

        got = _together(reduce(DataFrame.unionAll, each).mapInArrow(run, BLOCK_ROWS), "<f4", mean=True)
        state = [got.get(k, x) for k, x in enumerate(state)]
        sent.unpersist()
    return state


def _empty() -> Network:
    return _start_counted(np.zeros((2, 2 * ROWS + 1)), np.zeros(2))


def _out_of_fold(marked: DataFrame, nets: list[Network]) -> list:
    """``(lang, toxic, z, n)``: how many documents of a language and label have that
    logit, to a step of 1 / BINS, by the network that did not see them."""
    sent = marked.sparkSession.sparkContext.broadcast(nets)

    def run(batches):
        for b in batches:
            tokens, _ = _decoded(b)
            z = np.zeros(len(tokens))
            for i, k in enumerate(b.column("fold").to_pylist()):
                z[i] = sent.value[k].logit(tokens[i])
            z = np.round(np.clip(z, -64, 64) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(z)], ["lang", "toxic", "z"])

    found = marked.select("fold", "toxic", "lang", "words").mapInArrow(run, "lang STRING, toxic INT, z INT")
    return found.groupBy("lang", "toxic", "z").agg(F.count(F.lit(1)).alias("n")).orderBy("z", "toxic", "lang").collect()


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, per_shard: int = 32768,
          least_visits: int = 48000) -> Network:
    """Network from ``docs (doc_id, text, lang)`` and ``labels (doc_id,
    toxic)``.  All labelled documents are counted, trained on and calibrated with.
    Epochs are 6, or fewer, but not below 3, where ``least_visits`` are reached.
    Other labels than 0 and 1 are ignored, an id with both counts as toxic;
    ``lang`` only sets thresholds."""
    marked, n = _marked(docs, labels, folds, per_shard)
    seen, counts = _document_counts(marked, folds)
    if not counts.sum(axis=0).all():
        net = _empty()
        net.weights[:] = 0
        net.shift = 10.0 if counts[:, 1].any() else -10.0
        return net
    others = [np.arange(folds) != k for k in range(folds + 1)]
    start = [Trainer(_start_counted(seen[o].sum(axis=0), counts[o].sum(axis=0))).numbers() for o in others]
    epochs = min(6, max(3, blocks_for(least_visits, max(1, n))))
    nets = [Trainer(_empty()).take(x).net for x in _trained(marked, start, epochs)]
    got = _out_of_fold(marked, nets[:-1])
    _calibrate(nets[-1], np.array([r["z"] / BINS for r in got]), np.array([r["toxic"] for r in got]),
               np.array([r["lang"] or "" for r in got]), np.array([float(r["n"]) for r in got]))
    return nets[-1]


def score(docs: DataFrame, net: Network, keep: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``score``, the ``threshold`` of the row's
    language (the common one if it is null or unknown) and ``rejected``; such
    columns of ``docs`` are replaced.  The score is read from ``text`` alone.

    Null or empty text has the score of a text without words.  With ``keep``,
    only rows that are not rejected are returned, with the columns of ``docs``
    alone.  Repeated rows and null ids are scored like others; an empty table
    gives an empty result.
    """
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
    new = ("score", "threshold", "rejected")
    own = [f for f in docs.schema.fields if keep or f.name not in new]
    schema = StructType(own if keep else [*own, StructField("score", DoubleType()),
                                          StructField("threshold", DoubleType()),
                                          StructField("rejected", BooleanType())])
    model = docs.sparkSession.sparkContext.broadcast(net)      # 2 * ROWS rows, whatever the input

    def run(batches):
        net = model.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                s = net.score([t or "" for t in part.column("text").to_pylist()])
                languages = part.column("lang").to_pylist() if "lang" in part.schema.names else [None] * len(s)
                least = np.array([net.thresholds.get(x, net.default) for x in languages])
                if keep:
                    yield part.filter(pa.array(s < least))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(f.name) for f in own], pa.array(s), pa.array(least), pa.array(s >= least)],
                        schema.names)

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark, sf_dir):
    """Toxicity of every whole text; learned outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    net = learn(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    scored = score(docs.select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out")), net)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
                         "threshold", "rejected")
