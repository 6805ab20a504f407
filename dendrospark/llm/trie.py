"""Prefix trie of conversations by ternary search trees.

Every conversation is rebuilt from the first turns of its family's first member
and its own later turns.  A turn is known by the SHA-256 of its role and text,
a conversation by its path, the turns' digests one after the other.  Paths are
range-partitioned and sorted, a hot path spreads by conversation id.  Each batch
of a partition is a shard: its turns are dictionary-encoded, its distinct paths
enter a ternary search tree from the median outwards, and one traversal without
recursion gathers members, leaves and savings.

Only prefixes of a shard's first or last path can be shared with other shards.
Their parts add up by prefix, less what two neighbours counted twice: of the
prefixes that the last path of one shard shares with the first of the next, each
node and its bytes, each child but the root, and the leaf that ends there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import global_rank
from ..session import Scratch
from .common import blocks_for, scratch, table

DIGEST = 32
#: Conversation ids in one row of an ending's list.
ENDS = 512


def turn_key(role: Column, text: Column) -> Column:
    """SHA-256 of a turn: the role's length in bytes, the role, the text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """``(conv_id, path BINARY, sizes ARRAY<INT>)``: the digests and text bytes
    of the first h turns of conversation ``c - c % family`` (all if fewer, none
    if there is none), then of c's own turns after its first h, where h is the
    unsigned CRC-32 of the decimal id modulo ``heads``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_key(role, text).alias("key"), F.octet_length(text).alias("size"))
    # false sorts first: a null turn comes before all others
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "key", "size")
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(place)).alias("own"))
    base = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("lead"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(base, "base", "left")
    made = joined.withColumn("h", h).select("conv_id", F.concat(
        F.slice(F.coalesce("lead", F.slice("own", 1, 0)), F.lit(1), F.col("h")),
        F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))).alias("t"))
    # digests have a fixed length, so their hexadecimal letters can be joined
    path = F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["key"])), ""))
    return made.select("conv_id", path.alias("path"), F.transform("t", lambda t: t["size"]).alias("sizes"))


# ------------------------------------------------------------ ternary search tree
class Tree:
    """A ternary search tree over paths of turn ids.  Every node stands for one
    prefix: ``low`` and ``high`` lead to siblings, ``down`` to the first child."""

    def __init__(self):
        self.turn, self.low, self.high, self.down = [-1], [-1], [-1], [-1]      # node 0: the root prefix
        self.parent, self.depth, self.size = [-1], [0], [0]
        self.members, self.least, self.ends = [0], [None], {}

    def _new(self, turn: int, parent: int, size: int) -> int:
        for column, value in ((self.turn, turn), (self.low, -1), (self.high, -1), (self.down, -1), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.size, size), (self.members, 0), (self.least, None)):
            column.append(value)
        return len(self.turn) - 1

    def _child(self, parent: int, turn: int, size: int) -> int:
        at, link = self.down[parent], (self.down, parent)
        while at >= 0:
            if turn == self.turn[at]:
                return at
            side = self.low if turn < self.turn[at] else self.high
            at, link = side[at], (side, at)
        made = self._new(turn, parent, size)
        link[0][link[1]] = made
        return made

    def insert(self, turns: list[int], sizes: list[int], ids: np.ndarray) -> None:
        """The conversations ``ids`` (ascending), all with this path."""
        at, first, n = 0, int(ids[0]), len(ids)
        steps = [0]
        for turn, size in zip(turns, sizes):
            at = self._child(at, turn, size)
            steps.append(at)
        for at in steps:
            self.members[at] += n
            if self.least[at] is None or first < self.least[at]:
                self.least[at] = first
        self.ends[at] = ids

    def totals(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Children of each node, and of its subtree the leaves, the bytes times
        members, and the bytes.  A node is made after its parent, so going
        backwards meets every subtree before its top."""
        n = len(self.turn)
        children, leaves = [0] * n, [0] * n
        weight = [m * s for m, s in zip(self.members, self.size)]
        once = list(self.size)
        for at in range(n - 1, -1, -1):
            leaves[at] = leaves[at] or 1
            if at:
                up = self.parent[at]
                children[up] += 1
                leaves[up] += leaves[at]
                weight[up] += weight[at]
                once[up] += once[at]
        return children, leaves, weight, once


def median_order(n: int):
    """0 to n-1: the middle, then the middles of both halves, and so on."""
    spans, i = [(0, n)], 0
    while i < len(spans):
        a, b = spans[i]
        i += 1
        if a < b:
            m = (a + b) // 2
            yield m
            spans += [(a, m), (m + 1, b)]


def prefix_digests(path: bytes) -> list[bytes]:
    """SHA-256 of the prefixes of 0, 1, 2, ... turns."""
    h = hashlib.sha256()
    out = [h.digest()]
    for i in range(0, len(path), DIGEST):
        h.update(path[i:i + DIGEST])
        out.append(h.copy().digest())
    return out


NODES = pa.schema([
    ("shard", pa.int64()), ("kind", pa.string()), ("prefix", pa.binary()), ("parent_prefix", pa.binary()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("weight", pa.int64()), ("once", pa.int64()),
    ("ends", pa.string()), ("seq", pa.int64()), ("first_path", pa.binary()), ("last_path", pa.binary()),
    ("first_sizes", pa.list_(pa.int32()))])
DDL = {pa.int64(): "LONG", pa.string(): "STRING", pa.binary(): "BINARY", pa.list_(pa.int32()): "ARRAY<INT>"}


def _listed(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def shard_rows(shard: int, ids: np.ndarray, paths: list[bytes], sizes: list[list[int]]) -> list[tuple]:
    """Rows of ``NODES`` of one shard, whose paths (and ids of equal paths) ascend:
    ``node`` rows, finished but for a parent that other shards may share;
    ``part`` rows of the prefixes of the first and last path; ``ends`` rows with
    the ids of conversations that end there; one ``shard`` row."""
    digests = np.frombuffer(b"".join(paths), dtype=f"S{DIGEST}") if any(paths) else np.zeros(0, f"S{DIGEST}")
    # fixed-width strings drop trailing zero bytes when compared, alike on both sides
    _, turns = np.unique(digests, return_inverse=True)
    at = np.cumsum([0] + [len(p) // DIGEST for p in paths])
    heads = [0] + [i for i in range(1, len(paths)) if paths[i] != paths[i - 1]]
    tails = [*heads[1:], len(paths)]
    tree = Tree()
    for j in median_order(len(heads)):
        i = heads[j]
        tree.insert(turns[at[i]:at[i + 1]].tolist(), sizes[i], ids[i:tails[j]])
    children, leaves, weight, once = tree.totals()
    edge = {}                                  # nodes of the first and last path -> digest of their prefix
    for i in (0, len(paths) - 1):
        node = 0
        for d, digest in enumerate(prefix_digests(paths[i])):
            if d:
                node = tree._child(node, int(turns[at[i] + d - 1]), 0)
            edge[node] = digest
    rows = []
    for node in range(len(tree.turn)):
        up, ends = tree.parent[node], tree.ends.get(node)
        common = (tree.least[node], tree.depth[node])
        counted = (tree.members[node], children[node], leaves[node], weight[node], once[node])
        if node in edge:
            rows.append((shard, "part", edge[node], edge.get(up), *common, None, *counted, None, None, None, None, None))
            for k in range(0, 0 if ends is None else len(ends), ENDS):
                rows.append((shard, "ends", edge[node], *(None,) * 9, _listed(ends[k:k + ENDS]), k // ENDS, None, None, None))
        else:
            digest = hashlib.sha256(b"" if ends is None else _listed(ends).encode()).hexdigest()
            rows.append((shard, "node", None, edge.get(up), *common, tree.least[up], *counted, digest, None, None, None, None))
    rows.append((shard, "shard", *(None,) * 12, paths[0], paths[-1], sizes[0]))
    return rows


def shards(paths: DataFrame, parts: int) -> DataFrame:
    """Rows of all shards: range partitions of the paths, batch by batch."""
    ordered = paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            if b.num_rows:
                rows = shard_rows(shard, b.column("conv_id").to_numpy(), b.column("path").to_pylist(),
                                  b.column("sizes").to_pylist())
                for i in range(0, len(rows), 10_000):
                    columns = zip(*rows[i:i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODES)], schema=NODES)
                shard += 1

    return ordered.mapInArrow(run, ", ".join(f"{f.name} {DDL[f.type]}" for f in NODES))


def corrections(ends: DataFrame) -> DataFrame:
    """What neighbouring shards counted twice: rows ``(prefix, n_children,
    n_leaves, once)`` to add to the parts of the prefixes they share."""
    ranked = global_rank(ends.select("shard", "first_path", "last_path", "first_sizes"), ["shard"])
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("last_path").alias("before"))
    met = ranked.join(before, "rank").select("before", "first_path", "first_sizes")

    def run(batches):
        for b in batches:
            out = []
            for one, two, sizes in zip(*(b.column(c).to_pylist() for c in ("before", "first_path", "first_sizes"))):
                shared = 0
                while (shared + 1) * DIGEST <= min(len(one), len(two)) and (
                        one[shared * DIGEST:(shared + 1) * DIGEST] == two[shared * DIGEST:(shared + 1) * DIGEST]):
                    shared += 1
                leaf = len(one) == shared * DIGEST
                twice = np.concatenate((np.cumsum(sizes[:shared][::-1])[::-1].astype(int), [0])).tolist()
                for d, digest in enumerate(prefix_digests(two[:shared * DIGEST])):
                    # bytes of the shared prefixes below this one and, but for the root, its own
                    out.append((digest, -int(d < shared), -int(leaf), -int(twice[0] if d == 0 else twice[d - 1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
                    ["prefix", "n_children", "n_leaves", "once"])

    return met.mapInArrow(run, "prefix BINARY, n_children LONG, n_leaves LONG, once LONG")


def ending_digests(ends: DataFrame) -> DataFrame:
    """``(prefix, ends_sha256)`` from lists of ids by prefix, shard and number:
    one digest runs through the sorted rows of a prefix, one row at a time."""
    ordered = ends.repartition("prefix").sortWithinPartitions("prefix", "shard", "seq")

    def run(batches):
        prefix, h = None, None
        for b in batches:
            done = []
            for p, text in zip(b.column("prefix").to_pylist(), b.column("ends").to_pylist()):
                if p != prefix:
                    if h is not None:
                        done.append((prefix, h.hexdigest()))
                    prefix, h = p, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()),
                                              pa.array([x for _, x in done], pa.string())], ["prefix", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([prefix], pa.binary()), pa.array([h.hexdigest()])],
                                             ["prefix", "ends_sha256"])

    return ordered.select("prefix", "ends").mapInArrow(run, "prefix BINARY, ends_sha256 STRING")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame, family: int = 5, heads: int = 9, shard_convs: int = 50_000,
                work: Scratch | None = None) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: smallest member
    ``conv_id``, ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes of last turns that
    members beyond the first repeat, over the subtree) and ``ends_sha256``.

    Turns of a conversation are ordered by ``turn``, null first, then by the
    digest of role and text; repeated rows are turns of their own.  Null roles and
    texts are empty; a null ``conv_id`` names no conversation, its rows take no
    part.  A rebuilt conversation without turns is a member of the root.  Other
    columns are ignored.  An empty table has no conversation, so no node.

    ``shard_convs`` conversations make a range partition; a shard is a batch of
    one.  The digests of one conversation (32 bytes a turn) are one row.
    """
    work = work or scratch(turns.sparkSession, "trie")
    paths = work.put(rebuilt(turns, family, heads), "paths")
    rows = work.put(shards(paths, blocks_for(paths.count(), shard_convs)), "rows")
    work.drop("paths")
    of_kind = {k: rows.where(F.col("kind") == k) for k in ("node", "part", "ends", "shard")}
    parts = of_kind["part"]
    none = F.lit(None).cast("long")
    fixed = corrections(of_kind["shard"]).select(
        "prefix", F.lit(None).cast("binary").alias("parent_prefix"), none.alias("conv_id"), none.alias("depth"),
        F.lit(0).cast("long").alias("n_convs"), "n_children", "n_leaves", F.lit(0).cast("long").alias("weight"), "once")
    merged = parts.select(fixed.columns).unionByName(fixed).groupBy("prefix").agg(
        F.max("parent_prefix").alias("parent_prefix"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weight", "once")])
    merged = work.put(merged, "merged")
    saved = (F.col("weight") - F.col("once")).alias("saved_tokens")
    # a boundary node's parent is one too; the root's row answers for all nodes of depth 1
    named = merged.select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("parent_conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    boundary = (merged.join(named, "parent_prefix", "left")
                .join(ending_digests(of_kind["ends"]), "prefix", "left")
                .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved,
                        F.coalesce("ends_sha256", empty).alias("ends_sha256")))
    # by shard and prefix, so that the root's many children do not meet in one task
    here = work.put(parts.select("shard", "prefix").join(merged.select("prefix", "conv_id"), "prefix").select(
        "shard", F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("shared")), "here")
    inner = of_kind["node"].where("parent_prefix IS NULL").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, F.col("ends").alias("ends_sha256"))
    below = of_kind["node"].where("parent_prefix IS NOT NULL").join(here, ["shard", "parent_prefix"]).select(
        "conv_id", "depth", F.col("shared").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved,
        F.col("ends").alias("ends_sha256"))
    return inner.unionByName(below).unionByName(boundary).select(COLUMNS)


def op13_conversation_trie(spark, sf_dir):
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal ids byte by byte, prefixes as text, every node with all its ancestors.
ORACLE = """
WITH bits AS (
  SELECT list_transform(range(256), lambda i:
           list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]), lambda c, z:
             CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS r
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'k': sha256(r), 'b': strlen(text)} ORDER BY turn NULLS FIRST, sha256(r)) AS own
  FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, own, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(conv_id::VARCHAR)),
           lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1)))),
           lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8))) % 9 AS h
  FROM own, bits),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.own[:c.h], []) || c.own[c.h + 1:] AS t
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
chains AS (
  SELECT conv_id, len(t) AS n, array_to_string([x.k FOR x IN t], '') AS path, [x.b FOR x IN t] AS b FROM rebuilt),
reach AS (SELECT *, unnest(range(n + 1)) AS d FROM chains),
nodes AS (
  SELECT substr(path, 1, 64 * d) AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE any_value(b[d]) END AS bytes,
         sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM reach GROUP BY substr(path, 1, 64 * d), d),
family AS (
  SELECT n.*, u.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.p = substr(n.p, 1, 64 * (n.d - 1))
  LEFT JOIN (SELECT substr(p, 1, 64 * (d - 1)) AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL) k
    ON k.p = n.p AND k.d = n.d),
under AS (
  SELECT substr(p, 1, 64 * a) AS p, a AS d, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM family) GROUP BY substr(p, 1, 64 * a), a)
SELECT conv_id, f.d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM family f JOIN under u ON u.p = f.p AND u.d = f.d
"""
