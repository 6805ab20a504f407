"""SimHash by Golay keys, components, and the sparse suffix array, against
brute force."""

import collections
import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dendrospark.llm import simhash, suffix_dedup
from dendrospark.llm.common import scratch
from dendrospark.llm.components import components


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ------------------------------------------------------------------- components
def test_components_chain_star_random(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(150)] + [(200, i) for i in range(201, 260)]
    pairs += [tuple(x) for x in rng.integers(300, 500, (120, 2)).tolist()] + [(7, 7)]
    want = roots(500, pairs)
    got = components(spark.createDataFrame(pairs, "a LONG, b LONG"), scratch(spark, "t")).collect()
    assert len({r.node for r in got}) == len(got)
    assert all(want[r.node] == r.root for r in got)
    assert {r.node for r in got} == {x for a, b in pairs if a != b for x in (a, b)}


def test_components_empty(spark):
    assert components(spark.createDataFrame([], "a LONG, b LONG"), scratch(spark, "t")).count() == 0


# ---------------------------------------------------------------------- SimHash
def test_golay_words_two_bits_apart_share_an_index():
    high, patterns = simhash.golay_tables()
    assert sorted(set((patterns >= 0).sum(axis=1))) == [1, 6]
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 400)
    own = simhash.golay_indices(words, high, patterns)
    for _ in range(40):
        i, j = rng.integers(0, 23, (2, 400))
        other = simhash.golay_indices(words ^ (1 << i) ^ (1 << j), high, patterns)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(own, other))


def near_fingerprints():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    out = set(rng.integers(0, 1 << 63, 60).astype(np.uint64).tolist())
    for b in base.tolist():
        for _ in range(25):
            x = b
            for i in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << i
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("radius, bucket", [(2, 64), (2, 1), (1, 2), (0, 64)])
def test_links_lose_no_connection(spark, radius, bucket):
    fps = np.array(near_fingerprints(), dtype=np.uint64)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i)
             if int(fps[i] ^ fps[j]).bit_count() <= radius]
    assert radius == 0 or len(pairs) > 50
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps.view(np.int64))], "fp LONG, rep LONG")
    got = [(r.a, r.b) for r in simhash.links(df, scratch(spark, "t"), radius, bucket).collect()]
    assert roots(len(fps), got) == roots(len(fps), pairs)


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


WORDS = [f"w{i}" for i in range(400)]


def near_texts():
    rng = np.random.default_rng(4)
    texts = [None, "", " \n\t", "one", "ONE", "two words", "a\x0bb c", "Été été ÉTÉ  x y z"]
    for _ in range(6):
        words = rng.choice(WORDS, 120).tolist()
        for _ in range(8):
            w = list(words)
            for i in rng.integers(0, 120, rng.integers(0, 3)).tolist():
                w[i] = "changed"
            texts.append(" ".join(w))
    return texts + [texts[-1], "long " * 70_000]


def test_near_duplicates_against_brute_force(spark):
    texts = near_texts()
    ids = [None if i == 1 else 1000 - i for i in range(len(texts))]
    rows = [(d, t, 5, "x") for d, t in zip(ids, texts)]
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id LONG, text STRING, fp INT, rep STRING")
    fps = [brute_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = roots(len(fps), pairs)
    smallest = {r: min((ids[i] for i in range(len(ids)) if root[i] == r and ids[i] is not None), default=None)
                for r in set(root)}
    want = collections.Counter((d, f"{fps[i]:016x}", smallest[root[i]]) for i, d in [*enumerate(ids), (len(ids) - 1, ids[-1])])
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert len(pairs) > 20


def test_ids_that_are_null_or_repeat_link_no_texts(spark):
    a, b = "one two three four five six", "completely different words stand here now"
    for other in (None, 7):
        rows = [(5, a), (other, a), (900, b), (other, b)]
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()
        of = {r.fingerprint: r.component_id for r in got}
        want = {simhash.fingerprint(a): 5, simhash.fingerprint(b): 900 if other is None else 7}
        assert of == {f"{f:016x}": c for f, c in want.items()} and len(got) == 4


def test_near_duplicates_empty_and_without_ids(spark):
    empty = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert simhash.near_duplicates(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id LONG, text STRING")
    assert [r.component_id for r in simhash.near_duplicates(nameless).collect()] == [None, None]


# ------------------------------------------------------------------ suffix array
def brute_removed(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        m = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                m[i:i + length] = True
        edge = np.diff(np.concatenate(([0], m.astype(int), [0])))
        out.append((len(r), int(m.sum()), int((edge == 1).sum()),
                    hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~m])).hexdigest()))
    return out


def passages():
    rng = np.random.default_rng(5)
    p = ["".join(rng.choice(list("abcdé "), rng.integers(150, 700))) for _ in range(9)]
    texts = [None, "", "x", "a" * 199, "a" * 200, "a" * 201, "a" * 640, "ab" * 260, "q" * 230 + "ab" * 260,
             p[0], p[0], p[0][:120]]
    for _ in range(70):
        texts.append("".join(rng.choice(list("xyz é"), rng.integers(0, 250))) + p[rng.integers(9)]
                     + "".join(rng.choice(list("uvw"), rng.integers(0, 90))) + p[rng.integers(9)])
    return texts


def digest(row):
    raw = (row.text or "").encode()
    spans = [s.asDict() for s in row.spans]
    return (len(raw), sum(s["b"] - s["a"] for s in spans), len(spans),
            hashlib.sha256(suffix_dedup.kept_bytes(raw, spans)).hexdigest())


@pytest.mark.parametrize("crowd", [4096, 3])
def test_repeats_against_brute_force(spark, crowd):
    texts = passages()
    docs = spark.createDataFrame([(i if i else None, t, 1, "k", "s") for i, t in enumerate(texts)],
                                 "doc_id LONG, text STRING, t1 INT, key STRING, spans STRING")
    got = suffix_dedup.repeats(docs, 200, crowd).collect()
    want = brute_removed(texts)
    assert sorted(digest(r) for r in got) == sorted(want)
    assert all(digest(r) == want[r.doc_id or 0] for r in got)


def test_a_long_text_crosses_segments(spark, monkeypatch):
    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("abcdefgh"), 30_000))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 12)
    found = [(h, s + i) for hs, _, starts, more in suffix_dedup.anchors(long.encode())
             for h, s, m in zip(hs, starts, more) for i in range(m + 1)]
    assert sorted(x for _, x in found) == list(range(30_000 - 199))
    monkeypatch.undo()
    texts = [long, "zz" + long[7_000:29_000], long[100:290]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    want = brute_removed(texts)
    assert all(digest(r) == want[r.doc_id] for r in suffix_dedup.repeats(docs).collect())


def test_without_repeats_keeps_whole_characters_and_counts(spark):
    texts = passages()
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in enumerate(texts)],
                                 "doc_id LONG, text STRING, n_chars LONG")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in got.values())
    for i, (n, removed, _, _) in enumerate(brute_removed(texts)):
        left = len((got[i].text or "").encode())
        assert n - removed <= left <= n - removed + 6 * (removed > 0) * 3
    assert suffix_dedup.without_repeats(docs.where(F.lit(False))).count() == 0
