"""Fill-in-the-middle, the neighbour vote on quality and the conversation trie."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.llm import fim, quality, trie
from dendrospark.llm.common import table

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a", " a  b\n", "one two three four", "\x1c x\x0b\x0cy \x85 z", "日本語 テスト １2３ \U0001f44d\U0001f3fd q",
         "has <P> in it", "ends with <", "x <S", "<M>", "> y", "zwei drei " * 9, "w" + " word" * 40_000, "same text", "same text"]


def arranged(doc_id, text, rate=50, spm=80):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 50), (100, 0), (0, 100)])
def test_texts_are_reordered_and_restored(spark, rate, spm):
    rows = [(100 * k + i, t, i, "x", "y") for k in range(3) for i, t in enumerate(TEXTS)]
    rows += [(None, "a null id is a seed too", 0, "x", "y"), (-7, "minus seven", 0, None, None), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, n INT, output STRING, row STRING")
    got = fim.fill_in_middle(df, 42, rate, spm)
    assert got.columns == ["doc_id", "text", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(back) == len(rows)
    for r in back:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == arranged(r.doc_id, r.text, rate, spm)
        assert r.back == (r.text or "")
    assert sorted((r.doc_id or 0, r.text or "") for r in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    forms = {r.form for r in back}
    assert forms >= ({"plain"} if rate < 100 else set()) | ({"spm"} if rate and spm else set())
    assert fim.fill_in_middle(df.limit(0)).collect() == []


def test_slices_of_long_texts_give_the_same(spark, monkeypatch):
    import pyarrow as pa
    from dendrospark.llm.common import byte_slices
    b = pa.RecordBatch.from_arrays([pa.array(["aaaa", None, "", "b" * 50, "cc", "dd"])], ["text"])
    assert [s.num_rows for s in byte_slices(b, "text", 6)] == [3, 1, 2]
    assert [s.num_rows for s in byte_slices(b.slice(1), "text", 52)] == [4, 1]
    assert list(byte_slices(b.slice(0, 0), "text")) == []


# ------------------------------------------------------------- neighbour quality
def auc(scores, labels):
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    ranks, i = {}, 0
    while i < len(order):
        j = i
        while j < len(order) and scores[order[j]] == scores[order[i]]:
            j += 1
        for k in order[i:j]:
            ranks[k] = (i + j + 1) / 2
        i = j
    pos = [ranks[i] for i, y in enumerate(labels) if y == 1]
    n1, n0 = len(pos), len(labels) - len(pos)
    return (sum(pos) - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aB3! .|é\n"), rng.integers(0, 200))) for _ in range(90)]
    terms = np.stack([quality.counts(t) for t in texts])
    y, w = rng.integers(0, 2, 60), rng.random(60) + 0.5
    model = quality.fit(terms[:60], y, w, size=12, neighbours=7)
    own = [model.latent(terms[i:i + 1])[0].astype(float) for i in range(90)]
    for block in (5, 60):
        near, rows = model.nearest(model.latent(terms[60:]), block)
        for i in range(30):
            cos = [sum(a * b for a, b in zip(own[60 + i], v)) for v in own[:60]]
            want = sorted(range(60), key=lambda j: (-round(cos[j], 6), j))[:7]
            assert np.allclose(sorted(near[i]), sorted(cos[j] for j in want), atol=2e-6)
            assert np.allclose(near[i], [cos[j] for j in rows[i]], atol=2e-6) and len(set(rows[i])) == 7
            votes = [max(near[i][k], 0) ** 8 * w[j] for k, j in enumerate(rows[i])]
            share = sum(v for v, j in zip(votes, rows[i]) if y[j]) / sum(votes) if sum(votes) else model.prior
            assert abs(model.score([texts[60 + i]])[0] - share) < 1e-6


def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = quality.op12_neighbour_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert auc([r.score for r in held], [r.quality for r in held]) > 0.985
    low = [r for r in held if r.quality == 0]
    assert sum(r.predicted == 0 for r in low) >= 0.95 * len(low)
    assert sum(r.predicted == 1 and r.quality == 1 for r in held) >= 0.99 * (len(held) - len(low))
    assert len(rows) == labels.join(docs, "doc_id").count()


def test_quality_cases(spark):
    good, bad = "Das ist ein Satz mit Wörtern. Noch einer folgt dann.", "BUY!! NOW!! BUY!! NOW!! $$$ $$$"
    rows = [(1, good, 5.0, "s"), (2, bad, None, "s"), (3, None, None, None), (4, "", None, None), (None, good, None, None),
            (5, bad + " " + "x" * 200_000, None, None), (6, "long words " * 50_000, None, None), (2, bad, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, score DOUBLE, source STRING")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (4, 7), (99, 1)], "doc_id LONG, quality INT")
    model = quality.learn(docs, labels)
    assert model.labels.tolist().count(0) == 2 and len(model.labels) == 3        # both rows of id 2 vote, as 0
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "source", "score"}
    by = {}
    for r in out:
        by.setdefault((r.doc_id, r.text), set()).add(r.score)
    assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in by.values())
    assert by[1, good] == by[None, good] and min(by[1, good]) > 0.5 > max(by[2, bad])
    assert by[3, None] == by[4, ""]
    nothing = quality.learn(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    only = quality.learn(docs, labels.where("doc_id = 1"))
    assert {r.score for r in quality.score(docs, only).collect()} == {1.0}
    assert quality.score(docs.limit(0), model).collect() == []


# ------------------------------------------------------------- conversation trie
def plain_trie(rows, family=5, heads=9):
    """All nodes from dictionaries of whole prefixes."""
    def key(role, text):
        role, text = (role or "").encode(), (text or "").encode()
        return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, key(role, text), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    nodes = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        chain = tuple(own.get(base, [])[:h] + x[h:])
        for d in range(len(chain) + 1):
            nodes.setdefault(chain[:d], []).append((c, d == len(chain)))
    children = {p: {q for q in nodes if len(q) == len(p) + 1 and q[:len(p)] == p} for p in nodes}
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c, last in members if last)))
        out.append((min(c for c, _ in members), len(p), min(c for c, _ in nodes[p[:-1]]) if p else None, len(members),
                    len(children[p]), sum(not children[q] for q in under),
                    sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turns_df(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "conv_id LONG, turn LONG, role STRING, text STRING, path STRING, size INT")


def some_turns(seed, convs=60):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(np.arange(-convs // 4, convs)).tolist():
        same = rng.random() < 0.35                               # a hot group of copies
        for t in range(3 if same else rng.integers(0, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else None, "hello" if same else rng.choice(["a", "é", "", None, "bb"])))
    rows += [(None, 0, "user", "lost"), (7, None, "system", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie"),
             (7, 0, "user", "other"), (1000, 0, "user", "w " * 60_000), (1001, 0, "user", "w " * 60_000),
             (2 ** 62, 0, "ab", "c"), (2 ** 62 + 1, 0, "a", "bc")]
    return rows


@pytest.mark.parametrize("batch", [1, 2, 7, 10_000])
def test_trie_of_any_shards(spark, batch):
    rows = some_turns(batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = trie.prefix_trie(turns_df(spark, rows), shard_convs=20)
        assert got.columns == trie.COLUMNS
        assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trie_of_long_copied_and_missing_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (3, 5, 8, 10) for t in range(0 if c == 3 else 150)] + [(3, 1, None, None)]
    got = trie.prefix_trie(turns_df(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)
    assert trie.prefix_trie(turns_df(spark, rows).limit(0)).collect() == []
    # conversations that lose all their turns are members of the root
    for c in (5 * i + j for i in range(40) for j in (1, 2, 3, 4)):
        if zlib.crc32(str(c).encode()) % 9 > 0:
            got = trie.prefix_trie(turns_df(spark, [(c, 0, "user", "x")])).collect()
            assert [tuple(r) for r in got] == plain_trie([(c, 0, "user", "x")])
            assert [(r.depth, r.n_convs, r.n_leaves) for r in got] == [(0, 1, 1)]
            break


def test_median_insertion_balances_the_tree():
    n = 1023
    assert sorted(trie.median_order(n)) == list(range(n))
    tree = trie.Tree()
    for i in trie.median_order(n):
        tree.insert([i], [1], np.array([i]))
    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.low[at]), height(tree.high[at]))
    assert height(tree.down[0]) == 10 and tree.members[0] == n
