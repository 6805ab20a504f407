"""Packing, sharding, BPE, the vector searches and the pipeline."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from dendrospark.llm import bpe, multi_index, packing, sharding, threshold
from dendrospark.llm.common import table

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "  ", "a  ", "a \n b", "\n \n b", "x\n  \ny", "\x1c a", "  c  d  ",
         "日本語 テスト １２3", "\U0001f44d\U0001f3fd  \U0001f44d", "a" * 3000,
         "don't 's 're\t\tq  ", "<|endoftext|> end", "İstanbul ÉTÉ, naïve (x)", "w" + " word" * 30_000]


def text_table(spark):
    rows = [(i if i else None, t, 1, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], "doc_id LONG, text STRING, ids INT, bytes STRING")


# ---------------------------------------------------------------------- packing
def check_packed(rows, ids_of, tokens=4096, segments=256):
    at, padded, total = {}, 0, 0
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        n = sum(r.length for r in pieces)
        assert 0 < n <= tokens and len(pieces) <= segments
        total += n
        padded += n if n & (n - 1) == 0 else tokens
    for r in rows:
        at.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for d, ids in ids_of.items():
        copies = sum(1 for s, *_ in at[d] if s == 0)
        assert sorted(x for s, n, *_ in at[d] for x in range(s, s + n)) == sorted(list(range(len(ids))) * copies)
        raw = np.array(ids, dtype="<u4").tobytes()
        assert all(c == zlib.crc32(raw[4 * s:4 * (s + n)]) and m == len(ids) for s, n, c, m in at[d])
    return padded / total


def test_documents_are_packed_whole_with_little_padding(spark):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids_of = {i if i else None: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)}
    assert check_packed(packing.pack_documents(text_table(spark), path).collect(), ids_of) < 1.01
    docs = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
            for r in table(spark, SF, "documents").collect()}
    assert check_packed(packing.op3_packing(spark, SF).collect(), docs) < 1.01
    assert packing.pack_documents(text_table(spark).limit(0), path).count() == 0


def test_other_tokenizers_take_the_general_path():
    from tokenizers import Tokenizer
    def spec(name):
        with open(P.path(name), encoding="utf-8") as file:
            return file.read()
    assert not packing.WordEncoder(spec("byte_bpe_50k.json"), 2).plain
    own = packing.WordEncoder(spec("word_bpe_49k.json"), 2, keep=3)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [t or "" for t in TEXTS] + [f"x{chr(c)}Y. {chr(c)}!" for c in range(32, 0x2000)]
    want = [np.array([*e.ids, 2], dtype="<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


@pytest.mark.parametrize("loss", [4096, 500])
def test_short_texts_are_packed_without_padding(spark, loss):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'two words' AS text")
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json"), loss=loss).collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    kept = [sum(r.length for r in s) for s in seqs.values()]
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert all(len(s) <= 256 and sum(r.loss_tokens for r in s) <= loss for s in seqs.values())
    assert sum(n if n & (n - 1) == 0 else 4096 for n in kept) < 1.02 * sum(kept)


def test_three_limits_hold_and_bins_are_few(spark):
    rng = np.random.default_rng(11)
    n = rng.integers(0, 900, 3000)
    loss = (n * rng.random(3000)).astype(int)
    df = spark.createDataFrame([(i, int(a), int(b), 0) for i, (a, b) in enumerate(zip(n, loss))],
                               "example_id LONG, n_tokens LONG, n_loss LONG, slot INT").coalesce(1)
    rows = packing.pack_examples(df, 2048, 6, 1000).collect()
    assert sorted(r.example_id for r in rows) == list(range(3000))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        assert sum(r.n_tokens for r in s) <= 2048 and len(s) <= 6 and sum(r.n_loss for r in s) <= 1000
    assert len(seqs) < 1.1 * max(n.sum() / 2048, 3000 / 6, loss.sum() / 1000) + 2


def test_an_example_that_fits_nowhere_is_an_error():
    with pytest.raises(ValueError):
        packing.Packer(100, 4, 10, cut=False).add(packing.Item(0, 0, 50, 20))
    whole = packing.Packer(100, 4, 10).add(packing.Item(0, 0, 50, 20))
    assert all(sum(x.loss for x in s) <= 10 for s in whole)


def test_decoding_of_null_empty_and_unknown_ids(spark):
    ranks = {b"a": 0, b"\xff": 1, b"bc": 5}
    rows = [(1, [0, 5, 1], "x"), (2, [], None), (3, None, "y"), (3, None, "y")]
    df = spark.createDataFrame(rows, "doc_id LONG, ids ARRAY<INT>, bytes STRING")
    got = bpe.decode(df, ranks)
    assert got.columns == ["doc_id", "ids", "bytes"]
    assert sorted((r.doc_id, bytes(r.bytes) if r.bytes is not None else None) for r in got.collect()) == [
        (1, b"abc\xff"), (2, b""), (3, None), (3, None)]
    assert bpe.decode(df.limit(0), ranks).collect() == []
    for ids in ([9], [3], [-1], [None]):
        with pytest.raises(Exception, match="outside the vocabulary"):
            bpe.decode(spark.createDataFrame([(1, ids)], "doc_id LONG, ids ARRAY<INT>"), ranks).collect()


# --------------------------------------------------------------------- sharding
def jump(key, n):
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_jump_hash_of_any_key(spark, shards):
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, *np.random.default_rng(12).integers(-2 ** 62, 2 ** 62, 300).tolist()]
    df = spark.createDataFrame([(k,) for k in keys], "k LONG")
    for r in df.select("k", sharding.jump_shards(F.col("k"), shards).alias("s")).collect():
        assert (r.s.shard, r.s.grown_shard) == (jump(r.k, shards), jump(r.k, shards + 1))
        assert r.s.grown_shard in (r.s.shard, shards)


def test_sharded_rows(spark):
    rows = sharding.shard_documents(text_table(spark), 3, slot_rows=2).collect()
    assert len(rows) == len(TEXTS) + 1 and {r.law for r in rows} == {"key"}
    for r in rows:
        raw = (TEXTS[r.doc_id or 0] or "").encode()
        assert (r.size, r.text_crc32, r.shard) == (len(raw) + 8, zlib.crc32(raw), jump(r.doc_id or 0, 3))
    for s in range(3):
        own = [r.slot for r in rows if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    assert sharding.shard_documents(text_table(spark).limit(0)).count() == 0


# -------------------------------------------------------------------------- BPE
def test_bpe_round_trip(spark):
    import tiktoken
    ranks = bpe.read_ranks(spark, P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(text_table(spark), ranks, P.PATTERN), ranks).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        t = TEXTS[r.doc_id or 0] or ""
        assert r.ids == own.encode_ordinary(t) and bytes(r.bytes) == t.encode()
    assert bpe.encode(text_table(spark).limit(0), ranks, P.PATTERN).count() == 0
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    for r in bpe.op9_byte_bpe(spark, SF).collect():
        ids = own.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_cutting_at_spaces_changes_no_pre_token():
    import itertools
    import regex
    find = regex.compile(P.PATTERN).findall
    for t in map("".join, itertools.product("a1. \n'", repeat=6)):
        s = bpe.Splitter(P.PATTERN)
        got = s.split(t)
        words = [w.decode() for w in s.words()]
        assert "".join(words[i] for i in got) == t
        assert [p for i in got for p in find(words[i])] == find(t), t


# --------------------------------------------------------------- vector searches
def vectors():
    rng = np.random.default_rng(13)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist(), 0.5) for i in range(400)]
    rows += [(i, [1.0, -2.0, 0.0, 3.0, 1.0, 1.0], 0.5) for i in range(400, 520)]
    rows += [(520, None, 0.5), (521, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0.5), (522, [float("nan")] * 6, 0.5),
             (523, [float("inf")] * 6, 0.5), (524, [0.0] * 6, 0.5), (None, [1.0] * 6, 0.5), (525, [1.0, 2.0], 0.5),
             (526, [2.0, 4.0], 0.5), rows[10], rows[400]]
    return rows


def ok(v, zero):
    return v is not None and None not in v and np.isfinite(v).all() and (zero or any(v))


@pytest.mark.parametrize("rows_a_block", [2048, 64])
def test_threshold_algorithm_is_exact(spark, monkeypatch, rows_a_block):
    from dendrospark.llm import vectors as shared
    monkeypatch.setattr(shared, "ROWS_A_BLOCK", rows_a_block)
    df = spark.createDataFrame(vectors(), "id LONG, v ARRAY<DOUBLE>, rank DOUBLE").select("id", "v")
    df = df.where(shared.finite(F.col("v"))).withColumn("v", F.col("v").cast("array<long>"))
    got = {}
    for r in threshold.top_products(df, df.where("id % 20 = 0 OR id = 525"), 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = {i: v for i, v, _ in vectors() if i is not None and ok(v, True)}
    for q in [i for i in rows if i % 20 == 0 or i == 525]:
        want = sorted((-int(np.dot(rows[q], v)), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert threshold.top_products(df.limit(0), df.limit(0)).count() == 0


def test_multi_index_recall_ties_and_gaps(spark):
    df = spark.createDataFrame(vectors(), "id LONG, v ARRAY<DOUBLE>, rank DOUBLE").select("id", "v")
    got = {}
    for r in multi_index.nearest(df, df.where("id % 20 = 0 OR id = 525"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = {i: np.array(v) for i, v, _ in vectors() if i is not None and ok(v, False)}
    hit = total = 0
    for q in [i for i in rows if i % 20 == 0 or i == 525]:
        cos = {i: v @ rows[q] / (np.linalg.norm(v) * np.linalg.norm(rows[q]))
               for i, v in rows.items() if i != q and len(v) == len(rows[q])}
        own = sorted(got[q])
        assert len(own) == min(5, len(cos)) and [r for r, *_ in own] == list(range(1, len(own) + 1))
        assert all(s == pytest.approx(cos[i]) for _, i, s in own)
        least = sorted(cos.values())[-len(own)]
        hit += sum(cos[i] >= least - 1e-9 for _, i, _ in own)
        total += len(own)
    assert hit / total >= 0.9
    assert [i for _, i, _ in sorted(got[400])] == [401, 402, 403, 404, 405]      # ties: the smallest ids


def test_pigeonhole_probing_finds_every_code_within_the_radius():
    codes = np.random.default_rng(14).integers(0, 1 << 63, 500).astype(np.uint64)
    block = multi_index.Block(codes, 64)
    for r in (0, 3, 9, 24, 27, 64):
        for c in codes[:20]:
            assert block.within(c, r).tolist() == np.flatnonzero(np.bitwise_count(codes ^ c) <= r).tolist()


# --------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline as C
    docs = table(spark, SF, "documents")
    assert [n for n, _ in C.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    by = dict(C.STAGES)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "12 -- 3", "en", "s", 6),
                                 (9003, "the of and " * 9, "en", "s", 99), (9003, "the of and " * 9, "en", "s", 99)], docs.schema)
    docs = docs.unionByName(odd).cache()
    known = by["language_id"](spark, docs, SF)
    assert known.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()} == {9001, 9002, None}
    known = known.cache()
    single = by["simhash_near_dedup"](spark, known, SF)
    from dendrospark.llm import simhash
    want = {r.component_id for r in simhash.near_duplicates(known).collect()}
    got = [r.doc_id for r in single.collect()]
    assert single.columns == docs.columns and sorted(got) == sorted(want)
    cut = by["suffix_array_dedup"](spark, single, SF)
    assert cut.columns == docs.columns and cut.count() == len(got)
    assert by["toxicity"](spark, docs, SF).columns == docs.columns
    packed = C.run(spark, SF).collect()
    assert packed and all(r.length > 0 for r in packed)


def test_nameless_groups_keep_one(spark):
    import corpus_pipeline as C
    docs = spark.createDataFrame([(None, "a b c d e", "en", "s", 9), (None, "a b c d e", "en", "s", 9), (7, "x y z", "en", "s", 5),
                                  (None, "x y z", "en", "s", 5), (None, "q r s t", "en", "s", 7)],
                                 "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    assert sorted(r.text for r in C.drop_near_copies(spark, docs, SF).collect()) == ["a b c d e", "q r s t", "x y z"]
