"""Classifiers and the language model: held-out quality, whole texts, cases."""

import base64
import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dendrospark.llm import class_lm, langid, toxicity
from dendrospark.llm.common import scratch, table

SF = "/root/testdata/sf0.01"
CASES = [(None, None, None), (1, "", "en"), (2, "12 34 --", None), (3, "The of and", "xx"),
         (4, "the word " * 60_000, "en"), (4, "the word " * 60_000, "en"), (5, "İß \U0001d518 x", None)]
CASE_SCHEMA = "doc_id LONG, text STRING, lang STRING"


def crc(d, n):
    return zlib.crc32(str(d).encode()) % n


# --------------------------------------------------------------------- language
def brute_language(text, p):
    counts = collections.Counter()
    word = " "
    for ch in text.lower() + " ":
        if ch.isalpha():
            word += ch
        elif word != " ":
            word += " "
            for n in (1, 2, 3):
                for i in range(len(word) - n + 1):
                    g = word[i:i + n]
                    if g.strip():
                        counts[g] += 1
            word = " "
    packed = {sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)): n for g, n in counts.items()}
    top = sorted(packed, key=lambda g: (-packed[g], g))[:p.size]
    if not top:
        return "und", 0.0
    away = []
    for k in range(len(p.languages)):
        rank = {g: r for g, r in zip(p.grams.tolist(), p.ranks[:-1, k].tolist()) if r < p.size}
        away.append(sum(abs(rank[g] - i) if g in rank else p.size for i, g in enumerate(top)))
    best = min(range(len(away)), key=away.__getitem__)
    return p.languages[best], 1 - away[best] / (p.size * len(top))


@pytest.fixture(scope="module")
def profiles(spark):
    return langid.learn(table(spark, SF, "documents").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def test_languages_of_held_out_documents(spark):
    got = langid.op4_language_id(spark, SF).collect()
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]) > 0.97


def test_out_of_place_distance_against_brute_force(spark, profiles):
    texts = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").limit(40).collect()]
    for t in [*texts, "a", "A b a B", "l'été 42 naïve", "日本語"]:
        name, score = langid.classify(t, profiles)
        want, share = brute_language(t, profiles)
        assert name == want and score == pytest.approx(share)


def test_language_cases(spark, profiles):
    docs = spark.createDataFrame([(*r, "own") for r in CASES], CASE_SCHEMA + ", score STRING")
    got = langid.identify(docs, profiles).collect()
    assert len(got) == len(CASES) and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    kept = langid.identify(docs, profiles, keep_from=0.0)
    assert kept.columns == docs.columns and kept.count() == 4
    assert langid.identify(docs.limit(0), profiles).count() == 0
    nothing = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


FOREIGN = {
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni "
              "rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "turkish": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve "
               "birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu "
               "järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "russian": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "letters": " ".join("".join(np.random.default_rng(k).choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for k in range(60)),
    "base64": base64.b64encode(np.random.default_rng(2).bytes(600)).decode(),
    "digits": "0123 456 -- 789",
}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", SF])
def test_pipeline_drops_foreign_and_junk_texts_alone(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    planted = spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(FOREIGN.values())], CASE_SCHEMA)
    all_docs = docs.union(planted.select(*docs.columns))
    kept = {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, all_docs, sf).select("doc_id").collect()}
    assert [n for i, n in enumerate(FOREIGN) if -1 - i in kept] == []
    own = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(own - kept) <= len(own) / 500


# --------------------------------------------------------------------- toxicity
def test_toxicity_of_held_out_documents(spark):
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, SF).collect()}
    labels = [r for r in table(spark, SF, "labels").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert len(got) == table(spark, SF, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    bad = [got[r.doc_id].score for r in labels if r.toxic == 1]
    fine = [got[r.doc_id].score for r in labels if r.toxic == 0]
    assert np.mean([(b > f) + 0.5 * (b == f) for b in bad for f in fine]) > 0.85


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        w = rng.choice(words, 30).tolist()
        if i % 4 == 0:
            w[rng.integers(30)] = "vile"
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return toxicity.fit(texts, labels, ["en"] * 300 + ["fr"] * 100, [1.0] * 400)


def test_one_word_decides_wherever_it_stands(net):
    rng = np.random.default_rng(9)
    clean = " ".join(rng.choice([f"word{i}" for i in range(300)], 3 * toxicity.PIECE).tolist())
    for text, toxic in ((clean, 0), ("vile " + clean, 1), (clean + " vile", 1), ("Vile!", 1), ("", 0)):
        assert (net.score([text])[0] >= 0.5) == toxic, text[-20:]
    assert set(net.thresholds) == {"en", "fr"}


def test_pieces_and_batches_do_not_change_a_score(net, monkeypatch):
    texts = ["word1 word2 vile word3 " * 40, "", "word7", "word1 word2 " * 99]
    whole = net.score(texts)
    monkeypatch.setattr(toxicity, "PIECE", 16)
    assert np.allclose(net.score(texts), whole, atol=1e-5)
    assert np.allclose([net.score([t])[0] for t in texts], whole, atol=1e-5)


def test_toxicity_cases(spark, net):
    docs = spark.createDataFrame([(*r, "own") for r in CASES], CASE_SCHEMA + ", threshold STRING")
    got = toxicity.score(docs, net).collect()
    assert len(got) == len(CASES) and len({r.score for r in got if not r.text}) == 1
    assert all(r.rejected == (r.score >= r.threshold) for r in got)
    kept = toxicity.score(docs, net, keep=True)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    one = docs.select("doc_id", F.lit(0).alias("toxic"))
    assert {r.predicted for r in toxicity.score(docs, toxicity.learn(docs, one)).selectExpr("int(score >= 0.3) AS predicted").collect()} == {0}


def test_threshold_of_the_best_f1_may_lie_below_an_even_chance():
    rng = np.random.default_rng(3)
    y = (rng.random(4000) < 0.2).astype(int)
    z = rng.normal(1.5 * y, 1.0)                     # overlapping scores: the best F1 is far from 1
    net = toxicity.Network(np.zeros((1, 1)), [], [], np.zeros(0))
    toxicity._calibrate(net, z, y, np.array(["en"] * 4000), np.ones(4000))
    score = net.probability(z)

    def f1(at):
        return 2 * (y * (score >= at)).sum() / (y.sum() + (score >= at).sum())

    assert net.thresholds["en"] < 0.5
    assert f1(net.thresholds["en"]) == pytest.approx(max(map(f1, score)))
    assert f1(net.thresholds["en"]) > f1(0.5)


# --------------------------------------------------------------- language model
def test_base_score_and_gain_on_held_out(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: r for r in class_lm.op5_class_lm(spark, SF).collect()}
    c = collections.Counter()
    for d, t in docs:
        if crc(d, 10):
            c.update(class_lm.tokens(t or ""))
    n, v = sum(c.values()), len(c)
    for d, t in docs:
        own, r = class_lm.tokens(t or ""), got[d]
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (
            len(own), sum(c[w] > 0 for w in own), n, crc(d, 10) == 0)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_corpus():
    rng = np.random.default_rng(10)
    rows = []
    for i in range(120):
        own = [f"{'ab'[i % 2]}{k}" for k in rng.zipf(1.6, 60) % 40]
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("bounds", [{}, {"common": 12, "units": 8, "suffixes": 3}])
def test_model_is_a_distribution_however_small_the_tables(spark, bounds):
    docs = spark.createDataFrame(small_corpus(), "doc_id LONG, text STRING").withColumn("held_out", F.lit(False))
    work = scratch(spark, "t")
    model, counts = class_lm.learn(docs, work, n_classes=4, sweeps=3, **bounds)
    c = {bytes(r.word): r.n for r in counts.collect()}
    units = class_lm.Encoder(model.vocabulary).encode(list(c))[1]
    for a in range(4):
        p = sum((n + 0.1) * 10 ** model.mix[a, model.classes[u]] for n, u in zip(c.values(), units))
        assert 0.97 < p < 1.0
    got = {r.doc_id: r for r in class_lm.score(docs, model, counts, work).collect()}
    encoder = class_lm.Encoder(model.vocabulary)
    for d, t in small_corpus():
        own = class_lm.tokens(t)
        cls = model.classes[encoder.encode(own)[1]]
        want = sum(np.log10(c[w] + 0.1) for w in own) + sum(
            model.mix[x, y] for x, y in zip([model.end_class, *cls[:-1]], cls))
        assert got[d].score == pytest.approx(want)
        assert got[d].perplexity == pytest.approx(10 ** (-want / len(own)))


@pytest.mark.parametrize("bounds", [{}, {"common": 12, "units": 8, "suffixes": 3}, {"common": 40, "units": 8, "suffixes": 0}])
def test_every_word_has_the_class_of_the_best_gain(spark, bounds):
    corpus = [(d, t, d % 10 == 0) for d, t in [*small_corpus(), (120, None), (121, "a1 b2 zzza3 zzzqqqq a1"), (130, "new 9zza1 a1")]]
    docs = spark.createDataFrame(corpus, "doc_id LONG, text STRING, held_out BOOLEAN").repartition(3)
    work = scratch(spark, "t")
    known = docs.where("NOT held_out")
    start, counts = class_lm.learn(known, work, n_classes=4, sweeps=3, **bounds)
    model, table_ = class_lm.classes_of_words(known, start, work)
    c = {bytes(r.word): r.n for r in counts.collect()}
    v, encoder = model.vocabulary, class_lm.Encoder(model.vocabulary)
    units = dict(zip(c, encoder.encode(list(c))[1]))
    stand_in = {w: int(start.classes[u]) for w, u in units.items()}
    texts = [class_lm.tokens(t or "") for _, t, h in corpus if not h]
    pairs = [(x, y) for t in texts for x, y in zip([class_lm.END, *t], t)]
    after, before = np.zeros((4, 4)), np.zeros((4, 4))
    around = {w: np.zeros(8) for w in c}
    for x, y in pairs:
        after[stand_in[x], stand_in[y]] += 1
        before[stand_in[y], stand_in[x]] += 1
        around[x][stand_in[y]] += 1
        around[y][4 + stand_in[x]] += 1
    want = {}
    for w in c:
        if w in v.words[:v.n_units]:
            want[w] = stand_in[w]
            continue
        r, f, own, gain = around[w][:4], around[w][4:], stand_in[w], []
        for k in range(4):
            less = k == own
            gain.append(r @ np.log(after[k] - less * r + 0.5) + f @ np.log(before[k] - less * f + 0.5)
                        - 2 * r.sum() * np.log(after[k].sum() - less * r.sum() + 1))
        want[w] = int(np.argmax(gain))
    got = dict(zip(v.words, model.own.tolist()))
    assert {w: got[w] for w in v.words} == {w: want[w] for w in v.words}
    least = int(v.counts[-1]) if len(v.counts) else v.n + 1
    rows = {bytes(r.word): r for r in table_.collect()}
    rest = {w: r for w, r in rows.items() if w == class_lm.END or not w.startswith(class_lm.END)}
    assert {w: (r.n, r["class"]) for w, r in rest.items()} == {w: (n, want[w]) for w, n in c.items() if n < least}

    # the transitions are those of the words' own classes, and the model is a distribution
    after, mass, kinds = np.zeros((4, 4)), np.zeros(4), np.zeros(4)
    for x, y in pairs:
        after[want[x], want[y]] += 1
    for w, n in c.items():
        mass[want[w]] += n
        kinds[want[w]] += 1
    assert model.mix == pytest.approx(class_lm.mixed(v, after, mass, kinds, 0.9))
    assert all(0.97 < sum((n + 0.1) * 10 ** model.mix[a, want[w]] for w, n in c.items()) < 1 for a in range(4))

    # a word that was never seen: the class of its ending, that of a unit or else of most of its tokens
    def class_of(w):
        if w in want:
            return want[w]
        if w[-4:] in encoder.suffix or class_lm.END + w[-4:] not in rows:
            return int(start.classes[encoder.unit(w)])
        return rows[class_lm.END + w[-4:]]["class"]
    scores = {r.doc_id: r for r in class_lm.score(docs, model, table_, work).collect()}
    for d, t, _ in corpus:
        own = class_lm.tokens(t or "")
        cls = [class_of(w) for w in own]
        logs = sum(np.log10(c.get(w, 0) + 0.1) for w in own)
        assert scores[d].score == pytest.approx(logs + sum(
            model.mix[x, y] for x, y in zip([want[class_lm.END], *cls[:-1]], cls)))
        assert scores[d].n_known == sum(w in c for w in own)


def test_rare_words_of_one_ending_part_by_their_neighbours(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"u u {f'left{x}same' if x < 40 else 'lake'} w w {f'right{y}same' if y < 40 else 'rock'}"
                         for x, y in rng.integers(0, 120, (10, 2)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    work = scratch(spark, "t")
    model, _ = class_lm.learn(docs, work, n_classes=6, sweeps=3, units=5)
    model, _ = class_lm.classes_of_words(docs, model, work)
    names = collections.defaultdict(collections.Counter)
    for w, k in zip(model.vocabulary.words, model.own):
        if w.endswith(b"same"):
            names[w[:1]][int(k)] += 1
    assert set(names) == {b"l", b"r"} and not set(names[b"l"]) & set(names[b"r"])


def test_exchange_raises_the_likelihood_and_finds_the_languages(spark):
    docs = spark.createDataFrame(small_corpus(), "doc_id LONG, text STRING")
    v = class_lm.vocabulary(class_lm.count_words(docs), 1000, 1000, 4)
    corpus = class_lm.encoded_corpus(docs, v).cache()
    end = v.words.index(class_lm.END)

    def likelihood(classes):
        g = np.zeros((3, 3))
        np.add.at(g, classes, class_lm.neighbours(corpus, classes, 3, end)[:, :3].astype(float))
        m = g.sum(axis=1)
        return (g[g > 0] * np.log(g[g > 0])).sum() - 2 * (m[m > 0] * np.log(m[m > 0])).sum()

    classes = np.arange(v.units) % 3
    first = likelihood(classes)
    for _ in range(4):
        classes = class_lm.exchange(class_lm.neighbours(corpus, classes, 3, end), classes, 3)
    assert likelihood(classes) > first
    names = collections.defaultdict(collections.Counter)
    for w, n, k in zip(v.words, v.counts, classes):
        if w != class_lm.END:
            names[k][w[:1]] += int(n)
    assert sum(max(x.values()) for x in names.values()) > 0.9 * sum(sum(x.values()) for x in names.values())


def test_language_model_cases(spark):
    docs = spark.createDataFrame([(d, t, False, "own") for d, t, _ in CASES], "doc_id LONG, text STRING, held_out BOOLEAN, word STRING")
    work = scratch(spark, "t")
    model, counts = class_lm.learn(docs, work, n_classes=4, sweeps=1)
    got = class_lm.score(docs, model, counts, work).collect()
    assert len(got) == len(CASES) and all(r.n_known == r.n_tokens for r in got)
    empty = {d for d, t, _ in CASES if not (t or "").split()} - {d for d, t, _ in CASES if (t or "").split()}
    assert empty and {r.n_tokens for r in got if r.doc_id in empty} == {1}
    none, no_counts = class_lm.learn(docs.limit(0), scratch(spark, "t"), n_classes=4)
    got = class_lm.score(docs, none, no_counts, scratch(spark, "t")).collect()
    assert all(r.n_known == 0 and r.base_score == pytest.approx(0) and np.isfinite(r.score) for r in got)
    assert class_lm.score(docs.limit(0), model, counts, scratch(spark, "t")).count() == 0
