"""What the stages leave where it is: texts on their task, words in mind."""

import public_tokenizers
import pytest

import corpus_pipeline
from dendrospark.llm import common, packing

DOCS = [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (1, "a b c d e f", "fr"), (2, "a b c d e f", "en"),
        (None, "a b c d e f", "en"), (3, "quite another text of many words", "en"), (None, "lone words here", "en"),
        (None, "lone words here", "en"), (4, None, "en"), (5, "", None), (3, "and one more under that id", "en")]
KEPT = [(None, "lone words here"), (1, "a b c d e f"), (3, "and one more under that id"),
        (3, "quite another text of many words"), (4, None)]


def _rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [True, False])
def test_near_copies_go_without_a_shuffle_of_other_texts(spark, monkeypatch, small):
    monkeypatch.setattr(corpus_pipeline, "fits_broadcast", lambda rows, size: small)
    docs = spark.createDataFrame(DOCS, "doc_id LONG, text STRING, lang STRING")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and _rows(kept) == sorted(KEPT, key=str)
    plan = kept._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    assert plan.nodeName() == "Union"                       # rows that do not repeat, and the others
    assert "Aggregate" not in plan.children().head().toString()


def test_a_hundred_thousand_words_are_kept_in_mind(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read(), 2)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(100_000)]
    first = encoder.encode([" ".join(words)])
    met = []
    one = encoder._word
    monkeypatch.setattr(encoder, "_word", lambda w: met.append(w) or one(w))
    assert encoder.encode([" ".join(words)]) == first and not met
    assert encoder.encode(["Zz, zz"]) == packing.WordEncoder(encoder.tokenizer.to_str(), 2, keep=1).encode(["Zz, zz"])


def test_other_work_drops_the_encoder():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        packing._encoder(f.read(), 2, True)
    assert packing._encoder.cache_info().currsize == 1
    common.release_memory()
    assert packing._encoder.cache_info().currsize == 0
