from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.llm import token_counts as tc

SIGNS = [*"ab  eT\n\r\t09²½Ⅷ_-.,;)('\"▁ 　漢字éßя\x00\x1f😀́", "<s>", "</s>", "<0x0A>", "<unk>", " the", " and", "\r\n", "   "]


@pytest.fixture(scope="module")
def whole():
    """Tokens of a whole text, by the library itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tc.model_path())
    return lambda text: len(model.encode(text or ""))


def test_query_equals_library(spark, sf, texts, whole):
    df = tc.query(spark, sf)
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == df.count() == len(texts)
    for doc, text in texts.items():
        assert got[doc]["n_tokens"] == whole(text)
        assert got[doc]["n_bytes"] == len((text or "").encode())
        assert got[doc]["over_limit"] == (whole(text) > 4096)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=20), st.text(max_size=12))
def test_any_text(whole, signs, other):
    other = other.encode("utf-8", "ignore").decode()
    words = tc.vocabulary(tc.model_path())
    for text in ("".join(signs), other, "".join(signs) + other):
        assert words.count([words.split(text)], {}) == [whole(text)]


def test_first_tier_changes_nothing(spark, texts, whole):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    want = {d: whole(t) for d, t in texts.items()}
    for rows in (1, 50, 65_536):
        assert {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(docs, tc.model_path(), rows=rows).collect()} == want


def test_frequent_pre_tokens(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(("often", "seen", "also", f"once{i}x{j}")) for j in range(200))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    assert set(tc.frequent_pre_tokens(docs, rows=3)) == {"often", "seen", "also"}
    # a counter that keeps dropping its rarest still finds them
    assert set(tc.frequent_pre_tokens(docs, rows=3, summary_rows=8, counter_rows=400)) == {"often", "seen", "also"}


def test_full_cache(whole, monkeypatch):
    monkeypatch.setattr(tc, "CACHE_ROWS", 5)
    words = tc.Vocabulary(tc.model_path())
    batch = [f"word{i} next{i % 3} {'y' * i}" for i in range(100)]
    for _ in range(2):
        assert words.count([words.split(t) for t in batch], {}) == [whole(t) for t in batch]
        assert len(words._cache) <= 5


def test_odd_rows(spark, odd_documents, no_documents, whole):
    extra = spark.createDataFrame([(None, "z" * 200_000), (70, " lead and trail "), (71, "a  b   c"), (72, " "), (72, " "), (73, "▁▁low▁line")], "doc_id long, text string")
    docs = odd_documents.unionByName(extra, allowMissingColumns=True)
    got = sorted(tuple(r) for r in tc.count_tokens(docs, tc.model_path(), limit=10).select("n_bytes", "n_tokens", "over_limit").collect())
    want = sorted((len((r["text"] or "").encode()), whole(r["text"]), whole(r["text"]) > 10) for r in docs.select("text").collect())
    assert got == want
    assert tc.count_tokens(docs, tc.model_path()).where("doc_id IS NULL").count() == docs.where("doc_id IS NULL").count()
    assert tc.count_tokens(no_documents, tc.model_path()).count() == 0
