from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from opslens.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return t


def check(rows, texts, tokenizer, seq_len=1024):
    """Every document's ids, exactly once; sequences without gaps or overflow."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, p in enumerate(sorted(by_doc[doc], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at)
            assert k == 0 or p["length"] == seq_len
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= seq_len
    return len(by_seq)


def test_query_round_trip(spark, sf, texts, tokenizer):
    rows = packing.query(spark, sf).collect()
    used = check(rows, texts, tokenizer)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_ids_equal_the_tokenizers_library(tokenizer):
    encode = packing._encoder(packing.tokenizer_path())
    for text in ["", " ", "a<|endoftext|>b", "it's  3 o'clock\n\n\n  x", "漢字✓é ", "x" * 3000, " " * 5000 + "y", "\r\n\t z"]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_cut_points(n, want):
    assert packing.cut_points(n) == want


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_few_sequences(seed):
    rng = random.Random(seed)
    counts = Counter(min(64, max(1, int(rng.lognormvariate(2.5, 1.0)))) for _ in range(rng.choice([1, 10, 500, 20_000])))
    bins = packing.plan(counts, 64)
    used = Counter()
    for pattern, k in bins.items():
        assert sum(pattern) <= 64 and k > 0
        for n in pattern:
            used[n] += k
    assert used == counts
    least = -(-sum(n * c for n, c in counts.items()) // 64)
    assert sum(bins.values()) <= 1.25 * least + 1


def test_a_hot_length_is_ranked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 16)
    rows = [(i, 0, 0, 7 if i % 3 else 5, 0) for i in range(900)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    placed = packing.place(pieces, 12).collect()
    spots = {(r["sequence_id"], r["offset"]) for r in placed}
    assert len(spots) == 900 and len({s for s, _ in spots}) == 600


def test_odd_rows(spark, odd_documents, no_documents, tokenizer):
    out = packing.pack(odd_documents.where("doc_id is not null").dropDuplicates(["doc_id"]), packing.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect() if r["doc_id"] is not None}
    rows = out.collect()
    check(rows, texts, tokenizer)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert packing.digest(odd_documents).where("doc_id is null").count() == 1
    assert packing.digest(no_documents).collect() == []
