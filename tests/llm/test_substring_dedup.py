from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from opslens.llm import suffix_array as SA
from opslens.llm import substring_dedup as D


def brute(rows, window=50):
    """doc -> (n_bytes, n_removed, n_spans, sha256) by looking every string up."""
    first = {}
    for key, text in rows:
        for p in range(len(text) - window + 1):
            s = text[p:p + window]
            first[s] = min(first.get(s, key), key)
    out = []
    for key, text in rows:
        gone = bytearray(len(text))
        for p in range(len(text) - window + 1):
            if first[text[p:p + window]] < key:
                gone[p:p + window] = b"\1" * window
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in D.remove_repeats(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


def agree(spark, rows):
    key = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    want = sorted(((d is not None, d or 0), *w) for (d, _), w in zip(rows, brute(key)))
    assert sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in run(spark, rows)) == want


def test_query_equals_brute_force(spark, sf, texts):
    rows = sorted(texts.items())
    want = {d: w for (d, _), w in zip(rows, brute([(d, (t or "").encode()) for d, t in rows]))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in D.query(spark, sf).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 0


def test_overlaps_shifts_and_ties(spark):
    rng = random.Random(3)
    text = lambda n, k=4: "".join(rng.choice("abcdé"[:k + 1]) for _ in range(n))
    base = text(400)
    rows = [(10, base), (11, base), (5, base[100:149]), (6, base[100:150]), (7, text(30) + base[20:200] + text(9)), (12, base[:60] + "x" + base[61:300]),
            (13, "a" * 300), (14, "ab" * 200), (4, "b" + "ab" * 60), (15, "a" * 51), (16, base[::-1]), (17, base[350:] + base[:49]), (2, text(200, 2)), (3, text(300, 2))]
    agree(spark, rows)


def test_matches_do_not_cross_documents(spark):
    a, b = "x1y2z3w4" * 4, "q9r8s7t6" * 4
    agree(spark, [(1, a), (2, b), (3, a + b)])


def test_nulls_repeated_rows_and_the_empty_table(spark, odd_documents, no_documents):
    passage = "".join(chr(97 + (i * i) % 26) for i in range(200))
    agree(spark, [(None, passage), (3, passage), (3, passage), (None, None), (1, None), (2, ""), (4, "é" * 60), (5, "é" * 60)])
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.where("length(text) < 5000 or text is null").select("doc_id", "text").collect()]
    agree(spark, rows)
    assert D.remove_repeats(odd_documents).count() == odd_documents.count()
    assert D.remove_repeats(no_documents).collect() == []


def test_kept_bytes_are_the_remaining_text(spark):
    passage = "".join(chr(97 + (i * 7 + i * i) % 26) for i in range(120))
    df = spark.createDataFrame([(1, passage), (2, "before " + passage + " after")], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in D.remove_repeats(df).collect()}
    assert kept == {1: passage.encode(), 2: b"before  after"}


def test_a_large_group_of_copies_and_a_common_passage(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, copy = prose(20), prose(40)
    rows = [(i, copy) for i in range(100, 220)] + [(i, prose(8) + " " + passage + " " + prose(8)) for i in range(120)]
    rng.shuffle(rows)
    agree(spark, rows)


def local(rows, shards=4):
    """The steps of remove_repeats without Spark, and what its shards receive."""
    import pyarrow as pa

    def by(tables, column):
        t = pa.concat_tables(tables)
        return {v: t.filter(pa.compute.equal(t.column(column), v)) for v in sorted(set(t.column(column).to_pylist()))}

    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "chunk": pa.array([r[0] % shards for r in rows], pa.int32())})
    chunks = by([docs], "chunk")
    shared = by([D._recurring(t) for t in by([D._grams(shards)(t) for t in chunks.values()], "shard").values()], "chunk")
    sent = by([D._send(shards)(shared[c], t) for c, t in chunks.items()], "shard")
    answers = by([D._answer(t) for t in sent.values()], "chunk")
    out = pa.concat_tables([D._remove(False)(answers[c], t) for c, t in chunks.items()]).to_pylist()
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out], sent


def test_a_hot_gram_does_not_gather_in_one_shard():
    """A short passage with other surroundings in each of 12,000 documents."""
    rng = random.Random(2)
    prose = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = prose(70)
    rows = [(i, prose(60) + passage + prose(60)) for i in range(12_000)]
    got, sent = local(rows)
    assert sorted(got) == [(k, *w) for (k, _), w in zip(rows, brute([(k, t.encode()) for k, t in rows]))]
    assert sum(r[2] for r in got) >= 70 * 11_999
    for t in sent.values():
        grams = np.concatenate([D._unzip(v.as_py(), np.uint64) for v in t.column("gram")])
        assert np.unique(grams, return_counts=True)[1].max(initial=0) <= D.HOT_SEGMENTS + len(t)
    strings = [sum(len(D._unzip(v.as_py(), np.uint64)) for v in t.column("string")) for t in sent.values()]
    assert min(strings) > 0.8 * max(strings)


def test_hot_grams_and_parts_give_the_same_result(monkeypatch, texts):
    rng = random.Random(5)
    rows = [(d, t or "") for d, t in texts.items()]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows += [(10_000_000 + i, "".join(rng.choice("abcdefgh ") for _ in range(i)) + passage + str(i)) for i in range(60)] + [(10_000_100, "a" * 300), (10_000_101, "ab" * 99)]
    want = sorted((k, *w) for (k, _), w in zip(rows, brute([(k, t.encode()) for k, t in rows])))
    for hot, size in ((0, 1), (2, 500), (1 << 30, 1), (1 << 30, 1 << 24)):
        monkeypatch.setattr(D, "HOT_SEGMENTS", hot)
        monkeypatch.setattr(D, "SORT_BYTES", size)
        assert sorted(local(rows)[0]) == want


@pytest.mark.parametrize("letters_each", [0, 64, 1e9])
def test_suffix_arrays_and_common_prefixes(monkeypatch, letters_each):
    monkeypatch.setattr(SA, "LETTERS_EACH", letters_each)
    rng = random.Random(1)
    for t in range(150):
        n, k = rng.choice([1, 2, 3, 8, 30, 200]), rng.choice([1, 2, 3, 26, 256])
        b = bytes(rng.randrange(k) for _ in range(n))
        if t % 3 == 0:
            b = b[:max(1, n // 5)] * 6
        text = np.frombuffer(b, np.uint8)
        order = SA.suffix_array(text)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        lcp = SA.common_prefixes(text, order)
        for i in range(1, len(order)):
            x, y = b[order[i - 1]:], b[order[i]:]
            assert lcp[i] == next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
    assert len(SA.suffix_array(np.zeros(0, np.uint8))) == 0
