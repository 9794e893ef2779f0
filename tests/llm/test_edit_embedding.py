from __future__ import annotations

import hashlib
import random

import numpy as np

from opslens.llm import edit_embedding as E


def walk(text: str) -> dict[int, int]:
    """The emitted symbols of one text at the sampled steps, step by step."""
    symbols = [(ord(c) * 2654435761 >> 8) % 255 for c in text]
    out, i, step = {}, 0, 0
    sampled = set(E.STEPS.tolist())
    while i < len(symbols) and step < 100_000:
        if step in sampled:
            out[step] = int(E._DIGIT[symbols[i]])
        i += int(E._moves(step // E.BLOCK)[step % E.BLOCK][symbols[i]])
        step += 1
    return out


def test_digits_equal_the_walk_of_each_text():
    texts = ["", "a", "hello wörld ✓", "ab" * 40, "漢字" * 9, "x" * 300]
    found = E.digits(texts)
    for row, text in zip(found, texts, strict=True):
        want = walk(text)
        for slot, value in enumerate(row):
            assert value == want.get(int(E.STEPS[slot]), E.NONE)


def test_edits_lower_the_likeness_little_by_little():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    base = [rng.choice(words) for _ in range(1500)]
    def edited(n):
        out = list(base)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice(words)
        return " ".join(out)
    texts = [" ".join(base), edited(2), edited(20), edited(200), " ".join(rng.choice(words) for _ in range(1500))]
    found = E.digits(texts)
    like = E.likeness(found, np.repeat(found[:1], len(texts), axis=0))
    assert like[0] == 1 and like[1] > 0.8 and like[1] > like[2] > like[3] and like[4] < 0.25


def test_query_against_a_plain_version(spark, sf, texts):
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in E.query(spark, sf).collect()}
    assert rows.keys() == texts.keys()
    prints = {d: f for d, f in zip(order, E.strings(E.digits([texts[d] or "" for d in order])))}
    for k, d in enumerate(order):
        t, following = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[:len(t) - len(t) // 3] + following[:len(t) // 3]
        r = rows[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == prints[d] and r["edited_fingerprint"] == E.strings(E.digits([edited]))[0]
        pair = E.parse([prints[d], prints[order[(k + 1) % len(order)]], r["edited_fingerprint"]])
        assert abs(r["near_next"] - E.likeness(pair[:1], pair[1:2])[0]) < 1e-12
        assert abs(r["near_edited"] - E.likeness(pair[:1], pair[2:])[0]) < 1e-12
    assert all(r["near_edited"] > r["near_next"] for r in rows.values() if r["n_chars"] > 100)


def test_many_buckets_give_the_same_rows(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = sorted(map(tuple, E.edited_fingerprints(docs).collect()))
    monkeypatch.setattr(E, "BUCKET_ROWS", 3)
    assert sorted(map(tuple, E.edited_fingerprints(docs).collect())) == a


def test_odd_rows(spark, odd_documents, no_documents):
    rows = E.edited_fingerprints(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_text = {}
    for r in E.fingerprint(odd_documents).collect():
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert E.edited_fingerprints(no_documents).collect() == []
    only = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    r, = E.edited_fingerprints(only).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1


def test_near_duplicates_are_banded_and_verified(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)) for _ in range(6)]
    rows = [(10 * i, t) for i, t in enumerate(texts)] + [(10 * i + 1, t[:500] + "#" + t[501:]) for i, t in enumerate(texts)] + [(99, texts[0])]
    rows += [(10 * i + 2, "#" * 40 + t[:1100] + "##") for i, t in enumerate(texts)]
    links = E.near_duplicates(E.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")), 0.7).collect()
    found = E.digits([t for _, t in rows])
    near = {(rows[i][0], rows[6 + i][0]) for i in range(6) if E.likeness(found[i:i + 1], found[6 + i:7 + i])[0] >= 0.9}
    assert len(near) >= 4 and {(r["a"], r["b"]) for r in links} >= near | {(0, 99)}
    assert all(r["a"] // 10 == r["b"] // 10 or r["b"] == 99 for r in links)
