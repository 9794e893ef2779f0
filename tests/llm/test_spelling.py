from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from opslens.llm import spelling
from opslens.plans.compare import compare

NEAR_LETTERS = "abeéßÿ×"


def near(a: str, b: str) -> bool:
    """One code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows, min_length=6, min_count=5, thinned=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1:] if h % thinned == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def plain_groups(words: dict[str, int], ratio=5):
    out = {}
    for w, n in words.items():
        around = [o for o in words if near(w, o)]
        best = min(around, key=lambda o: (-words[o], o), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = (form, n, len(around), words[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {(w, form, root(w), n, k, form_n) for w, (form, n, k, form_n) in out.items()}


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_equals_sql(spark, sf, duck):
    res = compare(spelling.query(spark, sf), duck, spelling.ORACLE_SQL)
    assert res["values_match"] and res["spark_rows"] == res["oracle_rows"] > 0


def test_query_equals_brute_force(spark, sf, duck):
    words = plain_words(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    df = spelling.query(spark, sf)
    got = rows_of(df)
    assert got == plain_groups(words) and df.count() == len(got)
    assert any(r[1] for r in got)


def made_words(n: int, seed: int) -> dict[str, int]:
    """Words around few stems, so that chunks are hot and chains of forms long."""
    rnd = random.Random(seed)
    stems = ["abbabb", "éßabbaab", "aaaaaaa", "ab×ÿabaaabe"]
    out = {}
    for _ in range(n):
        w = list(rnd.choice(stems))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w))
            w[at:at + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice(NEAR_LETTERS)], [rnd.choice(NEAR_LETTERS)]])
        if len(w) >= 2:
            out["".join(w)] = 5 ** rnd.randint(1, 8) + rnd.randint(0, 1)
    return out


def test_hot_chunks_lose_no_pair(spark):
    words = made_words(900, 1)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    plain = {tuple(sorted((a, b))) for a in words for b in words if near(a, b)}
    for hot in (8, 128, 10 ** 6):  # refined several times; the production value; never refined
        pairs = spelling.near_pairs(df, hot).collect()
        assert {tuple(sorted((r["a"], r["b"]))) for r in pairs} == plain and len(pairs) == len(plain)
        assert all(words[r["a"]] == r["a_n"] and words[r["b"]] == r["b_n"] for r in pairs)


def test_groups_of_made_words(spark):
    words = made_words(400, 2)
    got = rows_of(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_groups(words)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of more than one form


def test_thinned_runs(spark):
    rows = [(d, f"Éclair{i:c} LETTERS{i:c}xyz plain" * 2) for d in range(60) for i in range(97, 110)]
    for thinned in (2, 199):
        got = {r["word"]: r["n"] for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"), thinned=thinned).collect()}
        assert got == plain_words(rows, thinned=thinned)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    long = "x" * 50_000
    rows += [(None, f"{long} ×÷×÷×÷ ÀÉÎÕÜß ÀÉÎÕÜß")] * 6
    df = odd_documents.unionByName(spark.createDataFrame(rows[-6:], "doc_id long, text string"), allowMissingColumns=True)
    words = spelling.count_words(df)
    assert {r["word"]: r["n"] for r in words.collect()} == plain_words(rows)
    assert rows_of(spelling.group_variants(words)) == plain_groups(plain_words(rows))
    assert spelling.group_variants(spelling.count_words(no_documents)).count() == 0
