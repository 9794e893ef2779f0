from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from opslens.llm import jaccard_join as J
from opslens.llm import shingles
from opslens.llm.components import components


def word_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs."""
    sets = [(d, word_set(t)) for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j, (e, b) in enumerate(sets[:i]):
            if a and b and d is not None and e is not None and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), None if d is None else least[find(i)]) for i, (d, s) in enumerate(sets)]


def agree(spark, rows):
    got = [tuple(r) for r in J.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_query_equals_brute_force(spark, sf, texts):
    got = sorted(tuple(r) for r in J.query(spark, sf).collect())
    assert got == sorted(brute(list(texts.items())))
    assert len({c for _, _, c in got}) < len(got)


def family(rng, n, edits, size=120):
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words))
            words[at:at + rng.randint(0, 2)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_families_of_near_copies_and_common_passages(spark, monkeypatch, seed):
    monkeypatch.setattr(J, "SHORT_LIST", 4)
    monkeypatch.setattr(J, "NEIGHBOURS", 1)
    monkeypatch.setattr(J, "FREQUENT_FROM", 5)
    monkeypatch.setattr(J, "BUCKET_DOCS", 40)
    rng = random.Random(seed)
    passage = family(rng, 1, 0, 30)[0]
    texts = family(rng, 60, 6) + family(rng, 40, 3, 40) + [passage + " " + t for t in family(rng, 25, 1, 12)] + [passage + " " + " ".join(f"u{i}{j}" for j in range(40)) for i in range(30)]
    texts += [texts[3]] * 12 + ["", None, "one two", "ONE two", "one two three four five"]
    rng.shuffle(texts)
    agree(spark, [(i * 7 % 1000, t) for i, t in enumerate(texts)])


def test_thresholds_at_the_boundary(spark):
    """80 of 100 links, 79 of 99 and 79 of 100 don't."""
    words = [f"x{i}" for i in range(200)]
    a, b = " ".join(words[:94]), " ".join(words[:94] + words[150:160])  # 90 shingles; 100 in the union
    rows = [(1, a), (2, b), (3, " ".join(words[:84])), (4, " ".join(words[:104])), (5, " ".join(words[:83])), (6, " ".join(f"y{i}" for i in range(83))), (7, " ".join([*(f"y{i}" for i in range(83)), *words[:21]]))]
    agree(spark, rows)


def test_odd_rows(spark, odd_documents, no_documents):
    agree(spark, [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()])
    assert J.link_components(no_documents).collect() == []
    kept = J.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted((i is None, i) for i in ids if i is not None) == [(False, i) for i in (-5, 1, 2, 3, 4, 5, 7, 9, 11, 12)]  # 6, 8 and 10 are near copies
    assert ids.count(None) == 1
    assert J.one_of_each(no_documents).collect() == []


def test_one_id_with_two_texts(spark):
    agree_rows = spark.createDataFrame([(1, "a b c d e f"), (1, "p q r s t u"), (2, "A B C D E F"), (3, "p q r s t u")], "doc_id long, text string")
    got = sorted(tuple(r) for r in J.link_components(agree_rows).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]


def test_shingle_sets_equal_python_sets():
    rng = random.Random(0)
    texts = ["", " ", "a", "A  b\tc\r\nd", "é É x\x0by z w", "a\x1cb c d e f"] + [" ".join(rng.choice("abcXYZ") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    whole = pa.array(texts + [None])
    seen = {}
    for column, start in ((whole, 0), (whole.slice(7, 50), 7)):
        for at, end, data, offsets in shingles.slices(column):
            doc, value, size = shingles.shingle_sets(data, offsets)
            sig = shingles.signatures(doc, value, end - at)
            for i in range(end - at):
                text = (texts + [None])[start + at + i]
                assert size[i] == len(word_set(text)) == (doc == i).sum()
                assert seen.setdefault(word_set(text), sig[i]) == sig[i]
    assert len(set(seen.values())) == len(seen)


def test_bitmaps_never_differ_more_than_the_sets():
    rng = random.Random(2)
    texts = family(rng, 12, 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts)], ["sig", "text"])
    out = next(iter(J._bitmaps(iter([batch]))))
    words = np.array([out.column(w).to_pylist() for w in J.WORDS_OF_BITMAP], dtype=np.int64).T.copy()
    for i in range(12):
        for j in range(12):
            differ = np.unpackbits((words[i] ^ words[j]).view(np.uint8)).sum()
            assert differ <= len(word_set(texts[i]) ^ word_set(texts[j]))


def generated_code(spark, df):
    """The Java code that Spark makes of the plan of ``df``, with joins by sorting."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        stages = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
        return [stages.apply(i)._2() for i in range(stages.size())]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bitmaps_are_compared_without_overflow_and_null_checks(spark):
    # with them, the JIT compiler took hundreds of MB of an executor for one generated method
    rng = random.Random(4)
    texts = family(rng, 12, 10)
    bitmaps = spark.createDataFrame(list(enumerate(texts)), "sig long, text string").transform(J.bitmaps_of).localCheckpoint()
    rows = {r["sig"]: r for r in bitmaps.collect()}

    def differ(a, b):
        return sum(((rows[a][w] ^ rows[b][w]) & (1 << 64) - 1).bit_count() for w in J.WORDS_OF_BITMAP)

    def least(a, b):
        return -(-J.THRESHOLD * (rows[a]["size"] + rows[b]["size"]) // (100 + J.THRESHOLD))

    def close(a, b):
        return differ(a, b) <= rows[a]["size"] + rows[b]["size"] - 2 * least(a, b)

    every = [(a, b) for a in rows for b in rows if a < b]
    near = J.by_bitmap(spark.createDataFrame(every, "a long, b long"), bitmaps)
    assert sorted(map(tuple, near.collect())) == sorted((a, b, differ(a, b)) for a, b in every if close(a, b))
    assert dict(near.dtypes)["differ"] == "int"

    entries = spark.createDataFrame([(7, d, rows[d]["size"], d % 3) for d in rows], "shingle long, sig long, size long, position long")
    labels = spark.createDataFrame([(d, d % 4) for d in rows], "node long, component long")
    listed = J.across_long_lists(entries, labels, bitmaps)
    main = max(range(4))  # components of three each: the largest label

    def met(a, b):
        sizes = sorted((rows[a]["size"], rows[b]["size"]))
        return (a % 4 != b % 4 and 100 * sizes[0] >= J.THRESHOLD * sizes[1] and close(a, b)
                and all(d % 3 <= rows[d]["size"] - least(a, b) for d in (a, b)) and (a % 4 != main or b % 4 != main))

    want = {frozenset(p) for p in every if met(*p)}
    found = [tuple(r) for r in listed.collect()]
    assert {frozenset(p) for p in found} == want and want
    assert all((rows[a]["size"], a) < (rows[b]["size"], b) for a, b in found)
    assert not any(bitmaps.schema[c].nullable for c in ("size", *J.WORDS_OF_BITMAP))  # nor with null checks
    for df in (near, listed):
        code = [c for c in generated_code(spark, df) if "bitCount" in c]
        assert code and not any("Exact(" in c for c in code)


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (9, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 141)} | {i: 7 for i in range(200, 260)} | {2: 1, 3: 1}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
