from __future__ import annotations

import math

import numpy as np
import pytest

from opslens.llm import impact_search as S

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in ints if i % 50 == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def test_query_equals_sql(spark, duck, sf):
    assert sorted(map(tuple, S.query(spark, sf).collect())) == sorted(duck.sql(S.ORACLE_SQL).project("query_id, rank, vec_id, score").fetchall())


def searched(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return [tuple(r) for r in S.top_k(df, df.where("vec_id % 50 = 0"), k).collect()]


@pytest.mark.parametrize("blocks", [(512, 8192), (2, 7)])
def test_random_vectors_ties_and_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(S, "QUERY_ROWS", blocks[0])
    monkeypatch.setattr(S, "BLOCK_ROWS", blocks[1])
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.choice([-1, -0.5, 0, 0.25, 0.5, 1], 6)]) for i in range(200)]
    got = searched(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_early_stop_is_exact():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(0, 0.1, (3000, 32))).astype(np.int64)
    rows[5:40] = rows[5] + rng.integers(-1, 2, (35, 32))  # many close scores
    queries = rows[:20]
    got = S.search_block(queries, np.arange(20), rows, np.arange(3000), 5)
    exact = queries @ rows.T
    for q in range(20):
        order = [i for i in sorted(range(3000), key=lambda i: (-exact[q, i], i)) if i != q][:5]
        assert [(r, s) for a, r, s in got if a == q] == [(i, exact[q, i]) for i in order]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [1.0]), (6, []), (7, [1.0, 1.0, 9.0]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (100, None), (8, [-1.0, 2.0])]
    assert set(searched(spark, rows)) == brute(rows)
    assert searched(spark, [(0, [1.0])]) == []
    assert searched(spark, []) == []
    repeated = [(0, [1.0]), (0, [1.0]), (3, [1.0]), (3, [1.0]), (4, [0.5])]
    assert sorted(searched(spark, repeated)) == [(0, 1, 3, 65536), (0, 2, 3, 65536), (0, 3, 4, 32768)]


def test_components_too_large_for_doubles(spark):
    rows = [(0, [3.0e18, 1.0]), (1, [1.0e-3, 2.0]), (2, [0.01, 5.0]), (3, [0.02, -7.0])]
    got = {r[2]: r[3] for r in searched(spark, rows)}
    whole = (1 << 63) - 1
    assert got == {1: 2 * 256 * 256, 2: whole, 3: whole}
