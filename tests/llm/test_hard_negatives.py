from __future__ import annotations

import math
import random

import numpy as np
import pytest

from opslens.llm import hard_negatives as hn
from opslens.plans.compare import compare

SCHEMA = "vec_id long, label long, embedding array<double>"


def plain(rows, is_anchor, positives=5, negatives=3):
    """Every score, in whole numbers of any size."""
    fit = [(i, y, [min(max(math.floor(256 * c), -2 ** 63), 2 ** 63 - 1) for c in v]) for i, y, v in rows
           if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {}
    for r in sorted(fit):
        if is_anchor(r[0]):
            anchors.setdefault(r[0], r)
    out = []
    for a, label, v in anchors.values():
        scored = sorted((-max(-hn.LARGEST, min(hn.LARGEST, sum(x * y for x, y in zip(v, w)))), i, y) for i, y, w in fit if i != a)
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            below = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(below)]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = hn.prepare(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in hn.mine(df, df.where("vec_id % 5 = 0"), **sizes).collect())


def vectors(n: int, seed: int, dims: int = 12):
    """Close families of several labels, some zeros, ties and repeated rows."""
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = middles[rnd.integers(6)] + rnd.normal(size=dims) * rnd.choice([0, 0.2, 0.6])
        v[rnd.random(dims) < 0.3] = 0
        out.append((i, int(rnd.integers(4)), [float(c) for c in v]))
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("BLOCK_ROWS", 40), ("ANCHOR_ROWS", 8), ("SHARE", 2)):
        monkeypatch.setattr(hn, name, n)


def test_query_equals_sql(spark, sf, duck):
    res = compare(hn.query(spark, sf), duck, hn.ORACLE_SQL)
    assert res["values_match"] and res["spark_rows"] == res["oracle_rows"] > 0


def test_many_blocks_equal_brute_force(spark, small_blocks):
    rows = vectors(400, 1)
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows, positives=2, negatives=7) == plain(rows, lambda i: i % 5 == 0, 2, 7)


def test_odd_rows(spark, small_blocks):
    rows = vectors(90, 2)
    rows += [(200, 1, [0.0] * 12), (205, 1, []), (210, 2, [1.0]), (215, 2, [None] * 3), (220, 3, None), (225, None, [1.0] * 12), (None, 1, [1.0] * 12),
             (230, 1, [float("nan")] * 2), (235, 1, [float("inf")]), (240, 99, [0.5] * 12), (-5, 0, [-1.0] * 12), (-10, 0, [0.3, -0.2])]
    rows += rows[:20] + [(5, 3, [0.7] * 12), (5, 0, [0.1] * 12)]  # repeated rows, other rows of the same id
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)


def test_large_components(spark):
    rnd = random.Random(4)
    rows = [(i, i % 2, [rnd.uniform(-1, 1) * 10.0 ** rnd.choice([0, 6, 12]) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, i % 2, [1e30, -1e30 * i, 5.0]) for i in range(6)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)


def test_common_vector(spark, small_blocks):
    same = [0.25, -0.5, 0.75]
    rows = [(i, i % 3, same) for i in range(150)] + [(200 + i, i % 3, [0.2, -0.4, 0.01 * i]) for i in range(60)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)


def test_empty_table(spark):
    assert mined(spark, []) == []
    assert hn.mine(hn.prepare(spark.createDataFrame([(1, 1, [1.0])], SCHEMA)), hn.prepare(spark.createDataFrame([], SCHEMA))).count() == 0


def test_index_leaves_out_and_stops_early():
    rnd = np.random.default_rng(5)
    rows = np.round(rnd.normal(size=(3000, 48)) * np.geomspace(400, 1, 48))  # most of the norm in few dimensions
    anchor = np.round(rnd.normal(size=48) * np.geomspace(400, 1, 48))
    scores = rows @ anchor
    threshold = float(np.sort(scores)[-20])
    whole = hn.Index(rows, 0.0)
    index = hn.Index(rows, threshold / np.sqrt(anchor @ anchor))
    assert sum(map(len, index.at)) < 0.5 * sum(map(len, whole.at))
    at, exact, looked = index.search(anchor, threshold)
    assert sorted(at) == sorted(np.flatnonzero(scores >= threshold)) and (exact == scores[at]).all()
    assert looked < 0.5 * rows.size  # a full scan looks at every component


def test_rows_without_postings_cannot_reach():
    rnd = np.random.default_rng(6)
    rows = np.round(rnd.normal(size=(500, 16)) * 100) * (rnd.random((500, 16)) < 0.4)
    for share in (0.2, 0.5, 0.8):
        index = hn.Index(rows, share * index_top(rows))
        for anchor in rows[:50]:
            bar = share * index_top(rows) * np.sqrt(anchor @ anchor)
            at, _, _ = index.search(anchor, bar)
            assert sorted(at) == sorted(np.flatnonzero(rows @ anchor >= bar))


def index_top(rows):
    return float(np.sqrt((rows * rows).sum(axis=1)).max())
