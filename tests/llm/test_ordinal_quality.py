from __future__ import annotations

import numpy as np
import pytest

from opslens.llm import ordinal_quality as Q


def graded(duck_rows):
    return [(t or "", 0 if q == 0 else 1 if x else 2) for t, q, x in duck_rows]


def test_held_out_accuracy():
    import duckdb
    base = "/root/testdata/sf0.1"
    rows = graded(duckdb.sql(f"SELECT d.text, l.quality, l.toxic FROM '{base}/documents.parquet' d JOIN '{base}/labels.parquet' l USING (doc_id) ORDER BY hash(doc_id)").fetchall())
    cut = int(len(rows) * 0.8)
    features = Q.Features()
    model = Q.fit([np.array(features.of(t)) for t, _ in rows[:cut]], np.array([g for _, g in rows[:cut]]))
    assert model.thresholds[0] < model.thresholds[1] and (model.weights <= 0).all()
    score = model.scorer()
    kept = {0: [], 1: [], 2: []}
    for t, g in rows[cut:]:
        grade, p1, p2 = score(t)
        assert 0 <= p2 <= p1 <= 1 and abs(grade - p1 - p2) < 1e-12
        kept[g].append(p2 >= Q.KEEP_FROM)
    assert np.mean(kept[2]) > 0.97 and np.mean(kept[0]) < 0.05 and np.mean(kept[1]) < 0.6


def test_gradient_recovers_a_planted_model():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(3000):
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        rows.append(np.array(sorted({int(x) for x in rng.integers(100, 1000, 20)} | ({1} if bad else set()) | ({2} if rude else set()))))
        grades.append(0 if bad else 1 if rude else 2)
    model = Q.fit(rows, np.array(grades))
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    assert weight[1] < weight[2] < -1
    assert all(w > -0.5 * abs(weight[2]) for i, w in weight.items() if i >= 100)


def test_query_scores_every_document(spark, sf, texts):
    rows = Q.query(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    again = {r["doc_id"]: r["p_grade_2"] for r in Q.query(spark, sf).collect()}
    assert again == {r["doc_id"]: r["p_grade_2"] for r in rows}
    assert all(r["keep"] == (r["p_grade_2"] >= Q.KEEP_FROM) for r in rows)


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (9, 0, 0), (9, 1, 0), (None, 1, 0), (4, None, 1), (77, 1, 0), (10, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    scored, names = Q.score(odd_documents, Q.train(odd_documents, labels))
    assert scored.columns == [*odd_documents.columns, *names] and "expected_grade" not in names
    assert scored.count() == odd_documents.count()
    assert Q.keep_good(odd_documents, labels).columns == odd_documents.columns
    assert Q.keep_good(no_documents, labels).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, 1, 0), (4, 1, 0)]])
def test_nothing_to_learn_keeps_all(spark, odd_documents, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert Q.keep_good(odd_documents, labels).count() == odd_documents.count()
