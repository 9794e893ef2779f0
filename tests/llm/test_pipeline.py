from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline as P
from opslens.llm import mixing, ordinal_quality, packing
from opslens.llm.common import table


def word_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def stages(spark, docs, sf_dir):
    out = []
    for name, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toArrow())
        out.append(docs)
    return out


def test_stages_against_plain_versions(spark, sf):
    docs = table(spark, sf, "documents")
    good, single, clean, mixed, packed = stages(spark, docs, sf)
    columns = docs.columns
    assert all(s.columns == columns for s in (good, single, clean, mixed))

    # the classifier's decision, text by text
    score = ordinal_quality.train(docs, table(spark, sf, "labels")).scorer()
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {d for d, r in rows.items() if score(r["text"] or "")[2] >= ordinal_quality.KEEP_FROM}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(kept) and 0 < len(kept) < len(rows)

    # one document of each group of links
    sets = {d: word_set(rows[d]["text"]) for d in kept}
    group = {d: d for d in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(group.values()))

    # texts change only in entities, and n_chars with them
    entity = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\d|AKIA\w{16}|(?<=[0-9a-f])[a-f](?=[0-9a-f])")
    for r in clean.collect():
        old = rows[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and (r["lang"], r["source"]) == (old["lang"], old["source"])
        assert re.sub(r"[0-9a-f]{10,}", "#", entity.sub("#", r["text"])).count(" ") == re.sub(r"[0-9a-f]{10,}", "#", entity.sub("#", old["text"])).count(" ")

    # every copy the mix asks for, and its pieces
    asked, mix = mixing.copies_per_document(clean)
    copies = {r["doc_id"]: r[mix]["copies"] for r in asked.collect() if r[mix]["copies"]}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(copies)
    want = packing.digest(mixed).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    got = packed.collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, want))
    assert max(Counter({}) or [0]) == 0 and all(r["offset"] + r["length"] <= 1024 for r in got)


def test_run_is_the_stages_in_order(spark, sf):
    got = P.run(spark, sf)
    last = stages(spark, table(spark, sf, "documents"), sf)[-1]
    assert Counter(map(tuple, got.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == Counter(
        map(tuple, last.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "ngram_jaccard_join", "pii_surrogates", "source_mixing", "best_fit_packing"]


def test_odd_and_empty_documents_run_through(spark, sf, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        out = docs
        for name, stage in P.STAGES:
            out = spark.createDataFrame(stage(spark, out, sf).toArrow())
            if name != "best_fit_packing":
                assert out.columns == docs.columns, name
        assert (out.count() > 0) == (docs.count() > 0)
