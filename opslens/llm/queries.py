"""Registry of the queries of this subpackage: name -> (spark, sf_dir) -> DataFrame,
and the DuckDB SQL of those that SQL expresses."""

from __future__ import annotations

from opslens.llm import edit_embedding, hard_negatives, html_text, impact_search, jaccard_join, mixing, ordinal_quality, packing, pii, spelling, substring_dedup, token_counts, warc

QUERIES = {
    "op1_source_mixing": mixing.query,
    "op2_pii_surrogates": pii.query,
    "op3_suffix_array_dedup": substring_dedup.query,
    "op4_document_fingerprints": edit_embedding.query,
    "op5_exact_top_k": impact_search.query,
    "op6_best_fit_packing": packing.query,
    "op7_warc": warc.query,
    "op8_ordinal_quality": ordinal_quality.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_html_extraction": html_text.query,
    "op11_spelling_variants": spelling.query,
    "op12_token_counts": token_counts.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE_SQL = {
    "op1_source_mixing": mixing.ORACLE_SQL,
    "op5_exact_top_k": impact_search.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op11_spelling_variants": spelling.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
