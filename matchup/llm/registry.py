"""Queries of the training-data operators and their DuckDB restatements."""

from __future__ import annotations

from matchup.llm import (
    decontamination,
    jaccard_join,
    license_join,
    line_dedup,
    mixing,
    packing,
    quality_knn,
    quality_rules,
    secret_models,
    source_audit,
    spelling,
    url_rules,
    vector_dedup,
)

QUERIES = {
    "op3_secret_models": secret_models.op3_secret_models,
    "op4_url_rules": url_rules.op4_url_rules,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_mixing": mixing.op7_mixing,
    "op1_quality_knn": quality_knn.op1_quality_knn,
    "op2_vector_dedup": vector_dedup.op2_vector_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_packing": packing.op9_packing,
    "op10_license_join": license_join.op10_license_join,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_spelling": spelling.op12_spelling,
    "op13_source_audit": source_audit.op13_source_audit,
}

SQL = {"op4_url_rules": url_rules.OP4_SQL, "op11_decontamination": decontamination.OP11_SQL, "op13_source_audit": source_audit.OP13_SQL}
