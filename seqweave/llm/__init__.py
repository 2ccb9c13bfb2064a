"""Operators for training-data pipelines; nothing else in the package imports them."""

from __future__ import annotations

from seqweave.llm import base_columns, exact_dedup, fingerprints, hard_negatives, licenses, merkle, mixing, packing, pii, pivots, sharding, token_counts, toxicity, urls

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_separator_scan": token_counts.op5_separator_scan,
    "op6_url_filter": urls.op6_url_filter,
    "op7_simhash_near_dedup": pivots.op7_simhash_near_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_personal_data": pii.op9_personal_data,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_feistel_shards": sharding.op12_feistel_shards,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    **base_columns.QUERIES,
}
SQL = {
    "op1_source_mixing": mixing.SQL,
    "op6_url_filter": urls.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_feistel_shards": sharding.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
    **base_columns.SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
