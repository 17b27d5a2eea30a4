"""Registered queries of this package and their SQL."""

from __future__ import annotations

from ringwatch.llm import (
    byte_bpe, embedding_dedup, language, licenses, minhash, nearest, packing, periodic_runs, quality, suffix_dedup, toxicity, vector_codes, warc)

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_nearest_neighbours": nearest.op3_nearest_neighbours,
    "op4_packing": packing.op4_packing,
    "op5_quality": quality.op5_quality,
    "op6_warc": warc.op6_warc,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_bpe_round_trip": byte_bpe.op8_bpe_round_trip,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_minhash_dedup": minhash.op10_minhash_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_language_id": language.op12_language_id,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES = {
    "op1_license_scan": licenses.OP1_SQL,
    "op6_warc": warc.OP6_SQL,
    "op9_embedding_dedup": embedding_dedup.OP9_SQL,
    "op10_minhash_dedup": minhash.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
}
