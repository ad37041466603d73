"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, fill_middle, hash_forest, licenses, line_dedup, lm_score, mixing, near_dedup, quality, secrets, toxicity, vector_codes

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_bpe": bpe.op2_bpe,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_lm_scoring": lm_score.op4_lm_scoring,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_license_scans": licenses.op9_license_scans,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_hash_forest": hash_forest.op13_hash_forest,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_fill_middle": fill_middle.OP12_SQL,
}
