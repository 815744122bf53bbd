"""Contract queries of the corpus operators."""

from __future__ import annotations

from spanforge.llm import bpe, langid, merkle, packing, pii, quality, simhash, suffix, tokens, toxicity


def queries():
    return {
        "op1_token_counts": tokens.op1_token_counts,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op2_suffix_array_dedup": suffix.op2_suffix_array_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_quality_rules": quality.op4_quality_rules,
        "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
        "op7_bpe_codec": bpe.op7_bpe_codec,
        "op8_personal_data": pii.op8_personal_data,
        "op9_fingerprints": merkle.op9_fingerprints,
        "op10_language_id": langid.op10_language_id,
    }


def oracle_sql():
    return {"op9_fingerprints": merkle.OP9_SQL}
