"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from newsloom.llm import decontaminate, line_dedup, minhash_dedup, pii_bootstrap, ppm_score, quality_mcd, sentencepiece_fst, token_codec, toxicity, url_filter

QUERIES = {
    "op1_minhash_near_dedup": minhash_dedup.query,
    "op2_sentencepiece": sentencepiece_fst.query,
    "op3_decontamination": decontaminate.query,
    "op4_token_codec": token_codec.query,
    "op5_url_filter": url_filter.query,
    "op6_toxicity": toxicity.query,
    "op7_line_dedup": line_dedup.query,
    "op8_ppm_score": ppm_score.query,
    "op9_pii_bootstrap": pii_bootstrap.query,
    "op10_quality_mcd": quality_mcd.query,
}

ORACLES = {
    "op3_decontamination": decontaminate.SQL,
    "op5_url_filter": url_filter.SQL,
    "op7_line_dedup": line_dedup.SQL,
}
