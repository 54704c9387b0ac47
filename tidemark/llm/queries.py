"""The corpus queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from . import attention_lm, decontaminate, jaccard_join, license_scan, piece_bpe, pii, quality_rules, sharding, url_filter, warc

QUERIES = {
    "op1_url_filter": (url_filter.op1, url_filter.ORACLE),
    "op2_pii_weak_supervision": (pii.op2, None),
    "op3_string_tiling_decontamination": (decontaminate.op3, None),
    "op4_balanced_label_sharding": (sharding.op4, None),
    "op5_risk_controlled_quality": (quality_rules.op5, quality_rules.ORACLE),
    "op6_patience_license_scan": (license_scan.op6, None),
    "op7_piece_bpe": (piece_bpe.op7, None),
    "op8_attention_lm": (attention_lm.op8, None),
    "op9_warc_reassembly": (warc.op9, warc.ORACLE),
    "op10_ngram_jaccard_join": (jaccard_join.op10, None),
}
