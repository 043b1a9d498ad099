"""Queries of this subpackage, for the entry module: QUERIES by name, and ORACLES where SQL can state the result."""

from quillmark.llm import ann_search, grouped_packing, html_extract, importance_resampling, mixing, near_dedup, oracles, packing, quality_classifier, quality_rules, secret_scan, sharding, turn_repair, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_secret_scan": secret_scan.query,
    "op3_sharding": sharding.query,
    "op4_near_dedup": near_dedup.query,
    "op5_html_extract": html_extract.query,
    "op6_packing": packing.query,
    "op7_quality_rules": quality_rules.query,
    "op8_mixing": mixing.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_ann_search": ann_search.query,
    "op11_grouped_packing": grouped_packing.query,
    "op12_turn_repair": turn_repair.query,
    "op13_importance_resampling": importance_resampling.query,
}

ORACLES: dict[str, str] = {"op1_warc": warc.ORACLE, "op3_sharding": sharding.ORACLE, "op4_near_dedup": oracles.NEAR_DEDUP, "op13_importance_resampling": importance_resampling.ORACLE}
