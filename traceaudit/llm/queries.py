"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from traceaudit.llm import decontaminate, filter_audit, hard_negatives, jaccard_join, katz, knn, license_scan, pieces, quality, rule_cascade, toxicity, url_reputation, warc

QUERIES = {
    "op1_url_reputation": url_reputation.op1_url_reputation,
    "op2_warc": warc.op2_warc,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "sentencepiece_merges": pieces.sentencepiece_merges,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_block_knn": knn.op7_block_knn,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_katz_backoff": katz.op9_katz_backoff,
    "op10_quality": quality.op10_quality,
    "op11_rule_cascade": rule_cascade.op11_rule_cascade,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLE_SQL = {
    "op1_url_reputation": url_reputation.ORACLE_SQL,
    "op2_warc": warc.ORACLE_SQL,
    "op4_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_license_scan": license_scan.ORACLE_SQL,
    "op11_rule_cascade": rule_cascade.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
