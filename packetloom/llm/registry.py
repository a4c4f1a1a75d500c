"""The queries of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from . import divergence, filter_audit, jaccard, langid, media, mixing, nbsvm, packing, pii, quality_rules, secret_scan, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_quality_classifier": nbsvm.query,
    "op3_jaccard_join": jaccard.query,
    "op4_secret_scan": secret_scan.query,
    "op5_source_mixing": mixing.query,
    "op6_best_fit_packing": packing.query,
    "op7_warc": warc.query,
    "op8_media_chunks": media.query,
    "op9_language_id": langid.query,
    "op10_pii": pii.query,
    "op11_source_divergence": divergence.query,
    "op12_toxicity": toxicity.query,
    "op13_filter_audit": filter_audit.query,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op5_source_mixing": mixing.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
