"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from traceqc.llm import centroids, chat_format, decontamination, jaccard_join, lexical_search, licenses, line_dedup, mixing, quality_classifier, quality_rules, suffix_dedup, url_filters, warc

QUERIES = {
    "op8_suffix_dedup": suffix_dedup.query,
    "op3_jaccard_join": jaccard_join.query,
    "op10_quality_classifier": quality_classifier.query,
    "op6_decontamination": decontamination.query,
    "op2_line_dedup": line_dedup.query,
    "op5_licenses": licenses.query,
    "op1_warc": warc.query,
    "op4_url_filters": url_filters.query,
    "op7_mixing": mixing.query,
    "op9_quality_rules": quality_rules.query,
    "op11_chat_format": chat_format.query,
    "op12_lexical_search": lexical_search.query,
    "op13_centroids": centroids.query,
}

ORACLE = {
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op1_warc": warc.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op11_chat_format": chat_format.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
