"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import chat_format, cotraining, decontamination, filter_audit, html_extract, license_scan, line_dedup, mixing, quality_rules, simhash, substring_dedup, token_align, toxicity
from ._common import table

QUERIES = {
    "op1_quality_rules": lambda spark, d: quality_rules.op1(table(spark, d, "documents")),
    "op2_quality_cotraining": lambda spark, d: cotraining.op2(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_substring_dedup": lambda spark, d: substring_dedup.op3(table(spark, d, "documents")),
    "op4_benchmark_decontamination": lambda spark, d: decontamination.op4(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op5_simhash_dedup": lambda spark, d: simhash.op5(table(spark, d, "documents")),
    "op6_license_scan": lambda spark, d: license_scan.op6(table(spark, d, "documents")),
    "op7_html_extraction": lambda spark, d: html_extract.op7(table(spark, d, "pages")),
    "op8_toxicity": lambda spark, d: toxicity.op8(table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_source_mixing": lambda spark, d: mixing.op9(table(spark, d, "documents")),
    "op10_chat_formatting": lambda spark, d: chat_format.op10(table(spark, d, "conversations")),
    "op11_filter_audit": lambda spark, d: filter_audit.op11(table(spark, d, "documents"), table(spark, d, "labels")),
    "op12_line_dedup": lambda spark, d: line_dedup.op12(table(spark, d, "documents")),
    "op13_token_alignment": lambda spark, d: token_align.op13(table(spark, d, "documents")),
}

SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op4_benchmark_decontamination": decontamination.SQL,
    "op6_license_scan": license_scan.SQL,
    "op7_html_extraction": html_extract.SQL,
    "op9_source_mixing": mixing.SQL,
    "op10_chat_formatting": chat_format.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_line_dedup": line_dedup.SQL,
}
