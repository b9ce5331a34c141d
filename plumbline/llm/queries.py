"""Queries of the operators in this package, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import class_lm, html_text, imatch, jaccard_join, licences, minhash, mixing, negatives, packing, quality, repair, topk, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_class_lm": class_lm.op1_class_lm,
    "op2_html_text": html_text.op2_html_text,
    "op3_jaccard": jaccard_join.op3_jaccard,
    "op4_url_rules": url_rules.op4_url_rules,
    "op5_imatch": imatch.op5_imatch,
    "op6_quality": quality.op6_quality,
    "op7_licences": licences.op7_licences,
    "op8_topk": topk.op8_topk,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_minhash": minhash.op12_minhash,
    "op13_repair": repair.op13_repair,
}

ORACLE: dict[str, str] = {
    "op4_url_rules": url_rules.OP4_SQL,
    "op7_licences": licences.OP7_SQL,
    "op8_topk": topk.OP8_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
}
