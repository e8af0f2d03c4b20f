"""Queries of the subpackage and their SQL, for the entry module."""

from __future__ import annotations

from lodestone.llm import ann, html_extract, license_scan, mixing, sentence_pieces, simhash, substring_dedup, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_html_extract": html_extract.op1_html_extract,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_simhash": simhash.op3_simhash,
        "op4_mixing": mixing.op4_mixing,
        "op5_sentence_pieces": sentence_pieces.op5_sentence_pieces,
        "op6_ann": ann.op6_ann,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_warc": warc.op9_warc,
        "op10_topk": topk.op10_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.OP2_SQL,
        "op7_license_scan": license_scan.OP7_SQL,
        "op9_warc": warc.OP9_SQL,
        "op10_topk": topk.OP10_SQL,
    }
