"""The queries of this package and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, licenses, quality, secrets, simhash, substrings, topk, toxicity


def queries() -> dict:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_secrets": secrets.op2_secrets,
        "op3_html": html_text.op3_html,
        "op4_quality": quality.op4_quality,
        "op5_topk": topk.op5_topk,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_substrings": substrings.op7_substrings,
        "op8_simhash": simhash.op8_simhash,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_bpe": bpe.op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.ORACLE, "op2_secrets": secrets.ORACLE, "op5_topk": topk.ORACLE, "op6_decontaminate": decontaminate.ORACLE, "op7_substrings": substrings.ORACLE}
