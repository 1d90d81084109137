"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: name of the query: its module.
MODULES = {
    "op5_pii_surrogates": "pii",
    "op2_suffix_array_dedup": "repeats",
    "op6_jaccard_join": "jaccard",
    "op1_packing": "packing",
    "op9_quality_classifier": "importance",
    "op8_decontamination": "decontaminate",
    "op7_html_extraction": "html_text",
    "op3_url_filter": "url_filter",
    "op4_quality_rules": "quality_rules",
    "op10_language_id": "langid",
    "op11_conversation_repair": "conversations",
    "op12_bpe": "bpe",
    "op13_centroid_clusters": "centroids",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"gantry.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"gantry.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
