"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAMES = {
    "op1_toxicity": "toxicity",
    "op2_pii": "pii",
    "op3_jaccard_join": "jaccard_join",
    "op4_topk": "topk",
    "op5_quality": "quality",
    "op6_pieces": "pieces",
    "op7_vector_dedup": "vector_dedup",
    "op8_packing": "packing",
    "op9_suffix_dedup": "suffix_dedup",
    "op10_substring_dedup": "substring_dedup",
    "op11_rules": "rules",
    "op12_conversations": "conversations",
    "op13_clusters": "clusters",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"tesselar.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    from tesselar.llm import clusters, topk, twins

    return {"op3_jaccard_join": twins.OP3, "op4_topk": topk.SQL, "op7_vector_dedup": twins.OP7, "op10_substring_dedup": twins.OP10,
            "op11_rules": twins.OP11, "op12_conversations": twins.OP12, "op13_clusters": clusters.SQL}
