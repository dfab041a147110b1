"""The queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> module of this subpackage that defines it
MODULES = {
    "op1_paragraph_minhash": "paragraph_minhash",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_pii": "pii",
    "op4_mixing": "mixing",
    "op5_quality_rules": "quality_rules",
    "op6_collision_count": "collision_count",
    "op7_token_files": "token_files",
    "op8_super_minhash": "super_minhash",
    "op9_sharding": "sharding",
    "op10_bpe": "bpe",
    "op11_structure_repair": "turns",
    "op12_best_fit_packing": "packing",
    "op13_merkle_manifest": "merkle",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"sessionlens.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"sessionlens.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
