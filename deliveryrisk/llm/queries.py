"""Queries of the corpus operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

# query: (module, constant with its SQL or None)
REGISTERED = {
    "op1_near_copies": ("near_copies", None),
    "op2_neighbours": ("neighbours", None),
    "op3_exact_dedup": ("exact_dedup", "OP3_SQL"),
    "op4_license_scan": ("licenses", None),
    "op5_quality": ("quality", None),
    "op6_packing": ("packing", None),
    "op7_pii": ("pii", None),
    "op8_lm_scoring": ("lm_scoring", None),
    "op9_mixing": ("mixing", "OP9_SQL"),
    "op10_url_filter": ("url_filter", None),
    "op11_decontamination": ("decontamination", "OP11_SQL"),
    "op12_conversation_repair": ("conversations", "OP12_SQL"),
    "op13_vector_codes": ("vector_codes", "OP13_SQL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"deliveryrisk.llm.{module}"), name) for name, (module, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {
        name: getattr(import_module(f"deliveryrisk.llm.{module}"), sql) for name, (module, sql) in REGISTERED.items() if sql
    }
