"""All registered queries."""

from importlib import import_module

from deliveryrisk.plans.registry import QUERIES, oracle_text, spark_callable

FAMILIES = [
    "drivers",
    "customers",
    "pairs",
    "features",
    "overview",
    "regions",
    "temporal",
    "drift",
    "products",
    "stats",
    "indicators",
    "ingest",
    "models",
]


def load() -> dict:
    for family in FAMILIES:
        import_module(f"deliveryrisk.plans.{family}")
    return QUERIES


__all__ = ["QUERIES", "load", "oracle_text", "spark_callable"]
