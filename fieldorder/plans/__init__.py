"""Registered queries and whole-table plans."""

from importlib import import_module

from fieldorder.plans.registry import QUERIES, Query

FAMILIES = [
    "history", "field", "probability", "scoring", "scalars", "ingest", "laps", "joins", "ledger", "ratings", "matrix",
]


def load_queries() -> dict[str, Query]:
    for family in FAMILIES:
        import_module(f"fieldorder.plans.queries.{family}")
    return QUERIES
