"""All registered catalog queries and their DuckDB oracles."""

from ledgerstone.plans import audits, documents, histories, lookups, processes, rules, scalars, trees  # noqa: F401  they register
from ledgerstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
