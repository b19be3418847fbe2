"""Checked broadcasts and column names, beside the library's lineage cuts and prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.operators.ordering import discard, materialize, offsets, ordered, shared_folder

__all__ = ["discard", "join_small", "materialize", "offsets", "ordered", "other_columns", "shared_folder"]

#: Rows up to which a side of a join may be broadcast, and its bytes a row.
BROADCAST_ROWS = 100_000


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a broadcast if ``small`` (fixed-width rows) is counted and within ``rows``; else by shuffle, where AQE splits hot keys."""
    fits = small.limit(rows + 1).count() <= rows
    return big.join(F.broadcast(small) if fits else small, on, how)


def other_columns(docs: DataFrame, taken: list[str]) -> list[str]:
    """The columns of docs that Spark tells apart from ``taken``: by default names that differ in case only are one."""
    fold = str if docs.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    named = {fold(c) for c in taken}
    return [c for c in docs.columns if fold(c) not in named]
