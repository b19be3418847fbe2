"""Numbered, append-only schema steps over the catalog's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.operators.catalog import documents_to_tables
from ledgerstone.operators.ordering import row_numbers
from ledgerstone.operators.versions import without_duplicate_groups

Tables = dict[str, DataFrame]


def _item_column(tables: Tables) -> Tables:
    """``id`` was the item's name; audits get a number of their own."""
    fixity = tables["fixity"].withColumnRenamed("id", "item")
    numbered = row_numbers(fixity, ["scheduled_time", "item"], "id").select("id", *fixity.columns)
    return tables | {"items": tables["items"].withColumnRenamed("id", "item"), "fixity": numbered}


def _unique_items(tables: Tables) -> Tables:
    """Items that occur more than once go (they are caches, and are read again); sizes are wide."""
    return tables | {"items": without_duplicate_groups(tables["items"], ["item"]).withColumn("size", F.col("size").cast("long"))}


def _index_tables(tables: Tables) -> Tables:
    """Blobs, versions and slots as tables, from the items' documents."""
    return tables | {k: v for k, v in documents_to_tables(tables["items"].where("value is not null")).items() if k != "items"}


#: The step from version n to n + 1 is at place n - 1.
STEPS: tuple[Callable[[Tables], Tables], ...] = (_item_column, _unique_items, _index_tables)


def upgrade(tables: Tables, version: int = 1) -> tuple[Tables, int]:
    """The tables after all steps above ``version``, and the version that they have then."""
    for step in STEPS[version - 1 :]:
        tables = step(tables)
    return tables, len(STEPS) + 1
