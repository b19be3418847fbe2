"""Checksum audits: search, due checks, backfill, guarded updates, scheduling."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerstone.functions import scalars
from ledgerstone.operators.ordering import row_numbers

#: Fixed values, in days and hours: when the next check falls, and a new item's first.
NEXT_EARLIEST_D, NEXT_LATEST_D, FIRST_WITHIN_H = 182, 365, 12


def _at(fixity: DataFrame, when: datetime) -> Column:
    """A literal of the time column's own type, so that the filter reaches the scan."""
    return F.lit(when).cast(dict(fixity.dtypes)["scheduled_time"])


def search(fixity: DataFrame, start: datetime | None = None, end: datetime | None = None, item: str | None = None, status: str | None = None) -> DataFrame:
    """Records in a closed time range, of an item, with a status; None stands for any. In order of time, then id."""
    conditions = [F.col("scheduled_time") >= _at(fixity, start) if start else None, F.col("scheduled_time") <= _at(fixity, end) if end else None, F.col("item") == item if item else None, F.col("status") == status if status else None]
    for c in conditions:
        if c is not None:
            fixity = fixity.where(c)
    return fixity.orderBy("scheduled_time", "id")


def by_id(fixity: DataFrame, id_: int) -> DataFrame:
    return fixity.where(F.col("id") == id_).limit(1)


def due(fixity: DataFrame, cutoff: datetime) -> DataFrame:
    return fixity.where((F.col("status") == "scheduled") & (F.col("scheduled_time") <= _at(fixity, cutoff)))


def next_due(fixity: DataFrame, cutoff: datetime) -> DataFrame:
    return due(fixity, cutoff).orderBy("scheduled_time", "id").limit(1)


def next_check(fixity: DataFrame) -> DataFrame:
    """The earliest scheduled time of each item that has one."""
    return fixity.where(F.col("status") == "scheduled").groupBy("item").agg(F.min("scheduled_time").alias("next_time"))


def unscheduled(items: DataFrame, fixity: DataFrame) -> DataFrame:
    """Items without a scheduled check."""
    return items.join(fixity.where(F.col("status") == "scheduled").select("item").distinct(), "item", "left_anti")


def backfill(items: DataFrame, fixity: DataFrame, now: datetime) -> DataFrame:
    """A first check within hours for every item without one."""
    at = scalars.jittered(F.lit(now).cast("timestamp"), F.col("item"), 0, FIRST_WITHIN_H * 3600)
    return unscheduled(items, fixity).select("item", at.alias("scheduled_time"), F.lit("scheduled").alias("status"), F.lit("").alias("notes"))


def update(fixity: DataFrame, changes: DataFrame) -> DataFrame:
    """Records after changes (id, item, scheduled_time, status, notes).

    A change with id 0 or NULL inserts (an empty status becomes scheduled, ids
    go on from the largest); others apply only while the stored status is scheduled.
    """
    given = F.coalesce("id", F.lit(0)) != 0
    return _close(fixity, changes.where(given)).unionByName(_append(fixity, changes.where(~given)))


def _close(fixity: DataFrame, changes: DataFrame) -> DataFrame:
    """All records, those with a change of their id replaced while their status is scheduled; 0 is an id like any other."""
    known = changes.select("id", *[F.col(c).alias(f"_{c}") for c in ("item", "scheduled_time", "status", "notes")], F.lit(True).alias("_hit"))
    open_ = (F.col("status") == "scheduled") & F.col("_hit")
    return fixity.join(known, "id", "left").select("id", *[F.when(open_, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("item", "scheduled_time", "status", "notes")])


def _append(fixity: DataFrame, new: DataFrame) -> DataFrame:
    """New records only, with ids that go on from the largest."""
    top = fixity.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = row_numbers(new, ["scheduled_time", "item"], "_n").join(F.broadcast(top))
    status = F.when(F.coalesce("status", F.lit("")) == "", "scheduled").otherwise(F.col("status"))
    return numbered.select((F.col("top") + F.col("_n")).cast("long").alias("id"), "item", "scheduled_time", status.alias("status"), "notes")


def run_now(fixity: DataFrame, id_: Column | int, now: datetime) -> DataFrame:
    hit = (F.col("id") == id_) & (F.col("status") == "scheduled")
    return fixity.withColumn("scheduled_time", F.when(hit, F.lit(now).cast(dict(fixity.dtypes)["scheduled_time"])).otherwise(F.col("scheduled_time")))


def delete_scheduled(fixity: DataFrame, ids: list[int]) -> DataFrame:
    """Without the given records, unless they have been run."""
    return fixity.where(~(F.col("id").isin(*ids) & (F.col("status") == "scheduled")))


def outcome(problems: Column, failed: Column) -> Column:
    """error if the check itself failed, mismatch with any problem, else ok."""
    return F.when(failed, "error").when(problems > 0, "mismatch").otherwise("ok")


def audit(fixity: DataFrame, results: DataFrame, now: datetime) -> DataFrame:
    """All due checks at once: results (item, n_problems, failed, notes) close them; the next check of each item is added unless one is pending.

    A due check is closed by the id it is stored under, 0 too; one without an id can't be, and stays.
    """
    ready = due(fixity, now).join(results, "item").select("id", "item", "scheduled_time", outcome(F.col("n_problems"), F.col("failed")).alias("status"), results["notes"].alias("notes"))
    later = fixity.where((F.col("status") == "scheduled") & (F.col("scheduled_time") > _at(fixity, now))).select("item").distinct()
    kind = dict(fixity.dtypes)["scheduled_time"]
    at = scalars.jittered(F.lit(now).cast("timestamp"), F.col("item"), NEXT_EARLIEST_D * 86400, NEXT_LATEST_D * 86400)
    again = ready.select("item").distinct().join(later, "item", "left_anti").select("item", at.cast(kind).alias("scheduled_time"), F.lit("scheduled").alias("status"), F.lit("").alias("notes"))
    return _close(fixity, ready).unionByName(_append(fixity, again))


def counters(fixity: DataFrame) -> DataFrame:
    """Records of each status."""
    return fixity.groupBy("status").agg(F.count("*").alias("n"))
