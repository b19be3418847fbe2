"""The continuously running processes as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ledgerstone.operators import fixity as audits
from ledgerstone.operators.transactions import OPEN, advance


def ttl_sessions(log: DataFrame, ttl: str, late: str) -> DataFrame:
    """Lives of cache entries in a stream of accesses (key, ts): a session per key that ends ``ttl`` after its last access."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.session_window("ts", ttl)
    return timed.groupBy("key", window).agg(F.count("*").alias("uses")).select("key", F.col("session_window.start").alias("since"), F.col("session_window.end").alias("expires"), "uses")


def single_flight(loads: DataFrame, wait: str) -> DataFrame:
    """The first load of each key within the wait; others share its result."""
    return loads.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", wait).dropDuplicatesWithinWatermark(["key"])


def windowed_counters(log: DataFrame, width: str, late: str) -> DataFrame:
    """Accesses and bytes of each window of event time."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select(F.col("window.start").alias("start"), "n", "bytes")


class _Machine(StatefulProcessor):
    """Holds the status of one transaction."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status = self.status.get()[0] if self.status.exists() else OPEN
        for pdf in rows:
            for event in pdf.sort_values("position")["event"]:
                status = advance(status, event)
        self.status.update((status,))
        yield pd.DataFrame({"tx": [key[0]], "status": pd.Series([status], dtype="int32")})

    def close(self) -> None:
        pass


def transaction_status(events: DataFrame) -> DataFrame:
    """The status of each transaction after each batch of its events (tx, position, event). Needs the RocksDB state store."""
    kind = dict(events.dtypes)["tx"]
    return events.groupBy("tx").transformWithStateInPandas(statefulProcessor=_Machine(), outputStructType=f"tx {kind}, status int", outputMode="Update", timeMode="None")


def audit_loop(ticks: DataFrame, load: Callable[[], DataFrame], check: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch of ticks (now: timestamp) audits everything due by its latest tick and saves the table that results.

    check maps due records to results (item, n_problems, failed, notes); save
    writes under the batch's number, so a batch that is run again replaces its output.
    """

    def batch(df: DataFrame, number: int) -> None:
        now: datetime | None = df.agg(F.max("now")).first()[0]
        if now is not None:
            table = load()
            save(audits.audit(table, check(audits.due(table, now)), now), number)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retention(stream: DataFrame, ttl: str) -> DataFrame:
    """Things in a stream (key, ts) that were seen again within ``ttl`` of event time, dropped; state goes with the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])
