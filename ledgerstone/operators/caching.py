"""Replays of caches over access logs (key, ts, size): time to live, least recently used, size heads, errors, rates."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values in seconds: life of a known size and of a missing one, of an error, wait for one load.
SIZE_TTL, MISSING_TTL, ERROR_TTL, LOAD_WAIT = 240 * 3600, 3 * 3600, 30, 60


def _in_order(log: DataFrame) -> Window:
    """Each key's accesses by time; of equal times, the smaller size comes first."""
    return Window.partitionBy("key").orderBy("ts", *[c for c in ("size",) if c in log.columns])


def _gap(log: DataFrame) -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(_in_order(log)).cast("timestamp"))


def ttl_hits(log: DataFrame, ttl_s: float) -> DataFrame:
    """log with ``hit``: the key was used less than the time to live before."""
    return log.withColumn("hit", F.coalesce(_gap(log) < int(ttl_s * 1_000_000), F.lit(False)))


def lru_replay(log: DataFrame, most: int) -> DataFrame:
    """log with hit, stored and evicted (entries) of one cache of ``most`` bytes.

    One cache is one sequence: the log is
    brought to a single task, sorted and replayed in order, whose memory is the cache's keys. To
    replay many caches at once, call it for each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = OrderedDict(), 0
        for pdf in batches:
            out = []
            for key, size in zip(pdf["key"], pdf["size"], strict=True):
                if key in held:
                    held.move_to_end(key)
                    out.append((True, True, 0))
                    continue
                evicted = 0
                if size > most:
                    out.append((False, False, 0))
                    continue
                while total + size > most:
                    total -= held.popitem(last=False)[1]
                    evicted += 1
                held[key] = size
                total += size
                out.append((False, True, evicted))
            yield pdf.assign(hit=[o[0] for o in out], stored=[o[1] for o in out], evicted=pd.Series([o[2] for o in out], dtype="int32"))

    rows = log.select("key", "ts", F.col("size").cast("long").alias("size")).repartition(1).sortWithinPartitions("ts", "key", "size")
    kinds = dict(log.dtypes)
    return rows.mapInPandas(run, f"key {kinds['key']}, ts {kinds['ts']}, size long, hit boolean, stored boolean, evicted int")


def size_heads(log: DataFrame) -> DataFrame:
    """Lookups (key, ts, size; -1: missing) with ``hit`` under the lives of known and missing sizes."""
    before = F.lag("size").over(_in_order(log))
    life = F.when(before < 0, MISSING_TTL * 1_000_000).otherwise(SIZE_TTL * 1_000_000)
    return log.withColumn("hit", F.coalesce(_gap(log) < life, F.lit(False)))


def error_ledger(errors: DataFrame, lookups: DataFrame) -> DataFrame:
    """lookups (key, ts) with the newest error (key, ts, error) of the key in the seconds before."""
    e = errors.select("key", "ts", "error").withColumn("_look", F.lit(0))
    q = lookups.select("key", "ts").withColumn("error", F.lit(None).cast("string")).withColumn("_look", F.lit(1))
    before = Window.partitionBy("key").orderBy("ts", "_look").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("_look") == 0, F.struct("ts", "error"))
    rows = e.unionByName(q).withColumn("_e", F.last(mark, True).over(before)).where("_look = 1")
    fresh = F.col("_e.ts") > F.col("ts") - F.expr(f"interval {ERROR_TTL} seconds")
    return rows.select("key", "ts", F.when(fresh, F.col("_e.error")).alias("error"))


def single_flight(loads: DataFrame, wait_s: int = LOAD_WAIT) -> DataFrame:
    """loads (key, ts) with ``leads``: no load of the key within the wait before it shares its result."""
    return loads.withColumn("leads", F.coalesce(_gap(loads) > wait_s * 1_000_000, F.lit(True)))


def rate_credit(uses: DataFrame, per_minute: int, burst: int) -> DataFrame:
    """Credit after each minute of uses (minute: long, used): refilled each minute to the burst at most; may go negative.

    One row a minute: the window's rows grow with the time that uses span, not with the uses.
    """
    total = Window.orderBy("minute")
    spent = F.sum("used").over(total)
    gain = (F.col("minute") - F.min("minute").over(total)) * per_minute
    level = gain - spent + F.col("used")  # before this minute's use, without the cap
    over = F.greatest(F.lit(0), F.max(level).over(total))
    return uses.withColumn("credit", F.lit(burst) + gain - spent - over)


def hit_counters(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum("size").alias("bytes"))


def index_union(saved: DataFrame, listed: DataFrame) -> DataFrame:
    """A saved cache index (key, size, expires) and the store's keys that it lacks, which expire at once."""
    more = listed.join(saved, "key", "left_anti").select("key", "size", F.lit(None).cast(dict(saved.dtypes)["expires"]).alias("expires"))
    return saved.select("key", "size", "expires").unionByName(more)
