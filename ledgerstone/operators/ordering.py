"""Lineage cuts in the shared folder, and numbers and sums over a total order without single-task windows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only on a local master without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgerstone-")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        found = f"file://{found}"
    return found


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, sizes are known to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/ledgerstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(discard, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table; quiet once the session has ended."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ordered(df: DataFrame, keys: list[str | Column], name: str = "order") -> DataFrame:
    """df written in a total order with ``_part`` and ``_row``: range partitions on all keys, so no key fills a task."""
    df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    return materialize(df.withColumn("_at", at), name).withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))


def offsets(df: DataFrame, group: list[str], values: dict[str, Column], name: str = "order") -> DataFrame:
    """Exclusive running sums ``values`` within ``group`` for a frame from ``ordered()``.

    Sums are first taken per (range partition, group), then over the few
    partitions of a group, then over the rows of one partition, so the
    largest window holds one range partition's rows or one row per partition.
    """
    local = Window.partitionBy("_part", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("_part", *group).agg(*[F.sum(v).alias(f"_p_{k}") for k, v in values.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *group, *[F.coalesce(F.sum(f"_p_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
    right = parts.select(F.col("_part").alias("_q"), *[F.col(g).alias(f"_g_{g}") for g in group], *[f"_b_{k}" for k in values])
    match = F.col("_part") == F.col("_q")
    for g in group:
        match &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = df.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_l_{k}") for k, v in values.items()]).join(right, match)
    out = out.select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_b_{k}")).alias(k) for k in values])
    return out.drop("_part", "_row", "_at")


def row_numbers(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with ``name`` (long, from 1): its rows' places in the order of keys, whose ties may fall either way."""
    return offsets(ordered(df, keys), [], {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + 1)
