"""Files uploaded in fragments (file, seq, size, content): reading, sizes, rollback, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerstone.functions import scalars


def contents(fragments: DataFrame) -> DataFrame:
    """Each file's bytes, its fragments joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"])
    return fragments.groupBy("file").agg(F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("content"))


def stats(fragments: DataFrame) -> DataFrame:
    """Size and number of fragments of each file."""
    return fragments.groupBy("file").agg(F.sum("size").alias("size"), F.count("*").alias("n_fragments"))


def running_size(fragments: DataFrame) -> DataFrame:
    return fragments.withColumn("upto", F.sum("size").over(Window.partitionBy("file").orderBy("seq")))


def rollback(fragments: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Without the last fragment of the given files (all, if none are given)."""
    last = fragments.groupBy("file").agg(F.max("seq").alias("seq"))
    if files is not None:
        last = last.join(files.select("file").distinct(), "file", "left_semi")
    return fragments.join(last, ["file", "seq"], "left_anti")


def append(fragments: DataFrame, new: DataFrame) -> DataFrame:
    """new (file, order, content, md5_goal, sha_goal) in order after each file's last fragment; content that isn't what was stated is refused."""
    good = new.where(scalars.stream_verified(F.col("content"), F.col("md5_goal"), F.col("sha_goal")))
    top = fragments.groupBy("file").agg(F.max("seq").alias("_top"))
    n = F.row_number().over(Window.partitionBy("file").orderBy("order"))
    rows = good.withColumn("_n", n).join(top, "file", "left")
    return fragments.unionByName(rows.select("file", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int").alias("seq"), F.length("content").cast("long").alias("size"), "content"))


def verify(fragments: DataFrame, goals: DataFrame) -> DataFrame:
    """(file, verified) against goals (file, md5, sha256: binary, NULL or empty if not stated)."""
    rows = goals.join(contents(fragments), "file", "left")
    return rows.select("file", F.coalesce(scalars.stream_verified(F.coalesce("content", F.lit(b"")), F.col("md5"), F.col("sha256")), F.lit(False)).alias("verified"))
