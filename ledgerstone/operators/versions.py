"""Order-dependent operators: carry-forward, gaps, first occurrences, next ids, bundle packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: written bytes from which on the next blob opens a new bundle.
BUNDLE_BYTES = 500_000_000
#: Digests of empty content.
EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def carry_forward(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """The slots of every version from changes (item, versionid, name, blobid; 0 removes): each starts from the one before."""
    grid = changes.select("item", "name").distinct().join(versions.select("item", "versionid"), "item")
    before = Window.partitionBy("item", "name").orderBy("versionid")
    filled = grid.join(changes, ["item", "name", "versionid"], "left").withColumn("blobid", F.last("blobid", True).over(before))
    return filled.where("blobid > 0").select("item", "versionid", "name", "blobid")


def id_gaps(blobs: DataFrame) -> DataFrame:
    """Items whose blob count isn't their largest id."""
    return blobs.groupBy("item").agg(F.count("*").alias("n_blobs"), F.max("blobid").alias("last_id")).where("n_blobs <> last_id")


def fill_gaps(blobs: DataFrame) -> DataFrame:
    """Blobs 1 to the largest id of each item; missing ones are empty and lie in the bundle of the next larger id."""
    top = blobs.groupBy("item").agg(F.max("blobid").alias("m"))
    every = top.select("item", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("blobid"))
    ahead = Window.partitionBy("item").orderBy("blobid").rowsBetween(0, Window.unboundedFollowing)
    joined = every.join(blobs.withColumn("_there", F.lit(True)), ["item", "blobid"], "left")
    there = F.col("_there").isNotNull()
    return joined.select("item", "blobid", F.when(there, F.col("size")).otherwise(0).alias("size"), F.first("bundle", True).over(ahead).alias("bundle"), F.when(there, F.col("md5")).otherwise(EMPTY_MD5).alias("md5"), F.when(there, F.col("sha256")).otherwise(EMPTY_SHA256).alias("sha256"), (~there).alias("filled"))


def next_ids(existing: DataFrame, new: DataFrame, id_: str, order: list[str]) -> DataFrame:
    """new with ids that go on from each item's largest."""
    top = existing.groupBy("item").agg(F.max(id_).alias("_top"))
    n = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return new.withColumn("_n", n).join(top, "item", "left").withColumn(id_, (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int")).drop("_n", "_top")


def free_ids(used: DataFrame, wanted: int) -> DataFrame:
    """The first ``wanted`` four-digit ids that aren't in used (id)."""
    spark = used.sparkSession
    near = used.where(F.col("id").rlike("^[0-9]{4,}$"))
    n = wanted + near.count()
    ids = spark.range(n).select(F.format_string("%04d", F.col("id")).alias("id"))
    return ids.join(near.select("id").distinct(), "id", "left_anti").orderBy(F.length("id"), "id").limit(wanted)


def first_occurrence(blobs: DataFrame) -> DataFrame:
    """Each blob's canonical blob: the least id of its item with the same size and digests; empty or undigested blobs stand alone."""
    digested = (F.coalesce(F.length("md5"), F.lit(0)) + F.coalesce(F.length("sha256"), F.lit(0))) > 0
    content = [F.coalesce(F.hex(c), F.lit("")) for c in ("md5", "sha256")]
    rows = blobs.select("item", "blobid", "size", F.concat_ws("+", *content).alias("_c"), ((F.col("size") > 0) & digested).alias("_same"))
    # An aggregate and a join instead of a window: a content of any number of blobs is one row.
    first = rows.where("_same").groupBy("item", "size", "_c").agg(F.min("blobid").alias("_first"))
    return rows.join(first, ["item", "size", "_c"], "left").select("item", "blobid", F.when(F.col("_same"), F.col("_first")).otherwise(F.col("blobid")).alias("canonical"))


def pack_bundles(blobs: DataFrame, first: int = 1, cutoff: int = BUNDLE_BYTES) -> DataFrame:
    """blobs (item, blobid, size) with ``bundle``: a new one begins before a blob if its predecessor's bundle holds the cutoff.

    Whether a bundle is full depends on where it began, so the blobs of an
    item are folded in order; rows stream through sorted partitions and only
    the current item's total is held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item, bundle, held = None, first, 0
        for pdf in batches:
            out = []
            for key, size in zip(pdf["item"], pdf["size"], strict=True):
                if key != item:
                    item, bundle, held = key, first, 0
                if held >= cutoff:
                    bundle, held = bundle + 1, 0
                held += int(size)
                out.append(bundle)
            yield pdf.assign(bundle=pd.Series(out, dtype="int32"))

    rows = blobs.select("item", "blobid", "size").repartition("item").sortWithinPartitions("item", "blobid")
    return rows.mapInPandas(fold, f"item string, blobid {dict(blobs.dtypes)['blobid']}, size long, bundle int")


def duplicate_groups(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def without_duplicate_groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return rows.join(duplicate_groups(rows, key), key, "left_anti")
