"""Comparing trees and lists: upload planning, overlays, merges, checksum diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.operators.ordering import row_numbers


def plan_upload(local: DataFrame, remote: DataFrame) -> DataFrame:
    """What each local file (name, md5, mime) needs against the remote (name, md5, mime, blobid).

    same: nothing; mime: another type; relink: content is there under another
    name; new: content isn't there, and this name is the first with it locally;
    local_dup: another local name uploads it.
    """
    there = remote.select("name", F.col("md5").alias("_md5"), F.col("mime").alias("_mime"), F.col("blobid").alias("_blob"))
    # By content, both sides aggregated before the join: a content that a third of all files share is one row here.
    content = remote.groupBy("md5").agg(F.min("blobid").alias("_any"))
    first = local.groupBy("md5").agg(F.min("name").alias("_first")).join(content, "md5", "left")
    rows = local.join(there, "name", "left").join(first, "md5", "left")
    same = F.col("md5").eqNullSafe(F.col("_md5"))
    action = F.when(same & F.col("mime").eqNullSafe(F.col("_mime")), "same").when(same, "mime").when(F.col("_any").isNotNull(), "relink").when(F.col("name") == F.coalesce("_first", "name"), "new").otherwise("local_dup")
    return rows.select("name", "md5", "mime", action.alias("action"), F.when(same, F.col("_blob")).otherwise(F.col("_any")).alias("blobid"))


def overlay_distinct(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.select("key").union(remote.select("key")).distinct()


def overlay_all(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.select("key").unionAll(remote.select("key"))


def overlay_lookup(local: DataFrame, remote: DataFrame) -> DataFrame:
    """key, value, origin: local rows hide remote ones."""
    r = remote.select("key", F.col("value").alias("_v"), F.lit(True).alias("_r"))
    rows = local.withColumn("_l", F.lit(True)).join(r, "key", "full")
    mine = F.col("_l").isNotNull()
    return rows.select("key", F.when(mine, F.col("value")).otherwise(F.col("_v")).alias("value"), F.when(mine, "local").otherwise("remote").alias("origin"))


def merge_lists(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lists (name, md5, sha256, mime) merged by name: non-empty new fields win, but a digest in conflict stays as it was and is flagged."""
    n = new.select("name", *[F.col(c).alias(f"_{c}") for c in ("md5", "sha256", "mime")])
    full = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    kept = lambda c: F.when(full(c), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    clash = F.lit(False)
    for c in ("md5", "sha256"):
        clash |= full(c) & full(f"_{c}") & (F.col(c) != F.col(f"_{c}"))
    mime = F.when(full("_mime"), F.col("_mime")).otherwise(F.col("mime")).alias("mime")
    return old.join(n, "name", "full").select("name", kept("md5"), kept("sha256"), mime, F.coalesce(clash, F.lit(False)).alias("conflict"))


def available(wanted: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows of remote whose name is wanted."""
    return remote.join(wanted.select("name").distinct(), "name", "left_semi")


def checksum_diff(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed files (path, checksum) that the store lacks or holds with another checksum."""
    s = stored.select("path", F.col("checksum").alias("_stored"))
    rows = listed.join(s, "path", "left").where(F.col("_stored").isNull() | (F.col("_stored") != F.col("checksum")))
    return rows.select("path", "checksum", F.when(F.col("_stored").isNull(), "absent").otherwise("differs").alias("reason"))


def blob_by_content(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """files (name, size, sha256) with the least blob id of the same size and digest, NULL if none; equal sizes come first."""
    b = blobs.where("size > 0").groupBy("size", "sha256").agg(F.min("blobid").alias("blobid"))
    return files.join(b, ["size", "sha256"], "left").select("name", "size", "sha256", "blobid")


def add_files(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """The slots of added files: a known content's blob, or new ids after the largest, one for each new content."""
    known = blob_by_content(files, blobs)
    fresh = known.where("blobid is null").groupBy("size", "sha256").agg(F.min("name").alias("_by"))
    top = blobs.agg(F.coalesce(F.max("blobid"), F.lit(0)).alias("_top"))
    fresh = row_numbers(fresh, ["_by"], "_n").join(F.broadcast(top)).select("size", "sha256", (F.col("_top") + F.col("_n")).cast("int").alias("_new"))
    return known.join(fresh, ["size", "sha256"], "left").select("name", F.coalesce("blobid", "_new").alias("blobid"), F.col("_new").isNotNull().alias("is_new"))


def first_local(local: DataFrame) -> DataFrame:
    """Which name of each content uploads it."""
    first = local.groupBy("md5").agg(F.min("name").alias("_first"))
    return local.join(first, "md5").withColumn("is_first", F.col("name") == F.col("_first")).drop("_first")
