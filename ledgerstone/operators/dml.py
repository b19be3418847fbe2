"""Changes to tables as merges: every function returns the table after the change; write it to a new path."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.operators.catalog import rollup


def upsert_items(items: DataFrame, versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """items with the rollups of the given items in place of theirs."""
    new = rollup(versions, blobs)
    return items.join(new, "item", "left_anti").select(*new.columns).unionByName(new)


def upsert_blobs(stored: DataFrame, incoming: DataFrame, refresh_size: bool = False) -> DataFrame:
    """Ids above an item's largest are inserted; known ones take bundle, type and deletion from incoming, but not size or digests.

    Ids below the largest that the table lacks are left out, as updates that
    meet no row. refresh_size takes the size too.
    """
    top = stored.groupBy("item").agg(F.max("blobid").alias("_top"))
    changed = ["bundle", "mimetype", "deleted", "deleter", "deletenote", *(["size"] if refresh_size else [])]
    new = incoming.select("item", "blobid", *[F.col(c).alias(f"_{c}") for c in changed], F.lit(True).alias("_hit"))
    old = stored.join(new, ["item", "blobid"], "left")
    old = old.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in stored.columns])
    more = incoming.join(top, "item", "left").where(F.col("blobid") > F.coalesce("_top", F.lit(0))).select(*stored.columns)
    return old.unionByName(more)


def append_versions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Only versions above an item's largest are added; works for slots too."""
    top = stored.groupBy("item").agg(F.max("versionid").alias("_top"))
    more = incoming.join(top, "item", "left").where(F.col("versionid") > F.coalesce("_top", F.lit(0))).select(*stored.columns)
    return stored.unionByName(more)


def tombstone(blobs: DataFrame, requests: DataFrame, now: datetime) -> DataFrame:
    """Deleted blobs lose bundle, size and type but keep their digests; requests (item, blobid, deleter, note), repeated ones count once."""
    once = requests.groupBy("item", "blobid").agg(F.min("deleter").alias("_by"), F.min("note").alias("_note"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull() & F.col("deleted").isNull()
    new = {"deleted": F.lit(now), "deleter": F.col("_by"), "deletenote": F.col("_note"), "bundle": F.lit(0), "size": F.lit(0), "mimetype": F.lit("")}
    kinds = dict(blobs.dtypes)
    return blobs.join(once, ["item", "blobid"], "left").select(*[F.when(hit, new[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in blobs.columns])


def bundle_survivors(blobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Blobs that a bundle keeps when it is rewritten; bundles without deletions aren't rewritten."""
    gone = requests.select("item", "blobid").distinct()
    touched = blobs.join(gone, ["item", "blobid"], "left_semi").select("item", "bundle").distinct()
    return blobs.join(touched, ["item", "bundle"], "left_semi").join(gone, ["item", "blobid"], "left_anti")


def set_mime(blobs: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (item, blobid, mime); missing and deleted blobs are left alone."""
    new = changes.groupBy("item", "blobid").agg(F.max("mime").alias("_mime"))
    return blobs.join(new, ["item", "blobid"], "left").select(*[F.when(F.col("deleted").isNull(), F.coalesce("_mime", "mimetype")).otherwise(F.col(c)).alias(c) if c == "mimetype" else F.col(c) for c in blobs.columns])


def patch_uploads(files: DataFrame, patches: DataFrame, now: datetime) -> DataFrame:
    """Non-empty fields of patches (id, extra, mimetype) replace a file's; its modified time moves."""
    p = patches.select("id", F.nullif("extra", F.lit("")).alias("_extra"), F.nullif("mimetype", F.lit("")).alias("_mime"), F.lit(True).alias("_hit"))
    return files.join(p, "id", "left").select(*[{"extra": F.coalesce("_extra", "extra"), "mimetype": F.coalesce("_mime", "mimetype"), "modified": F.when(F.col("_hit"), F.lit(now).cast(dict(files.dtypes).get("modified", "timestamp"))).otherwise(F.col("modified"))}.get(c, F.col(c)).alias(c) for c in files.columns])


def set_file_fields(files: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """Fields of changes (id, creator, md5, sha256, mimetype, extra; one row of a file) that aren't null replace a file's, empty ones too; its modified time moves."""
    names = ["creator", "md5", "sha256", "mimetype", "extra"]
    c = changes.select("id", *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_hit"))
    new = {n: F.coalesce(f"_{n}", n) for n in names} | {"modified": F.when(F.col("_hit"), F.lit(now).cast(dict(files.dtypes)["modified"])).otherwise(F.col("modified"))}
    return files.join(c, "id", "left").select(*[new[n].alias(n) if n in new else F.col(n) for n in files.columns])


def last_note(commands: DataFrame) -> DataFrame:
    """The note that stays of each transaction: the last one."""
    return commands.where("verb = 'note'").groupBy("tx").agg(F.max_by("arg", "position").alias("note"))


def commit_version(slots: DataFrame, versions: DataFrame, overlay: DataFrame, creator: str, note: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Versions and slots after one more version of each item in overlay (item, name, blobid; 0 removes)."""
    top = versions.groupBy("item").agg(F.max("versionid").alias("_top"))
    new = overlay.select("item").distinct().join(top, "item", "left").select("item", F.coalesce("_top", F.lit(0)).alias("_top"))
    kind = dict(versions.dtypes)["created"]
    row = new.select("item", (F.col("_top") + 1).cast("int").alias("versionid"), F.lit(now).cast(kind).alias("created"), F.lit(creator).alias("creator"), F.lit(note).alias("note"))
    base = slots.join(new, "item").where(F.col("versionid") == F.col("_top")).select("item", "name", F.col("blobid").alias("_old"))
    merged = base.join(overlay.select("item", "name", F.col("blobid").alias("_new")), ["item", "name"], "full").withColumn("blobid", F.coalesce("_new", "_old")).where("blobid > 0")
    added = merged.join(new, "item").select("item", (F.col("_top") + 1).cast("int").alias("versionid"), "blobid", "name")
    return versions.unionByName(row), slots.unionByName(added.select(*slots.columns))
