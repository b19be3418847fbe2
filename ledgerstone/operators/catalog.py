"""Items, versions, slots and blobs: lookups, path resolution, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.functions import keys
from ledgerstone.schemas import ITEM_API, ITEM_INFO


def item_document(items: DataFrame, item: str) -> DataFrame:
    """The parsed document of one item."""
    return items.where(F.col("item") == item).limit(1).select("item", F.from_json("value", ITEM_INFO).alias("doc"))


def items_by_id(items: DataFrame, wanted: DataFrame) -> DataFrame:
    return items.join(wanted.select("item").distinct(), "item", "left_semi")


def blob(blobs: DataFrame, item: str, blobid: int) -> DataFrame:
    return blobs.where((F.col("item") == item) & (F.col("blobid") == blobid)).limit(1)


def max_blob(items: DataFrame, blobs: DataFrame) -> DataFrame:
    """The largest blob id of every item, 0 without blobs."""
    top = blobs.groupBy("item").agg(F.max("blobid").alias("max_blob"))
    return items.select("item").distinct().join(top, "item", "left").select("item", F.coalesce("max_blob", F.lit(0)).alias("max_blob"))


def max_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("item").agg(F.max("versionid").alias("max_version"))


def max_bundle(bundle_keys: DataFrame) -> DataFrame:
    """The largest bundle of each item among keys; keys that aren't bundles' are dropped."""
    parsed = bundle_keys.select(keys.bundle_item(F.col("key")).alias("item"), keys.bundle_number(F.col("key")).alias("n")).where("item <> ''")
    return parsed.groupBy("item").agg(F.max("n").alias("max_bundle"))


def distinct_items(bundle_keys: DataFrame) -> DataFrame:
    return bundle_keys.select(keys.bundle_item(F.col("key")).alias("item")).where("item <> ''").distinct()


def bundles_of(bundle_keys: DataFrame, item: str) -> DataFrame:
    """Keys of exactly this item: the prefix prunes, the parsed item decides."""
    return bundle_keys.where(F.col("key").startswith(item)).where(keys.bundle_item(F.col("key")) == item)


def slot_at(slots: DataFrame, blobs: DataFrame, version: int, name: str) -> DataFrame:
    """The blob rows behind one slot of one version, in all items."""
    return slots.where((F.col("versionid") == version) & (F.col("name") == name)).join(blobs, ["item", "blobid"])


def latest_slots(slots: DataFrame, versions: DataFrame) -> DataFrame:
    """The slots of each item's newest version."""
    top = max_version(versions).withColumnRenamed("max_version", "versionid")
    return slots.join(top, ["item", "versionid"])


def listing(slots: DataFrame, blobs: DataFrame) -> DataFrame:
    """Slots with their blobs' size, dates and type, in order of item and name; joined by blob id."""
    return slots.join(blobs, ["item", "blobid"]).orderBy("item", "name")


def resolve(paths: DataFrame, versions: DataFrame, slots: DataFrame, blobs: DataFrame) -> DataFrame:
    """paths (item, path) with ``blobid``: of @blob/N, @V/name or a name in the newest version; 0 if there is none."""
    parsed = paths.withColumn("_kind", keys.slot_kind(F.col("path")))
    direct = parsed.where("_kind = 'blob'").select("item", "path", keys.slot_blob(F.col("path")).alias("blobid"))
    found = direct.join(blobs.select("item", "blobid"), ["item", "blobid"], "left_semi")
    named = parsed.where("_kind <> 'blob'").join(max_version(versions), "item", "left")
    named = named.select("item", "path", F.when(F.col("_kind") == "version", keys.slot_version(F.col("path"))).otherwise(F.col("max_version")).alias("versionid"), keys.slot_path(F.col("path")).alias("name"))
    by_name = named.join(slots, ["item", "versionid", "name"]).select("item", "path", "blobid")
    hits = found.select("item", "path", "blobid").unionByName(by_name)
    return paths.join(hits, ["item", "path"], "left").select(*paths.columns, F.coalesce("blobid", F.lit(0)).alias("blobid"))


def rollup(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each item's size and first and last version dates."""
    dates = versions.groupBy("item").agg(F.min_by("created", "versionid").alias("created"), F.max_by("created", "versionid").alias("modified"))
    sizes = blobs.groupBy("item").agg(F.sum("size").alias("size"))
    return dates.join(sizes, "item", "left").select("item", "created", "modified", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def summary(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Counts of each item."""
    v = versions.groupBy("item").agg(F.count("*").alias("n_versions"))
    b = blobs.groupBy("item").agg(F.count("*").alias("n_blobs"), F.max("bundle").alias("max_bundle"))
    return v.join(b, "item", "full").select("item", F.coalesce("n_versions", F.lit(0)).alias("n_versions"), F.coalesce("n_blobs", F.lit(0)).alias("n_blobs"), F.coalesce("max_bundle", F.lit(0)).alias("max_bundle"))


def history(versions: DataFrame) -> DataFrame:
    """A line for each version."""
    note = F.when(F.coalesce("note", F.lit("")) == "", '""').otherwise(F.col("note"))
    line = F.format_string("@%02d %s %s %s", "versionid", F.date_format("created", "yyyy-MM-dd HH:mm:ss"), "creator", note)
    return versions.select("item", "versionid", line.alias("line"))


def payload_oxum(blobs: DataFrame) -> DataFrame:
    """``bytes.count`` of each bundle of live blobs."""
    live = blobs.where("bundle > 0").groupBy("item", "bundle").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))
    return live.select("item", "bundle", F.concat_ws(".", F.col("bytes").cast("string"), F.col("files").cast("string")).alias("oxum"))


def documents_to_tables(documents: DataFrame, api: bool = False) -> dict[str, DataFrame]:
    """Rows (value: JSON) as tables items, versions, slots, blobs; digests are hex in bundles, base64 from the API."""
    doc = documents.select(F.from_json("value", ITEM_API if api else ITEM_INFO).alias("d"))
    item = F.col("d.ID" if api else "d.ItemID").alias("item")
    vid, bid, size = ("ID", "ID", "Size") if api else ("VersionID", "BlobID", "ByteCount")
    raw = (lambda c: F.unbase64(c)) if api else (lambda c: F.unhex(c))
    unset = lambda c: F.when(c > F.lit("0001-01-02").cast("timestamp"), c)
    v = doc.select(item, F.explode("d.Versions").alias("v"))
    b = doc.select(item, F.explode("d.Blobs").alias("b"))
    blobs = b.select("item", F.col(f"b.{bid}").alias("blobid"), F.col(f"b.{size}").alias("size"), F.col("b.Bundle").alias("bundle"), unset(F.col("b.SaveDate")).alias("created"), F.col("b.Creator").alias("creator"), raw(F.col("b.MD5")).alias("md5"), raw(F.col("b.SHA256")).alias("sha256"), F.col("b.MimeType").alias("mimetype"), unset(F.col("b.DeleteDate")).alias("deleted"), F.col("b.Deleter").alias("deleter"), F.col("b.DeleteNote").alias("deletenote"))
    versions = v.select("item", F.col(f"v.{vid}").alias("versionid"), unset(F.col("v.SaveDate")).alias("created"), F.col("v.Creator").alias("creator"), F.col("v.Note").alias("note"))
    slots = v.select("item", F.col(f"v.{vid}").alias("versionid"), F.explode("v.Slots").alias("name", "blobid")).select("item", "versionid", "blobid", "name")
    return {"items": doc.select(item, F.col("d.MaxBundle").alias("max_bundle")), "versions": versions, "slots": slots, "blobs": blobs}


def tables_to_documents(versions: DataFrame, slots: DataFrame, blobs: DataFrame) -> DataFrame:
    """(item, value): the JSON document of each item, blobs and versions by id, the byte count summed."""
    by_version = slots.groupBy("item", "versionid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "blobid")))).alias("Slots"))
    v = versions.join(by_version, ["item", "versionid"], "left")
    v = v.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.col("versionid").alias("VersionID"), F.col("created").alias("SaveDate"), F.col("creator").alias("Creator"), F.col("note").alias("Note"), F.to_json("Slots").alias("S")))).alias("v"))
    entry = F.struct(F.col("blobid").alias("BlobID"), F.col("bundle").alias("Bundle"), F.col("size").alias("ByteCount"), F.lower(F.hex("md5")).alias("MD5"), F.lower(F.hex("sha256")).alias("SHA256"), F.col("mimetype").alias("MimeType"), F.col("created").alias("SaveDate"), F.col("creator").alias("Creator"), F.col("deleted").alias("DeleteDate"), F.col("deleter").alias("Deleter"), F.col("deletenote").alias("DeleteNote"))
    b = blobs.groupBy("item").agg(F.array_sort(F.collect_list(entry)).alias("Blobs"), F.sum("size").alias("ByteCount"), F.max("bundle").alias("MaxBundle"))
    made = F.transform("v", lambda x: F.struct(x["VersionID"].alias("VersionID"), x["SaveDate"].alias("SaveDate"), x["Creator"].alias("Creator"), x["Note"].alias("Note"), F.from_json(x["S"], "map<string,int>").alias("Slots")))
    return v.join(b, "item", "left").select("item", F.to_json(F.struct(F.col("item").alias("ItemID"), "ByteCount", "MaxBundle", made.alias("Versions"), "Blobs")).alias("value"))
