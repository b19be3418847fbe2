"""Queries that resolve and roll up items, versions, slots and blobs."""

from pyspark.sql import functions as F

from ledgerstone.functions import keys
from ledgerstone.operators import catalog as ct
from ledgerstone.plans.registry import add
from ledgerstone.sources import stores

_TOP = "(SELECT item, max(versionid) AS versionid FROM ver GROUP BY item)"
add("max_version", lambda v: ct.max_version(v.ver), "ver", "SELECT item, max(versionid) AS max_version FROM ver GROUP BY item")
add("max_blob", lambda v: ct.max_blob(v.ver, v.slo), "slo", "SELECT v.item, coalesce(max(s.blobid), 0) AS max_blob FROM (SELECT DISTINCT item FROM ver) v LEFT JOIN slo s ON v.item = s.item GROUP BY v.item")
add("bundle_max_per_item", lambda v: ct.max_bundle(v.keys), "keys", "SELECT regexp_extract(key, '^(.*)-([0-9]+)[.]zip$', 1) AS item, max(CAST(regexp_extract(key, '^(.*)-([0-9]+)[.]zip$', 2) AS INT)) AS max_bundle FROM keys GROUP BY 1")
add("distinct_items", lambda v: ct.distinct_items(v.keys), "keys", "SELECT DISTINCT regexp_extract(key, '^(.*)-([0-9]+)[.]zip$', 1) AS item FROM keys")
add("slug_prefix_filter", lambda v: ct.bundles_of(v.keys, "c1"), "keys", "SELECT key FROM keys WHERE regexp_matches(key, '^c1-[0-9]+[.]zip$')")
add("store_prefix", lambda v: stores.with_prefix(v.keys, "c12"), "keys", "SELECT key FROM keys WHERE starts_with(key, 'c12')")
add("namespace_strip", lambda v: stores.namespace(v.keys, "c1"), "keys", "SELECT substr(key, 3) AS key FROM keys WHERE starts_with(key, 'c1')")
add("item_rollup", lambda v: ct.rollup(v.ver, v.pblo), "ver pblo", "SELECT v.item, arg_min(v.created, v.versionid) AS created, arg_max(v.created, v.versionid) AS modified, CAST(coalesce(any_value(b.size), 0) AS BIGINT) AS size FROM ver v LEFT JOIN (SELECT item, sum(size) AS size FROM pblo GROUP BY item) b ON v.item = b.item GROUP BY v.item")
add("item_summary", lambda v: ct.summary(v.ver, v.pblo), "ver pblo", "SELECT coalesce(v.item, b.item) AS item, coalesce(nv, 0) AS n_versions, coalesce(nb, 0) AS n_blobs, coalesce(mb, 0) AS max_bundle FROM (SELECT item, count(*) AS nv FROM ver GROUP BY item) v FULL JOIN (SELECT item, count(*) AS nb, max(bundle) AS mb FROM pblo GROUP BY item) b ON v.item = b.item")
add("payload_oxum", lambda v: ct.payload_oxum(v.pblo), "pblo", "SELECT item, bundle, CAST(sum(size) AS VARCHAR) || '.' || count(*) AS oxum FROM pblo WHERE bundle > 0 GROUP BY item, bundle")
add("blob_lookup", lambda v: ct.blob(v.blo, "src3", 2), "blo", "SELECT * FROM blo WHERE item = 'src3' AND blobid = 2")
add("slot_lookup_version", lambda v: ct.slot_at(v.slo, v.pblo, 2, "ln3"), "slo pblo", "SELECT b.item, b.blobid, s.versionid, s.name, b.size, b.bundle, b.mimetype, b.creator FROM slo s JOIN pblo b ON s.item = b.item AND s.blobid = b.blobid WHERE s.versionid = 2 AND s.name = 'ln3'")
add("slot_lookup_latest", lambda v: ct.latest_slots(v.slo, v.ver).join(v.pblo, ["item", "blobid"]).select("item", "versionid", "name", "blobid", "size"), "slo pblo", f"SELECT s.item, s.versionid, s.name, s.blobid, b.size FROM slo s JOIN {_TOP} t ON s.item = t.item AND s.versionid = t.versionid JOIN pblo b ON s.item = b.item AND s.blobid = b.blobid")
add("ls_latest", lambda v: ct.listing(ct.latest_slots(v.slo, v.ver), v.pblo).select("item", "name", "size", "mimetype", "bundle"), "slo pblo", f"SELECT s.item, s.name, b.size, b.mimetype, b.bundle FROM slo s JOIN {_TOP} t ON s.item = t.item AND s.versionid = t.versionid JOIN pblo b ON s.item = b.item AND s.blobid = b.blobid")
add("remote_list", lambda v: v.slo.join(v.pblo, ["item", "blobid"]).select("item", "versionid", "name", "mimetype"), "slo pblo", "SELECT s.item, s.versionid, s.name, b.mimetype FROM slo s JOIN pblo b ON s.item = b.item AND s.blobid = b.blobid")
_PATHS = lambda v: v.ver.select("item").distinct().select("item", F.explode(F.array(*[F.lit(x) for x in ("ln1", "@1/ln1", "@2/ln2", "@blob/7", "@blob/0x7", "@99/ln1", "@blob/")])).alias("path"))
add("extended_slot", lambda v: ct.resolve(_PATHS(v), v.ver, v.slo, v.pblo), "slo pblo", f"""
    , p AS (SELECT item, unnest(['ln1', '@1/ln1', '@2/ln2', '@blob/7', '@blob/0x7', '@99/ln1', '@blob/']) AS path FROM (SELECT DISTINCT item FROM ver)),
    q AS (SELECT p.item, p.path, CASE WHEN starts_with(path, '@blob/') THEN NULL WHEN path LIKE '@%/%' THEN CAST(regexp_extract(path, '^@([0-9]+)/', 1) AS INT) ELSE t.versionid END AS vid,
                 CASE WHEN path LIKE '@%/%' THEN regexp_extract(path, '^@[^/]*/(.*)$', 1) ELSE path END AS name,
                 TRY_CAST(CASE WHEN regexp_matches(path, '^@blob/[0-9]+$') THEN substr(path, 7) END AS INT) AS b FROM p JOIN {_TOP} t ON p.item = t.item)
    SELECT q.item, q.path, coalesce(s.blobid, x.blobid, 0) AS blobid FROM q LEFT JOIN slo s ON q.item = s.item AND q.vid = s.versionid AND q.name = s.name LEFT JOIN pblo x ON q.item = x.item AND q.b = x.blobid""")
add("version_history", lambda v: ct.history(v.ver), "ver", "SELECT item, versionid, printf('@%02d %s %s %s', versionid, strftime(created, '%Y-%m-%d %H:%M:%S'), creator, CASE WHEN note = '' THEN '\"\"' ELSE note END) AS line FROM ver")
add("items_by_id", lambda v: ct.items_by_id(v.ver, v.ver.where("versionid = 12")), "ver", "SELECT * FROM ver WHERE item IN (SELECT item FROM ver WHERE versionid = 12)")
add("newest_version", lambda v: v.ver.groupBy("item").agg(F.max_by("note", "versionid").alias("note")), "ver", "SELECT item, arg_max(note, versionid) AS note FROM ver GROUP BY item")
add("key_sugar", lambda v: v.ver.select("item", "versionid", keys.bundle_key(F.col("item"), F.col("versionid") * 997).alias("key")), "ver", "SELECT item, versionid, printf('%s-%04d.zip', item, versionid * 997) AS key FROM ver")
add("key_desugar", lambda v: v.keys.select("key", keys.bundle_item(F.col("key")).alias("item"), keys.bundle_number(F.col("key")).alias("n")), "keys", "SELECT key, regexp_extract(key, '^(.*)-([0-9]+)[.]zip$', 1) AS item, CAST(regexp_extract(key, '^(.*)-([0-9]+)[.]zip$', 2) AS INT) AS n FROM keys")
add("subdir", lambda v: v.keys.select("key", keys.pair_tree(F.col("key")).alias("dir")), "keys", "SELECT key, substr(key, 1, 2) || '/' || substr(key, 3, 2) || '/' AS dir FROM keys")
add("key_valid", lambda v: v.table("part").select(F.col("p_partkey").alias("id"), keys.key_valid(F.col("p_name")).alias("whole"), keys.key_valid(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("joined")), "", "SELECT p_partkey AS id, NOT regexp_matches(p_name, '[/\\s]') AS whole, NOT regexp_matches(replace(p_name, ' ', '-'), '[/\\s]') AS joined FROM part")
add("blob_names", lambda v: v.slo.select("item", "versionid", "name", keys.blob_number(F.concat(F.lit("blob/"), "blobid")).alias("from_blob"), keys.blob_number("name").alias("from_name")), "slo", "SELECT item, versionid, name, blobid AS from_blob, CAST(0 AS INT) AS from_name FROM slo")
add("cache_keys", lambda v: v.slo.select("item", "versionid", "name", keys.numbered_key(F.col("item"), F.col("blobid")).alias("cache_key"), keys.etag(F.col("blobid")).alias("etag"), keys.upload_key(F.col("item"), F.md5("name")).alias("upload")), "slo", "SELECT item, versionid, name, printf('%s+%04d', item, blobid) AS cache_key, '\"' || blobid || '\"' AS etag, item || '-' || md5(name) AS upload FROM slo")
add("slot_names", lambda v: v.table("pages").select("page_id", keys.slot_name(F.col("url"), "http://").alias("inner"), keys.slot_name(F.col("url")).alias("plain")), "", "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN regexp_replace(substr(url, 8), '^/', '') ELSE url END AS inner, regexp_replace(url, '^/', '') AS plain FROM pages")
