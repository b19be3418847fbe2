"""Queries that depend on the order of versions and blobs."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerstone.operators import dml
from ledgerstone.operators import versions as vs
from ledgerstone.plans.registry import add

NOW = datetime(2024, 1, 15, 12)
_T = "TIMESTAMP '2024-01-15 12:00:00'"
_CHANGES = lambda v: v.slo.select("item", "versionid", "name", F.when(F.col("blobid") % 4 == 0, 0).otherwise(F.col("blobid")).alias("blobid"))
add("slot_carry_forward", lambda v: vs.carry_forward(_CHANGES(v), v.ver), "slo", """
    , ch AS (SELECT item, versionid, name, CASE WHEN blobid % 4 = 0 THEN 0 ELSE blobid END AS blobid FROM slo),
    g AS (SELECT n.item, v.versionid, n.name FROM (SELECT DISTINCT item, name FROM ch) n JOIN ver v ON n.item = v.item),
    f AS (SELECT g.item, g.versionid, g.name, last_value(ch.blobid IGNORE NULLS) OVER (PARTITION BY g.item, g.name ORDER BY g.versionid) AS blobid FROM g LEFT JOIN ch ON g.item = ch.item AND g.versionid = ch.versionid AND g.name = ch.name)
    SELECT * FROM f WHERE blobid > 0""")
_HOLES = lambda v: v.blo.where("blobid % 7 <> 3")
add("id_gaps", lambda v: vs.id_gaps(_HOLES(v)), "blo", "SELECT item, count(*) AS n_blobs, max(blobid) AS last_id FROM blo WHERE blobid % 7 <> 3 GROUP BY item HAVING count(*) <> max(blobid)")
add("gap_fill", lambda v: vs.fill_gaps(_HOLES(v)), "blo", f"""
    , h AS (SELECT * FROM blo WHERE blobid % 7 <> 3),
    e AS (SELECT item, CAST(unnest(range(1, m + 1)) AS INT) AS blobid FROM (SELECT item, max(blobid) AS m FROM h GROUP BY item))
    SELECT e.item, e.blobid, CASE WHEN h.item IS NULL THEN 0 ELSE h.size END AS size, first_value(h.bundle IGNORE NULLS) OVER (PARTITION BY e.item ORDER BY e.blobid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bundle,
           CASE WHEN h.item IS NULL THEN '{vs.EMPTY_MD5}' ELSE h.md5 END AS md5, CASE WHEN h.item IS NULL THEN '{vs.EMPTY_SHA256}' ELSE h.sha256 END AS sha256, h.item IS NULL AS filled
    FROM e LEFT JOIN h ON e.item = h.item AND e.blobid = h.blobid""")
add("first_occurrence", lambda v: vs.first_occurrence(v.blo), "blo", "SELECT item, blobid, CASE WHEN size > 0 AND length(md5) + length(sha256) > 0 THEN min(blobid) OVER (PARTITION BY item, size, md5, sha256) ELSE blobid END AS canonical FROM blo")
add("next_id", lambda v: vs.next_ids(v.ver.where("versionid <= 3"), v.ver.where("versionid > 3").select("item", "created", "orderkey"), "versionid", ["created", "orderkey"]), "ver", "SELECT item, created, orderkey, versionid FROM ver WHERE versionid > 3")
add("free_ids", lambda v: vs.free_ids(v.ver.select(F.format_string("%04d", F.col("orderkey") * 2).alias("id")), 100), "ver", "SELECT id FROM (SELECT printf('%04d', i) AS id, i FROM range(100000) t(i)) WHERE id NOT IN (SELECT printf('%04d', orderkey * 2) FROM ver) ORDER BY i LIMIT 100")
add("dup_groups", lambda v: vs.duplicate_groups(v.blo, ["md5"]), "blo", "SELECT md5, count(*) AS n FROM blo GROUP BY md5 HAVING count(*) > 1")
add("drop_dup_groups", lambda v: vs.without_duplicate_groups(v.blo, ["md5"]).select("item", "blobid", "md5"), "blo", "SELECT item, blobid, md5 FROM blo WHERE md5 NOT IN (SELECT md5 FROM blo GROUP BY md5 HAVING count(*) > 1)")
add("bundle_packing", lambda v: vs.pack_bundles(v.blo.where("size > 0"), cutoff=20_000), "blo", """
    , b AS (SELECT item, blobid, size, row_number() OVER (PARTITION BY item ORDER BY blobid) AS n FROM blo WHERE size > 0),
    f AS (SELECT item, blobid, size, n, 1 AS bundle, size AS held FROM b WHERE n = 1
          UNION ALL
          SELECT b.item, b.blobid, b.size, b.n, f.bundle + CAST(f.held >= 20000 AS INT), CASE WHEN f.held >= 20000 THEN b.size ELSE f.held + b.size END
          FROM f JOIN b ON b.item IS NOT DISTINCT FROM f.item AND b.n = f.n + 1)
    SELECT item, blobid, size, CAST(bundle AS INT) AS bundle FROM f""")
add("blob_order", lambda v: v.blo.select("item", "blobid", "size").orderBy("item", "blobid"), "blo", "SELECT item, blobid, size FROM blo ORDER BY item, blobid")

_STORED = lambda v: v.blo.where("blobid <= 20")
_COMING = lambda v: v.blo.where("blobid > 15").withColumn("mimetype", F.lit("new")).withColumn("size", F.lit(5).cast("long"))
add("blob_upsert", lambda v: dml.upsert_blobs(_STORED(v), _COMING(v)), "blo", "SELECT * REPLACE (CASE WHEN blobid > 15 THEN 'new' ELSE mimetype END AS mimetype, CASE WHEN blobid > 20 THEN 5 ELSE size END AS size) FROM blo")
add("version_append", lambda v: dml.append_versions(v.ver.where("versionid <= 4"), v.ver.where("versionid >= 3").withColumn("note", F.lit("x"))), "ver", "SELECT item, versionid, created, creator, CASE WHEN versionid > 4 THEN 'x' ELSE note END AS note, orderkey FROM ver")
_GONE = lambda v: v.blo.where("blobid % 9 = 0").select("item", "blobid", F.lit("bob").alias("deleter"), F.lit("why").alias("note"))
_G = "blobid % 9 = 0 AND deleted IS NULL"
add("tombstone_blobs", lambda v: dml.tombstone(v.blo, _GONE(v).union(_GONE(v)), NOW), "blo", f"SELECT * REPLACE (CASE WHEN {_G} THEN {_T} ELSE deleted END AS deleted, CASE WHEN {_G} THEN 'bob' ELSE deleter END AS deleter, CASE WHEN {_G} THEN 'why' ELSE deletenote END AS deletenote, CASE WHEN {_G} THEN 0 ELSE bundle END AS bundle, CASE WHEN {_G} THEN 0 ELSE size END AS size, CASE WHEN {_G} THEN '' ELSE mimetype END AS mimetype) FROM blo")
add("bundle_rewrite_survivors", lambda v: dml.bundle_survivors(v.blo, v.blo.where("blobid % 50 = 0")).select("item", "bundle", "blobid"), "blo", "SELECT item, bundle, blobid FROM blo WHERE blobid % 50 <> 0 AND (item, bundle) IN (SELECT (item, bundle) FROM blo WHERE blobid % 50 = 0)")
add("set_mime", lambda v: dml.set_mime(v.blo, v.blo.where("blobid < 5").select("item", "blobid", F.lit("text/x").alias("mime"))), "blo", "SELECT * REPLACE (CASE WHEN blobid < 5 AND deleted IS NULL THEN 'text/x' ELSE mimetype END AS mimetype) FROM blo")
add("item_upsert", lambda v: dml.upsert_items(v.ver.select("item").distinct().select("item", *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("created", "modified")], F.lit(0).cast("long").alias("size")), v.ver, v.pblo), "ver pblo", """
    , n AS (SELECT v.item, arg_min(v.created, v.versionid) AS created, arg_max(v.created, v.versionid) AS modified, CAST(coalesce(any_value(b.size), 0) AS BIGINT) AS size FROM ver v LEFT JOIN (SELECT item, sum(size) AS size FROM pblo GROUP BY item) b ON v.item = b.item GROUP BY v.item)
    SELECT * FROM n UNION ALL SELECT DISTINCT item, CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(0 AS BIGINT) FROM ver WHERE item NOT IN (SELECT item FROM n)""")
add("version_commit", lambda v: dml.commit_version(v.slo, v.ver.drop("orderkey"), v.slo.where("versionid = 1 and blobid % 2 = 0").select("item", "name", F.when(F.col("blobid") % 4 == 0, 0).otherwise(F.lit(9)).alias("blobid")), "me", "n", NOW)[1], "slo", """
    , o AS (SELECT item, name, CASE WHEN blobid % 4 = 0 THEN 0 ELSE 9 END AS blobid FROM slo WHERE versionid = 1 AND blobid % 2 = 0),
    t AS (SELECT item, max(versionid) AS m FROM ver WHERE item IN (SELECT item FROM o) GROUP BY item),
    b AS (SELECT s.item, s.name, s.blobid FROM slo s JOIN t ON s.item = t.item AND s.versionid = t.m),
    x AS (SELECT coalesce(o.item, b.item) AS item, coalesce(o.name, b.name) AS name, coalesce(o.blobid, b.blobid) AS blobid FROM b FULL JOIN o ON b.item = o.item AND b.name = o.name)
    SELECT item, versionid, blobid, name FROM slo UNION ALL SELECT x.item, CAST(t.m + 1 AS INT), x.blobid, x.name FROM x JOIN t ON x.item = t.item WHERE x.blobid > 0""")
