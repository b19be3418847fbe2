"""Queries that compare trees and lists."""

from pyspark.sql import functions as F

from ledgerstone.operators import diff
from ledgerstone.plans.registry import add
from ledgerstone.sources import text

_PLAN = """
    , c AS (SELECT md5, min(blobid) AS b FROM rem GROUP BY md5),
    j AS (SELECT l.name, l.md5, l.mime, r.md5 AS rmd5, r.mime AS rmime, r.blobid AS rb, c.b FROM loc l LEFT JOIN rem r ON l.name = r.name LEFT JOIN c ON l.md5 = c.md5),
    k AS (SELECT *, CASE WHEN b IS NULL THEN row_number() OVER (PARTITION BY md5, b IS NULL ORDER BY name) END AS n FROM j),
    d AS (SELECT name, md5, mime, CASE WHEN md5 = rmd5 AND mime = rmime THEN 'same' WHEN md5 = rmd5 THEN 'mime' WHEN b IS NOT NULL THEN 'relink' WHEN n = 1 THEN 'new' ELSE 'local_dup' END AS action, CASE WHEN md5 = rmd5 THEN rb ELSE b END AS blobid FROM k)
"""
add("tree_diff", lambda v: diff.plan_upload(v.loc, v.rem), "loc rem", f"{_PLAN} SELECT * FROM d")
add("relink_candidates", lambda v: diff.plan_upload(v.loc, v.rem).where("action = 'relink'").select("name", "blobid"), "loc rem", f"{_PLAN} SELECT name, blobid FROM d WHERE action = 'relink'")
add("first_local", lambda v: diff.first_local(v.loc).select("name", "md5", "is_first"), "loc", "SELECT name, md5, row_number() OVER (PARTITION BY md5 ORDER BY name) = 1 AS is_first FROM loc")
_OLD = lambda v: v.loc.select("name", "md5", F.lit("").alias("sha256"), F.lit("").alias("mime"))
_NEW = lambda v: v.rem.select("name", F.when(F.substring("md5", 1, 1) < "4", F.md5("name")).otherwise(F.col("md5")).alias("md5"), "sha256", "mime")
add("merge_file_lists", lambda v: diff.merge_lists(_OLD(v), _NEW(v)), "loc rem", """
    , n AS (SELECT name, CASE WHEN substr(md5, 1, 1) < '4' THEN md5(name) ELSE md5 END AS md5, sha256, mime FROM rem)
    SELECT coalesce(l.name, n.name) AS name, coalesce(l.md5, n.md5) AS md5, n.sha256, CASE WHEN n.mime IS NOT NULL THEN n.mime ELSE '' END AS mime, coalesce(l.md5 <> n.md5, false) AS conflict FROM loc l FULL JOIN n ON l.name = n.name""")
add("requested_available", lambda v: diff.available(v.loc, v.rem).select("name", "md5"), "loc rem", "SELECT name, md5 FROM rem WHERE name IN (SELECT name FROM loc)")
_L = lambda v: v.loc.select(F.col("name").alias("key"), F.col("md5").alias("value"))
_R = lambda v: v.rem.select(F.col("name").alias("key"), F.col("mime").alias("value"))
add("overlay_union", lambda v: diff.overlay_distinct(_L(v), _R(v)), "loc rem", "SELECT name AS key FROM loc UNION SELECT name FROM rem")
add("overlay_union_all", lambda v: diff.overlay_all(_L(v), _R(v)), "loc rem", "SELECT name AS key FROM loc UNION ALL SELECT name FROM rem")
add("overlay_local_wins", lambda v: diff.overlay_lookup(_L(v), _R(v)), "loc rem", "SELECT coalesce(l.name, r.name) AS key, CASE WHEN l.name IS NOT NULL THEN l.md5 ELSE r.mime END AS value, CASE WHEN l.name IS NOT NULL THEN 'local' ELSE 'remote' END AS origin FROM loc l FULL JOIN rem r ON l.name = r.name")
add("csv_checksum_diff", lambda v: diff.checksum_diff(text.checksum_list(v.loc.select(F.concat_ws(",", "md5", "name").alias("value"))), v.rem.select(F.col("name").alias("path"), F.when(F.substring("md5", 1, 1) < "4", "x").otherwise(F.col("md5")).alias("checksum"))), "loc rem", """
    SELECT l.name AS path, l.md5 AS checksum, CASE WHEN r.name IS NULL THEN 'absent' ELSE 'differs' END AS reason FROM loc l LEFT JOIN rem r ON l.name = r.name WHERE r.name IS NULL OR substr(r.md5, 1, 1) < '4' OR r.md5 <> l.md5""")
add("blob_by_content", lambda v: diff.blob_by_content(v.loc, v.rem), "loc rem", "SELECT l.name, l.size, l.sha256, b.blobid FROM loc l LEFT JOIN (SELECT size, sha256, min(blobid) AS blobid FROM rem WHERE size > 0 GROUP BY size, sha256) b ON l.size = b.size AND l.sha256 = b.sha256")
add("add_files", lambda v: diff.add_files(v.loc, v.rem), "loc rem", """
    , b AS (SELECT size, sha256, min(blobid) AS blobid FROM rem WHERE size > 0 GROUP BY size, sha256),
    k AS (SELECT l.name, l.size, l.sha256, b.blobid FROM loc l LEFT JOIN b ON l.size = b.size AND l.sha256 = b.sha256),
    f AS (SELECT size, sha256, CAST((SELECT max(blobid) FROM rem) + row_number() OVER (ORDER BY n) AS INT) AS nid FROM (SELECT size, sha256, min(name) AS n FROM k WHERE blobid IS NULL GROUP BY size, sha256))
    SELECT k.name, coalesce(k.blobid, f.nid) AS blobid, f.nid IS NOT NULL AS is_new FROM k LEFT JOIN f ON k.size = f.size AND k.sha256 = f.sha256""")
add("upload_manifest", lambda v: text.upload_list(v.loc.select(F.concat_ws("|", "name", "md5", "sha256", "mime").alias("value")).union(v.rem.select(F.concat_ws("|", "name", "md5").alias("value")))), "loc", "SELECT name, md5, sha256, mime FROM loc")
