"""Queries on scalar functions."""

from pyspark.sql import functions as F

from ledgerstone.functions import scalars as sc
from ledgerstone.plans.registry import add

_DOCS = lambda v: v.table("documents")
add("content_md5", lambda v: _DOCS(v).select("doc_id", F.md5("text").alias("md5")), "", "SELECT doc_id, md5(text) AS md5 FROM documents")
add("content_sha256", lambda v: _DOCS(v).select("doc_id", F.sha2("text", 256).alias("sha256")), "", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
add("verify_hash", lambda v: _DOCS(v).select("doc_id", sc.stream_verified(F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.md5("lang"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.md5("text"))).otherwise(F.lit(b"")), F.lit(None).cast("binary")).alias("ok")), "", "SELECT doc_id, doc_id % 3 <> 0 OR md5(lang) = md5(text) AS ok FROM documents")
add("hex_base64", lambda v: _DOCS(v).select("doc_id", sc.to_hex(sc.from_hex(F.md5("text"))).alias("hex"), F.base64(sc.from_base64(F.base64(F.col("source").cast("binary")))).alias("b64"), F.length(sc.from_hex("lang")).alias("bad")), "", "SELECT doc_id, md5(text) AS hex, to_base64(CAST(source AS BLOB)) AS b64, CAST(CASE WHEN regexp_full_match(lang, '[0-9a-f]{2}') THEN 1 ELSE 0 END AS INT) AS bad FROM documents")
add("base36_ids", lambda v: v.table("orders").select("o_orderkey", sc.base36(F.col("o_orderkey") % 36).alias("id")), "", "SELECT o_orderkey, substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(o_orderkey % 36 + 1 AS INT), 1) AS id FROM orders")
_SIZE = "CAST(floor(o_totalprice) AS BIGINT) * (CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 100000000 ELSE -1 END)"
add("human_size", lambda v: v.table("orders").select("o_orderkey", sc.human_size(F.expr(_SIZE)).alias("shown")), "", f"SELECT o_orderkey, CASE WHEN s < 1000 THEN s || ' Bytes' WHEN s < 1000000 THEN s // 1000 || ' KB' WHEN s < 1000000000 THEN s // 1000000 || ' MB' WHEN s < 1000000000000 THEN s // 1000000000 || ' GB' ELSE s // 1000000000000 || ' TB' END AS shown FROM (SELECT o_orderkey, {_SIZE} AS s FROM orders)")
_NAMES = ("Read", "WRITE", "admin", "MDOnly", "nobody")
_PICK = lambda n: F.get(F.array(*[F.lit(x) for x in _NAMES]), (F.col(n) % 5).cast("int"))
add("role_parse", lambda v: v.table("customer").select("c_custkey", sc.role_rank(_PICK("c_custkey")).alias("role"), sc.role_allows(sc.role_rank(_PICK("c_custkey")), "read").alias("may_read")), "", "SELECT c_custkey, CAST([2, 3, 4, 1, 0][c_custkey % 5 + 1] AS INT) AS role, [true, true, true, false, false][c_custkey % 5 + 1] AS may_read FROM customer")
add("status_label", lambda v: v.table("orders").select("o_orderkey", sc.tx_status_label((F.col("o_orderkey") % 9 - 1).cast("int")).alias("label")), "", "SELECT o_orderkey, coalesce(['StatusUnknown', 'StatusOpen', 'StatusWaiting', 'StatusChecking', 'StatusIngest', 'StatusFinished', 'StatusError'][CASE WHEN o_orderkey % 9 = 0 THEN 99 ELSE o_orderkey % 9 END], 'Status(' || (o_orderkey % 9 - 1) || ')') AS label FROM orders")
_TEXTS = ("", "*", "2017-10-01", "2017-10-01T05:10:15Z", "2017-10", "2017", "not a time", "Sep 5, 2017")
_TEXT = lambda: F.get(F.array(*[F.lit(x) for x in _TEXTS]), (F.col("c_custkey") % 8).cast("int"))
_PARSED = lambda i: sc.parse_time(_TEXT(), F.lit("2020-01-01").cast("timestamp"))[i]
add("time_parse", lambda v: v.table("customer").select("c_custkey", F.date_format(_PARSED(0), "yyyy-MM-dd HH:mm:ss").alias("at"), _PARSED(1).alias("valid")), "", "SELECT c_custkey, ['2020-01-01 00:00:00', NULL, '2017-10-01 00:00:00', '2017-10-01 05:10:15', NULL, NULL, NULL, NULL][c_custkey % 8 + 1] AS at, c_custkey % 8 < 4 AS valid FROM customer")
add("status_valid", lambda v: v.table("events").select("event_id", sc.fixity_status_valid(F.when(F.col("event_type") == "view", "ok").otherwise(F.col("event_type"))).alias("valid")), "", "SELECT event_id, event_type IN ('view', 'error') AS valid FROM events")
add("day_bounds", lambda v: v.table("events").select("event_id", *[c.cast("string").alias(n) for n, c in zip(("day_start", "day_end"), sc.day_bounds(F.col("ts")), strict=True)]), "", "SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day_start, strftime(date_trunc('day', ts) + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS day_end FROM events")
add("date_display", lambda v: v.table("events").select("event_id", sc.shown_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("shown")), "", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
add("cacheable_sizes", lambda v: _DOCS(v).select("doc_id", sc.cacheable(F.col("n_chars"), F.lit(10_000)).alias("small"), sc.cacheable(F.col("n_chars"), F.lit(0)).alias("any")), "", "SELECT doc_id, n_chars < 1250 AS small, true AS \"any\" FROM documents")
add("part_sizes", lambda v: v.table("nation").select("n_nationkey", sc.part_size(F.col("n_nationkey")).alias("size")), "", "SELECT n_nationkey, CASE WHEN n_nationkey < 6 THEN CAST(67108864 AS BIGINT) << n_nationkey ELSE 4294967296 END AS size FROM nation")
add("action_labels", lambda v: v.table("nation").select("n_nationkey", sc.action_label(F.get(F.array(*[F.lit(x) for x in ("new", "mime", "relink", "dup")]), F.col("n_nationkey") % 4), F.col("n_name"), F.col("n_nationkey")).alias("label")), "", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'new blob ' || n_name WHEN 1 THEN 'set mime ' || n_name WHEN 2 THEN 'use blob ' || n_nationkey || ' for ' || n_name ELSE 'use local copy for ' || n_name END AS label FROM nation")
add("zero_based", lambda v: v.table("nation").select("n_nationkey", sc.zero_based(F.col("n_nationkey")).alias("at")), "", "SELECT n_nationkey, n_nationkey - 1 AS at FROM nation")
