"""Queries on transactions, caches, fragments and bundles."""

from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerstone.functions import keys
from ledgerstone.operators import caching as ca
from ledgerstone.operators import transactions as tx
from ledgerstone.operators import versions
from ledgerstone.plans.registry import add
from ledgerstone.sources import bundles, fragments, stores, text

NOW = datetime(2001, 8, 5)
_T = "TIMESTAMP '2001-08-05'"
_ONE = lambda v: v.cmd.select("tx", "position", tx.well_formed(F.col("words")).alias("good"))
add("tx_wellformed", _ONE, "cmd", "SELECT tx, position, true AS good FROM cmd")
_BROKEN = lambda v: v.cmd.select("tx", "position", tx.well_formed(F.when(F.col("position") % 3 == 0, F.array(F.lit("delete"), F.lit("4"))).when(F.col("position") % 3 == 1, F.array(F.lit("delete"), F.lit("x"))).otherwise(F.array(F.lit("move"), F.lit("a")))).alias("good"))
add("tx_malformed", _BROKEN, "cmd", "SELECT tx, position, position % 3 = 0 AS good FROM cmd")
_DOC = lambda v: v.cmd.groupBy("tx").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "words"))), lambda x: x["words"]).alias("commands"))
add("tx_referenced_files", lambda v: tx.referenced_files(_DOC(v)), "cmd", "SELECT tx, words[2] AS file FROM cmd WHERE words[1] = 'add'")
_UP = lambda v: v.cmd.where("words[0] = 'add'").select(F.col("words")[1].alias("file")).distinct().where("file <> 'f7'").withColumn("verified", ~F.col("file").endswith("3"))
add("tx_verify_files", lambda v: tx.verify_files(_DOC(v), _UP(v)), "cmd", "SELECT tx, words[2] AS file, CASE WHEN words[2] = 'f7' THEN 'missing' ELSE 'checksum' END AS problem FROM cmd WHERE words[1] = 'add' AND (words[2] = 'f7' OR words[2] LIKE '%3')")
add("tx_retention", lambda v: tx.expired_transactions(v.tx, NOW), "tx", f"SELECT * FROM tx WHERE (status = 5 AND modified <= {_T} - INTERVAL 4 DAY) OR (status = 6 AND modified <= {_T} - INTERVAL 7 DAY)")
add("upload_retention", lambda v: tx.expired_uploads(v.tx, datetime(2000, 1, 1)), "tx", "SELECT * FROM tx WHERE modified <= TIMESTAMP '2000-01-01' - INTERVAL 14 DAY")
add("tx_in_process", lambda v: tx.in_process(v.tx), "tx", "SELECT * FROM tx WHERE status NOT IN (5, 6)")
add("tx_admitted", lambda v: tx.admitted(v.tx), "tx", "SELECT * FROM tx WHERE status NOT IN (1, 5, 6)")
add("tx_creatable", lambda v: tx.creatable(v.table("customer").selectExpr("concat('c', c_custkey) AS item"), v.tx.where("tx % 10 = 0")), "tx", "SELECT 'c' || c_custkey AS item FROM customer WHERE 'c' || c_custkey NOT IN (SELECT item FROM tx WHERE tx % 10 = 0 AND status NOT IN (5, 6))")
add("tx_cancel", lambda v: tx.cancel(v.tx, list(range(100))), "tx", "SELECT * FROM tx WHERE NOT (tx < 100 AND status IN (5, 6))")
_MAP = lambda v: v.cmd.where("words[0] = 'add'").select("tx", F.col("words")[1].alias("file"), F.col("position").alias("blobid")).groupBy("tx", "file").agg(F.max("blobid").alias("blobid"))
add("tx_resolve_ids", lambda v: tx.resolve_ids(v.cmd.where("words[0] = 'slot'").select("tx", F.col("words")[1].alias("name"), F.col("words")[2].alias("target")), _MAP(v)), "cmd", "SELECT c.tx, c.words[2] AS name, c.words[3] AS target, coalesce(m.b, TRY_CAST(c.words[3] AS INT)) AS blobid, coalesce(m.b, TRY_CAST(c.words[3] AS INT)) IS NULL AS failed FROM cmd c LEFT JOIN (SELECT tx, words[2] AS f, max(position) AS b FROM cmd WHERE words[1] = 'add' GROUP BY tx, words[2]) m ON c.tx = m.tx AND c.words[3] = m.f WHERE c.words[1] = 'slot'")
add("tx_replay", lambda v: tx.replay(v.cmd, v.cmd.where("words[0] = 'add' and words[1] not like '%9'").select("tx", F.col("words")[1].alias("file")).distinct()), "cmd", """
    , t AS (SELECT *, CASE WHEN words[1] = 'add' AND words[2] LIKE '%9' THEN 'missing ' || words[2]
                           WHEN words[1] = 'slot' AND NOT regexp_matches(words[3], '^[+-]*[0-9]+$') AND NOT EXISTS (SELECT 1 FROM cmd a WHERE a.tx = cmd.tx AND a.position < cmd.position AND a.words[1] = 'add' AND a.words[2] = cmd.words[3]) THEN 'unknown ' || words[3] END AS wrong FROM cmd),
    s AS (SELECT tx, min(position) FILTER (wrong IS NOT NULL) AS stop, arg_min(wrong, position) FILTER (wrong IS NOT NULL) AS error FROM t GROUP BY tx)
    SELECT s.tx, CAST(count(*) FILTER (t.done) AS INT) AS applied, CAST(any_value(CASE WHEN stop IS NULL THEN 5 ELSE 6 END) AS INT) AS status, any_value(coalesce(error, '')) AS error, CAST(0 AS INT) AS n_deleted,
           CAST(count(DISTINCT t.words[2]) FILTER (t.done AND t.words[1] = 'slot') AS INT) AS n_slots, coalesce(arg_max(t.words[2], t.position) FILTER (t.done AND t.words[1] = 'note'), '') AS note
    FROM s JOIN (SELECT t.*, stop IS NULL OR position < stop AS done FROM t JOIN s USING (tx)) t ON t.tx = s.tx GROUP BY s.tx""")
_EVENTS = lambda v: v.table("orders").select(F.col("o_custkey").alias("tx"), F.col("o_orderkey").alias("position"), F.get(F.array(*[F.lit(e) for e in ("commit", "start", "check_ok", "ingest_ok", "check_failed")]), (F.col("o_orderkey") % 5).cast("int")).alias("event"))
add("tx_status_replay", lambda v: tx.replay_status(_EVENTS(v)), "tx", """
    , e AS (SELECT o_custkey AS tx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, ['commit', 'start', 'check_ok', 'ingest_ok', 'check_failed'][o_orderkey % 5 + 1] AS event FROM orders),
    f AS (SELECT DISTINCT tx, CAST(0 AS BIGINT) AS n, 1 AS status FROM e
          UNION ALL
          SELECT f.tx, e.n, CASE WHEN f.status = 1 AND event = 'commit' THEN 2 WHEN f.status = 2 AND event = 'start' THEN 3 WHEN f.status = 3 AND event = 'check_ok' THEN 4 WHEN f.status = 3 AND event = 'check_failed' THEN 6 WHEN f.status = 4 AND event = 'ingest_ok' THEN 5 ELSE f.status END
          FROM f JOIN e ON e.tx = f.tx AND e.n = f.n + 1)
    SELECT tx, CAST(arg_max(status, n) AS INT) AS status FROM f GROUP BY tx""")
add("ttl_cache_hits", lambda v: ca.ttl_hits(v.acc, 3 * 3600), "acc", "SELECT key, ts, size, coalesce(ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, size) < INTERVAL 3 HOUR, false) AS hit FROM acc")
add("size_cache_hits", lambda v: ca.size_heads(v.acc.withColumn("size", F.when(F.col("size") % 3 == 0, -1).otherwise(F.col("size")))), "acc", "SELECT key, ts, size, coalesce(ts - lag(ts) OVER w < CASE WHEN lag(size) OVER w < 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 240 HOUR END, false) AS hit FROM (SELECT key, ts, CASE WHEN size % 3 = 0 THEN -1 ELSE size END AS size FROM acc) WINDOW w AS (PARTITION BY key ORDER BY ts, size)")
add("single_flight", lambda v: ca.single_flight(v.acc, 3600), "acc", "SELECT key, ts, size, coalesce(ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, size) > INTERVAL 1 HOUR, true) AS leads FROM acc")
add("cache_counters", lambda v: ca.hit_counters(ca.ttl_hits(v.acc, 3 * 3600)), "acc", "SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT size, coalesce(ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, size) < INTERVAL 3 HOUR, false) AS hit FROM acc)")
add("error_ledger", lambda v: ca.error_ledger(v.table("events").where("event_type = 'error'").selectExpr("concat('k', event_id % 3) AS key", "ts", "props AS error"), v.table("events").where("event_type = 'view'").selectExpr("concat('k', event_id % 3) AS key", "ts")), "", """
    WITH e AS (SELECT 'k' || event_id % 3 AS key, ts, props AS error FROM events WHERE event_type = 'error'), q AS (SELECT 'k' || event_id % 3 AS key, ts FROM events WHERE event_type = 'view')
    SELECT q.key, q.ts, CASE WHEN e.ts > q.ts - INTERVAL 30 SECOND THEN e.error END AS error FROM q ASOF LEFT JOIN e ON q.key = e.key AND q.ts >= e.ts""")
add("lru_replay", lambda v: ca.lru_replay(v.acc, 500), "acc", """
    , o AS (SELECT *, row_number() OVER (ORDER BY ts, key, size) AS n FROM acc),
    r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k VARCHAR, s BIGINT)[]) AS held, false AS hit, false AS stored, 0 AS evicted
          UNION ALL
          SELECT n, CASE WHEN hit THEN list_concat([list_filter(held, lambda x: x.k = key)[1]], list_filter(held, lambda x: x.k <> key))
                         WHEN size > 500 THEN held ELSE list_concat([{'k': key, 's': size}], kept) END,
                 hit, hit OR size <= 500, CAST(CASE WHEN hit OR size > 500 THEN 0 ELSE len(held) - len(kept) END AS INT)
          FROM (SELECT o.n, held, key, size, list_contains(list_transform(held, lambda x: x.k), key) AS hit,
                       list_filter(held, lambda x, i: list_sum(list_transform(held[1:i], lambda y: y.s)) + size <= 500) AS kept
                FROM r JOIN o ON o.n = r.n + 1))
    SELECT key, ts, size, hit, stored, evicted FROM o JOIN r USING (n)""")
add("rate_credit", lambda v: ca.rate_credit(v.acc.groupBy(F.expr("unix_micros(cast(ts as timestamp)) div 60000000").alias("minute")).agg(F.sum("size").alias("used")), 5, 100), "acc", """
    , u AS (SELECT epoch_us(ts) // 60000000 AS minute, CAST(sum(size) AS BIGINT) AS used FROM acc GROUP BY 1),
    r AS (SELECT minute, used, (minute - min(minute) OVER w) * 5 AS gain, sum(used) OVER w AS spent FROM u WINDOW w AS (ORDER BY minute))
    SELECT minute, used, CAST(100 + gain - spent - greatest(0, max(gain - spent + used) OVER (ORDER BY minute)) AS BIGINT) AS credit FROM r""")
add("cache_index", lambda v: ca.index_union(v.acc.groupBy("key").agg(F.max("size").alias("size"), F.max("ts").alias("expires")).where("size % 2 = 0"), v.acc.groupBy("key").agg(F.max("size").alias("size"))), "acc", "SELECT key, max(size) AS size, CASE WHEN max(size) % 2 = 0 THEN max(ts) END AS expires FROM acc GROUP BY key")
add("token_join", lambda v: text.token_users(v.table("events").selectExpr("event_id", "concat('t', user_id) AS token"), text.tokens(v.table("customer").selectExpr("concat('  n', c_custkey, ' ', CASE c_custkey % 3 WHEN 0 THEN 'READ' WHEN 1 THEN 'write' ELSE 'x' END, '  t', c_custkey * 2) AS value"))), "", "SELECT 't' || user_id AS token, event_id, CASE WHEN c_custkey IS NOT NULL THEN 'n' || c_custkey END AS user, CAST(CASE WHEN c_custkey IS NULL OR c_custkey % 3 = 2 THEN 0 WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END AS INT) AS role FROM events LEFT JOIN customer ON user_id = c_custkey * 2")
_FRAG = lambda v: v.table("conversations").select(F.concat(F.lit("f"), "conv_id").alias("file"), F.col("turn").cast("int").alias("seq"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content"))
add("fragment_contents", lambda v: fragments.contents(_FRAG(v)).select("file", F.md5("content").alias("md5"), F.length("content").cast("long").alias("size")), "", "SELECT 'f' || conv_id AS file, md5(string_agg(text, '' ORDER BY turn)) AS md5, CAST(sum(strlen(text)) AS BIGINT) AS size FROM conversations GROUP BY conv_id")
add("fragment_stats", lambda v: fragments.stats(_FRAG(v)), "", "SELECT 'f' || conv_id AS file, CAST(sum(strlen(text)) AS BIGINT) AS size, count(*) AS n_fragments FROM conversations GROUP BY conv_id")
add("fragment_running_size", lambda v: fragments.running_size(_FRAG(v)).select("file", "seq", "upto"), "", "SELECT 'f' || conv_id AS file, CAST(turn AS INT) AS seq, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS upto FROM conversations")
add("fragment_rollback", lambda v: fragments.rollback(_FRAG(v)).select("file", "seq"), "", "SELECT 'f' || conv_id AS file, CAST(turn AS INT) AS seq FROM conversations QUALIFY turn < max(turn) OVER (PARTITION BY conv_id)")
add("fragment_verify", lambda v: fragments.verify(_FRAG(v), v.table("conversations").where("turn = 0").selectExpr("concat('f', conv_id) AS file", "unhex(md5(text)) AS md5", "CAST(NULL AS BINARY) AS sha256")), "", "SELECT 'f' || a.conv_id AS file, md5(a.text) = b.m AS verified FROM conversations a JOIN (SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS m FROM conversations GROUP BY conv_id) b ON a.conv_id = b.conv_id WHERE a.turn = 0")
add("chunk_plan", lambda v: stores.plan_chunks(v.table("documents").selectExpr("concat('d', doc_id) AS name", "n_chars AS size", "least(n_chars, doc_id % 500) AS sent"), 1000), "", "SELECT name, \"offset\", least(1000, n - \"offset\") AS size FROM (SELECT 'd' || doc_id AS name, n_chars AS n, unnest(range(least(n_chars, doc_id % 500), n_chars, 1000)) AS \"offset\" FROM documents)")
add("synthetic_throughput", lambda v: stores.synthetic_items(v.spark, 1000).groupBy("item").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")), "", """
    WITH i AS (SELECT i, printf('item-%05d', i) AS item FROM range(1000) t(i)),
    f AS (SELECT item, unnest(range(1, CAST('0x' || substr(md5('1/' || i), 1, 8) AS BIGINT) % 10 + 2)) AS file FROM i)
    SELECT item, count(*) AS files, CAST(sum(CAST('0x' || substr(md5('1/' || item || '/' || file), 1, 8) AS BIGINT) % 100000000) AS BIGINT) AS bytes FROM f GROUP BY item""")


def _bags(v):
    """Documents as blobs in bundles of their source, cut at ``versions.BUNDLE_BYTES`` (the oracles hold for sources of one bundle)."""
    docs = v.table("documents").where("length(text) > 0").select(F.col("source").alias("item"), F.col("doc_id").alias("blobid"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content"))
    packed = versions.pack_bundles(docs).select("item", "blobid", keys.bundle_key(F.col("item"), F.col("bundle")).alias("bundle"))
    files = docs.join(packed, ["item", "blobid"]).select("bundle", F.concat(F.lit("blob/"), "blobid").alias("name"), "content")
    return bundles.write_bags(files, date(2024, 1, 1)).select(F.col("bundle").alias("path"), "content")


add("bag_scan", lambda v: bundles.entries(_bags(v)).where("name like 'data/%'"), "", "SELECT source || '-0001.zip' AS bundle, 'data/blob/' || doc_id AS name, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5, sha256(text) AS sha256 FROM documents WHERE length(text) > 0")
add("bag_tags", lambda v: bundles.bag_tags(bundles.entries(_bags(v), content=True)).where("key = 'Payload-Oxum'"), "", "SELECT source || '-0001.zip' AS bundle, 'Payload-Oxum' AS key, CAST(sum(strlen(text)) AS VARCHAR) || '.' || count(*) AS value FROM documents WHERE length(text) > 0 GROUP BY source")
add("bag_manifests", lambda v: bundles.manifests(bundles.entries(_bags(v), content=True)).where("file like 'data/%'").select("bundle", "file", "md5", "sha256"), "", "SELECT source || '-0001.zip' AS bundle, 'data/blob/' || doc_id AS file, md5(text) AS md5, sha256(text) AS sha256 FROM documents WHERE length(text) > 0")
