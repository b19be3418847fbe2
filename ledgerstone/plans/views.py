"""The catalog's tables as deterministic views of the driver's tables, in Spark and as DuckDB expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: name -> SELECT in DuckDB; ``oracle`` puts those that a query names before it.
SQL = {
    "fix": "SELECT event_id AS id, 'u' || user_id AS item, ts AS scheduled_time, CASE event_type WHEN 'view' THEN 'ok' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'mismatch' ELSE 'scheduled' END AS status, props AS notes FROM events",
    "ver": "SELECT 'c' || o_custkey AS item, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS versionid, o_orderdate AS created, o_orderpriority AS creator, o_orderstatus AS note, o_orderkey AS orderkey FROM orders",
    "slo": "SELECT v.item, v.versionid, CAST(min(l_partkey) AS INT) AS blobid, 'ln' || l_linenumber AS name FROM lineitem JOIN ver v ON l_orderkey = v.orderkey GROUP BY v.item, v.versionid, l_linenumber",
    "pblo": "SELECT s.item, s.blobid, CAST(p_size AS BIGINT) AS size, CAST(1 + s.blobid % 3 AS INT) AS bundle, p_brand AS mimetype, p_name AS creator FROM (SELECT DISTINCT item, blobid FROM slo) s JOIN part ON p_partkey = s.blobid",
    "blo0": "SELECT source AS item, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS blobid, n_chars, md5(text) AS md5, sha256(text) AS sha256, lang, doc_id FROM documents",
    "blo": "SELECT item, blobid, CASE WHEN doc_id % 97 = 5 THEN -1 WHEN doc_id % 11 = 0 AND doc_id % 3 <> 0 THEN 0 ELSE n_chars END AS size, CAST(CASE WHEN doc_id % 89 = 7 OR doc_id % 11 = 0 AND doc_id % 5 <> 0 THEN 0 ELSE (blobid - 1) // 20 + 1 END AS INT) AS bundle, CASE WHEN doc_id % 83 <> 1 THEN TIMESTAMP '2020-01-01' + to_minutes(doc_id) END AS created, 'u' || doc_id % 7 AS creator, CASE WHEN doc_id % 71 = 2 THEN '' ELSE md5 END AS md5, CASE WHEN doc_id % 73 = 2 THEN 'ab' ELSE sha256 END AS sha256, lang AS mimetype, CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2021-01-01' END AS deleted, CASE WHEN doc_id % 22 = 0 OR doc_id % 79 = 4 THEN 'admin' ELSE '' END AS deleter, CASE WHEN doc_id % 67 = 3 THEN 'gone' ELSE '' END AS deletenote FROM blo0",
    "keys": "SELECT printf('%s-%04d.zip', item, versionid) AS key FROM ver",
    "acc": "SELECT 'u' || user_id AS key, ts, CAST(floor(abs(value)) AS BIGINT) AS size FROM events",
    "cmd": "SELECT conv_id AS tx, CAST(turn AS INT) AS position, CASE role WHEN 'system' THEN ['note', text] WHEN 'user' THEN ['add', 'f' || length(text) % 50] ELSE ['slot', 's' || turn, CASE WHEN length(text) % 3 = 0 THEN 'f' || length(text) % 50 ELSE CAST(length(text) AS VARCHAR) END] END AS words FROM conversations",
    "tx": "SELECT o_orderkey AS tx, 'c' || o_custkey AS item, CAST(o_orderkey % 7 AS INT) AS status, o_orderdate AS modified FROM orders",
    "loc": "SELECT CASE WHEN doc_id % 3 <> 0 THEN 'd' ELSE 'l' END || doc_id AS name, md5(text) AS md5, sha256(text) AS sha256, lang AS mime, n_chars AS size FROM documents",
    "rem": "SELECT CASE WHEN doc_id % 5 <> 0 THEN 'd' ELSE 'r' END || doc_id AS name, md5(body) AS md5, sha256(body) AS sha256, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS mime, CAST(doc_id + 1 AS INT) AS blobid, n_chars + doc_id % 2 AS size FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '+' END || text AS body FROM documents)",
}
#: Views that a view needs.
NEEDS = {"slo": ["ver"], "pblo": ["ver", "slo"], "blo": ["blo0"], "keys": ["ver"]}


def oracle(views: str, sql: str) -> str:
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*NEEDS.get(v, []), v] if n not in names]
    return f"WITH RECURSIVE {', '.join(f'{n} AS ({SQL[n]})' for n in names)} {sql}" if names else sql


class Views:
    """The views over one folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in BUILD:
            raise AttributeError(name)
        return BUILD[name](self)


def _fix(v: Views) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "mismatch").otherwise("scheduled")
    return v.table("events").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("item"), F.col("ts").alias("scheduled_time"), status.alias("status"), F.col("props").alias("notes"))


def _ver(v: Views) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return v.table("orders").select(F.concat(F.lit("c"), "o_custkey").alias("item"), n.cast("int").alias("versionid"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("creator"), F.col("o_orderstatus").alias("note"), F.col("o_orderkey").alias("orderkey"))


def _slo(v: Views) -> DataFrame:
    rows = v.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(v.ver.select("item", "versionid", "orderkey"), F.col("l_orderkey") == F.col("orderkey"))
    return rows.groupBy("item", "versionid", "l_linenumber").agg(F.min("l_partkey").cast("int").alias("blobid")).select("item", "versionid", "blobid", F.concat(F.lit("ln"), "l_linenumber").alias("name"))


def _pblo(v: Views) -> DataFrame:
    part = v.table("part").select(F.col("p_partkey").cast("int").alias("blobid"), "p_size", "p_brand", "p_name")
    rows = v.slo.select("item", "blobid").distinct().join(part, "blobid")
    return rows.select("item", "blobid", F.col("p_size").cast("long").alias("size"), (1 + F.col("blobid") % 3).cast("int").alias("bundle"), F.col("p_brand").alias("mimetype"), F.col("p_name").alias("creator"))


def _blo(v: Views) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("int")
    rows = v.table("documents").select("source", "doc_id", "n_chars", "lang", F.md5("text").alias("h1"), F.sha2("text", 256).alias("h2")).withColumn("blobid", n)
    return rows.selectExpr(
        "source AS item", "blobid",
        "CASE WHEN doc_id % 97 = 5 THEN -1L WHEN doc_id % 11 = 0 AND doc_id % 3 <> 0 THEN 0L ELSE n_chars END AS size",
        "CAST(CASE WHEN doc_id % 89 = 7 OR doc_id % 11 = 0 AND doc_id % 5 <> 0 THEN 0 ELSE (blobid - 1) div 20 + 1 END AS INT) AS bundle",
        "CASE WHEN doc_id % 83 <> 1 THEN TIMESTAMP_NTZ '2020-01-01' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0) END AS created",
        "concat('u', doc_id % 7) AS creator", "CASE WHEN doc_id % 71 = 2 THEN '' ELSE h1 END AS md5", "CASE WHEN doc_id % 73 = 2 THEN 'ab' ELSE h2 END AS sha256", "lang AS mimetype",
        "CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP_NTZ '2021-01-01' END AS deleted",
        "CASE WHEN doc_id % 22 = 0 OR doc_id % 79 = 4 THEN 'admin' ELSE '' END AS deleter", "CASE WHEN doc_id % 67 = 3 THEN 'gone' ELSE '' END AS deletenote",
    )


def _cmd(v: Views) -> DataFrame:
    return v.table("conversations").selectExpr("conv_id AS tx", "CAST(turn AS INT) AS position", "CASE role WHEN 'system' THEN array('note', text) WHEN 'user' THEN array('add', concat('f', length(text) % 50)) ELSE array('slot', concat('s', turn), CASE WHEN length(text) % 3 = 0 THEN concat('f', length(text) % 50) ELSE string(length(text)) END) END AS words")


def _tree(name: str, body: str, size: str, extra: list[str]) -> Callable[[Views], DataFrame]:
    """All documents as a tree: their names, bodies and sizes as SQL expressions."""
    return lambda v: v.table("documents").selectExpr("*", f"{body} AS body").selectExpr(f"concat({name}, doc_id) AS name", "md5(body) AS md5", "sha2(body, 256) AS sha256", *extra, f"{size} AS size")


BUILD: dict[str, Callable[[Views], DataFrame]] = {
    "fix": _fix, "ver": _ver, "slo": _slo, "pblo": _pblo, "blo": _blo, "cmd": _cmd,
    "keys": lambda v: v.ver.select(F.format_string("%s-%04d.zip", "item", "versionid").alias("key")),
    "acc": lambda v: v.table("events").selectExpr("concat('u', user_id) AS key", "ts", "CAST(floor(abs(value)) AS BIGINT) AS size"),
    "tx": lambda v: v.table("orders").selectExpr("o_orderkey AS tx", "concat('c', o_custkey) AS item", "CAST(o_orderkey % 7 AS INT) AS status", "o_orderdate AS modified"),
    "loc": _tree("if(doc_id % 3 <> 0, 'd', 'l')", "text", "n_chars", ["lang AS mime"]),
    "rem": _tree("if(doc_id % 5 <> 0, 'd', 'r')", "concat(if(doc_id % 2 = 0, '', '+'), text)", "n_chars + doc_id % 2", ["CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS mime", "CAST(doc_id + 1 AS INT) AS blobid"]),
}
