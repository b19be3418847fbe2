"""Queries on item documents, upload fields, transaction edits and bundle contents."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerstone.functions import keys
from ledgerstone.operators import catalog, dml, validate
from ledgerstone.operators import transactions as tx
from ledgerstone.plans.registry import add
from ledgerstone.plans.views import Views
from ledgerstone.sources import bundles, stores, text

NOW = datetime(2001, 8, 5)
_T = "TIMESTAMP '2001-08-05'"


def _item_json(v: Views):
    return v.table("customer").selectExpr(
        "concat('c', c_custkey) AS item",
        "to_json(named_struct('ItemID', concat('c', c_custkey), 'ByteCount', c_custkey * 10, 'MaxBundle', c_nationkey)) AS value",
    )


add(
    "item_document",
    lambda v: catalog.item_document(_item_json(v), "c7").selectExpr("item", "doc.ByteCount AS byte_count", "doc.MaxBundle AS max_bundle"),
    "",
    "SELECT 'c7' AS item, c_custkey * 10 AS byte_count, c_nationkey AS max_bundle FROM customer WHERE c_custkey = 7",
)


def _round_trip(v: Views) -> dict:
    """The catalog's tables written as item documents and read back."""
    no_text, no_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    digest = F.unhex(F.md5(F.col("blobid").cast("string")))
    blobs = v.pblo.withColumns({"md5": digest, "sha256": digest, "created": no_time, "deleted": no_time, "deleter": no_text, "deletenote": no_text})
    return catalog.documents_to_tables(catalog.tables_to_documents(v.ver.drop("orderkey"), v.slo, blobs))


add("document_slots", lambda v: _round_trip(v)["slots"], "slo", "SELECT item, versionid, blobid, name FROM slo")
add(
    "document_blobs",
    lambda v: _round_trip(v)["blobs"].select("item", "blobid", "size", "bundle", "mimetype", "creator", F.lower(F.hex("md5")).alias("md5")),
    "pblo",
    "SELECT item, blobid, size, bundle, mimetype, creator, md5(CAST(blobid AS VARCHAR)) AS md5 FROM pblo",
)
add(
    "document_store",
    lambda v: text.document_store(
        v.table("customer").selectExpr("concat('k', c_custkey) AS key", "c_name AS value"),
        v.table("supplier").selectExpr("concat('k', s_suppkey) AS key", "s_name AS value"),
    ),
    "",
    "SELECT 'k' || coalesce(s_suppkey, c_custkey) AS key, coalesce(s_name, c_name) AS value FROM customer FULL JOIN supplier ON s_suppkey = c_custkey",
)
add(
    "json_lines",
    lambda v: text.as_json(v.table("nation").select("n_nationkey", "n_name"), ["n_nationkey"]),
    "",
    "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation",
)
add(
    "remote_key_list",
    lambda v: stores.listed_keys(v.table("nation").selectExpr("to_json(array(n_name, concat('region', n_regionkey))) AS value")),
    "",
    "SELECT n_name AS key FROM nation UNION ALL SELECT 'region' || n_regionkey FROM nation",
)

# Orders as uploaded files, customers as the changes to those with the same number.
_FILE = "o_orderkey AS id", "o_orderstatus AS extra", "o_orderpriority AS mimetype", "o_orderdate AS modified"
_MOVED = f"CASE WHEN c_custkey IS NULL THEN o_orderdate ELSE {_T} END AS modified"
_JOINED = "FROM orders LEFT JOIN customer ON c_custkey = o_orderkey"
add(
    "patch_uploads",
    lambda v: dml.patch_uploads(
        v.table("orders").selectExpr(*_FILE),
        v.table("customer").selectExpr("c_custkey AS id", "if(c_custkey % 2 = 0, '', c_name) AS extra", "if(c_custkey % 3 = 0, '', c_mktsegment) AS mimetype"),
        NOW,
    ),
    "",
    f"""SELECT o_orderkey AS id, CASE WHEN c_custkey % 2 = 1 THEN c_name ELSE o_orderstatus END AS extra,
               CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE o_orderpriority END AS mimetype, {_MOVED} {_JOINED}""",
)
add(
    "set_file_fields",
    lambda v: dml.set_file_fields(
        v.table("orders").selectExpr(*_FILE, "concat('u', o_custkey) AS creator", "md5(o_orderstatus) AS md5", "'' AS sha256"),
        v.table("customer").selectExpr(
            "c_custkey AS id", "if(c_custkey % 2 = 0, NULL, c_name) AS creator", "if(c_custkey % 3 = 0, '', md5(c_name)) AS md5",
            "sha2(c_name, 256) AS sha256", "CAST(NULL AS STRING) AS mimetype", "c_mktsegment AS extra",
        ),
        NOW,
    ),
    "",
    f"""SELECT o_orderkey AS id, coalesce(c_mktsegment, o_orderstatus) AS extra, o_orderpriority AS mimetype, {_MOVED},
               CASE WHEN c_custkey % 2 = 1 THEN c_name ELSE 'u' || o_custkey END AS creator,
               CASE WHEN c_custkey IS NULL THEN md5(o_orderstatus) WHEN c_custkey % 3 = 0 THEN '' ELSE md5(c_name) END AS md5,
               coalesce(sha256(c_name), '') AS sha256 {_JOINED}""",
)
add(
    "tx_last_note",
    lambda v: dml.last_note(v.cmd.selectExpr("tx", "position", "words[0] AS verb", "words[1] AS arg")),
    "cmd",
    "SELECT tx, arg_max(words[2], position) AS note FROM cmd WHERE words[1] = 'note' GROUP BY tx",
)
add(
    "tx_append_commands",
    lambda v: tx.append_commands(
        v.tx.withColumn("commands", F.array(F.array(F.lit("note"), F.col("item")))),
        v.table("customer").selectExpr("c_custkey AS tx", "if(c_custkey % 2 = 0, array(array('note', c_name)), array(array('note', 'a'), array('delete', 'x'))) AS new"),
        NOW,
    ).select("tx", F.size("commands").alias("n"), F.element_at("commands", -1)[1].alias("last"), "modified"),
    "tx",
    f"""SELECT tx, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE item END AS "last",
               CASE WHEN c_custkey % 2 = 0 THEN {_T} ELSE modified END AS modified
        FROM tx LEFT JOIN customer ON c_custkey = tx""",
)
add(
    "tx_set_status",
    lambda v: tx.set_status(v.tx, v.table("customer").selectExpr("c_custkey AS tx", "CAST(c_custkey % 6 + 1 AS INT) AS status"), NOW),
    "tx",
    f"""SELECT tx, item, CAST(coalesce(c_custkey % 6 + 1, status) AS INT) AS status, CASE WHEN c_custkey IS NULL THEN modified ELSE {_T} END AS modified
        FROM tx LEFT JOIN customer ON c_custkey = tx""",
)
add(
    "tx_append_errors",
    lambda v: tx.append_errors(
        v.tx.select("tx", F.array(F.lit("old")).alias("errors")),
        v.table("lineitem").selectExpr("l_orderkey AS tx", "l_linenumber AS position", "concat('line ', l_linenumber) AS error"),
    ).select("tx", F.array_join("errors", ", ").alias("errors")),
    "tx",
    """, e AS (SELECT l_orderkey AS tx, string_agg(', line ' || l_linenumber, '' ORDER BY l_linenumber) AS more FROM lineitem GROUP BY 1)
       SELECT tx, 'old' || coalesce(more, '') AS errors FROM tx LEFT JOIN e USING (tx)""",
)
add(
    "transfer_rate",
    lambda v: stores.throughput(v.table("documents").selectExpr("n_chars AS size", "doc_id % 10 + 1 AS seconds")),
    "",
    "SELECT sum(n_chars) / 1e6 / sum(doc_id % 10 + 1) AS mb_per_s FROM documents",
)


def _entries(v: Views):
    """Documents as entries of their source's bundles, of which every hundredth document starts one."""
    at = keys.bundle_key(F.col("source"), (F.col("doc_id") / 100).cast("int") + 1)
    return v.table("documents").select(at.alias("bundle"), F.concat(F.lit("data/blob/"), "doc_id").alias("name"), F.col("n_chars").alias("size"), F.col("text").cast("binary").alias("content"))


add(
    "blob_contents",
    lambda v: bundles.blob_content(
        _entries(v),
        v.table("documents").selectExpr("source AS item", "doc_id AS blobid", "CAST(doc_id div 100 + 1 + if(doc_id % 7 = 0, 1, 0) AS INT) AS bundle", "if(doc_id % 11 = 0, 'x', NULL) AS deleted"),
    ).select("item", "blobid", F.md5("content").alias("md5"), "error"),
    "",
    """SELECT source AS item, doc_id AS blobid, CASE WHEN doc_id % 11 > 0 AND doc_id % 7 > 0 THEN md5(text) END AS md5,
              CASE WHEN doc_id % 11 = 0 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'missing' ELSE '' END AS error FROM documents""",
)
add(
    "bytes_checksummed",
    lambda v: validate.bytes_checked(_entries(v)),
    "",
    "SELECT source AS item, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source",
)


def _manifest(v: Views):
    """One line for each document, with a digest that isn't hex in the bundles of some sources."""
    digest = F.when(F.col("source").endswith("3"), "xyz").otherwise(F.md5("text"))
    lines = v.table("documents").select(F.col("source").alias("bundle"), F.lit("md5").alias("algorithm"), F.col("doc_id").alias("line_no"), F.concat(digest, F.lit("  data/blob/"), "doc_id").alias("value"))
    return text.manifest(lines)


add(
    "manifest_status",
    lambda v: validate.manifest_outcome(_manifest(v)),
    "",
    "SELECT DISTINCT source AS bundle, CASE WHEN source LIKE '%3' THEN 'error' ELSE 'ok' END AS status FROM documents",
)
add(
    "manifest_lookup",
    lambda v: bundles.manifest_checksum(text.manifest_table(_manifest(v)), v.table("documents").selectExpr("source AS bundle", "concat('blob/', doc_id + doc_id % 2) AS name")).select("bundle", "name", "md5"),
    "",
    """SELECT d.source AS bundle, 'blob/' || (d.doc_id + d.doc_id % 2) AS name, CASE WHEN e.source LIKE '%3' THEN 'xyz' ELSE md5(e.text) END AS md5
       FROM documents d LEFT JOIN documents e ON e.source = d.source AND e.doc_id = d.doc_id + d.doc_id % 2""",
)
