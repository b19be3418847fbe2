"""Queries on validation rules."""

from pyspark.sql import functions as F

from ledgerstone.operators import validate
from ledgerstone.plans.registry import add

_D, _L = "deleted IS NOT NULL", "deleted IS NULL"
#: rule -> (condition in DuckDB, problem)
RULES = {
    "V2": ("created IS NULL", "no save date"),
    "V3": (f"{_L} AND size < 0", "negative size"),
    "V4": (f"{_L} AND bundle <= 0", "no bundle"),
    "V5": (f"{_L} AND length(md5) <> 32", "bad MD5 length"),
    "V6": (f"{_L} AND length(sha256) <> 64", "bad SHA-256 length"),
    "V7": (f"{_L} AND deleter <> ''", "deleter on a live blob"),
    "V8": (f"{_L} AND deletenote <> ''", "delete note on a live blob"),
    "V9": (f"{_D} AND bundle <> 0", "deleted blob has a bundle"),
    "V10": (f"{_D} AND size <> 0", "deleted blob has a size"),
    "V11": (f"{_D} AND deleter = ''", "deleted blob has no deleter"),
}
_PROBLEMS = lambda v: validate.blob_problems(v.blo, (32, 64))  # noqa: E731  the view's digests are hex
_UNION = " UNION ALL ".join(f"SELECT item, blobid, '{r}' AS rule, '{p}' AS problem FROM blo WHERE {c}" for r, (c, p) in RULES.items())
for _rule, (_c, _p) in RULES.items():
    add(f"validate_{_rule.lower()}", lambda v, r=_rule: _PROBLEMS(v).where(F.col("rule") == r), "blo", f"SELECT item, blobid, '{_rule}' AS rule, '{_p}' AS problem FROM blo WHERE {_c}")
add("validate_all", _PROBLEMS, "blo", _UNION)
_MANIFEST = lambda v: v.blo.where("blobid % 13 <> 0").select("item", "bundle", F.concat(F.lit("blob/"), "blobid").alias("file"), F.when(F.col("blobid") % 17 == 0, "x").otherwise(F.col("md5")).alias("md5"), "sha256")
add("manifest_check", lambda v: validate.manifest_problems(v.blo, _MANIFEST(v)), "blo", "SELECT item, blobid, 'V12' AS rule, 'MD5 differs from the manifest' AS problem FROM blo WHERE deleted IS NULL AND (blobid % 13 = 0 OR blobid % 17 = 0) UNION ALL SELECT item, blobid, 'V13', 'SHA-256 differs from the manifest' FROM blo WHERE deleted IS NULL AND blobid % 13 = 0")
_ENTRIES = lambda v: v.blo.where("blobid % 19 <> 0").select(F.concat_ws("-", "item", "bundle").alias("bundle"), F.concat(F.lit("data/blob/"), "blobid").alias("name"), "md5", "sha256")
_LISTED = lambda v: _MANIFEST(v).select(F.concat_ws("-", "item", "bundle").alias("bundle"), F.concat(F.lit("data/"), "file").alias("file"), "md5", "sha256")
_BAG = """
    , e AS (SELECT item || '-' || bundle AS bundle, 'data/blob/' || blobid AS name, blobid, md5 FROM blo)
    , p AS (SELECT bundle, name, 'V15' AS rule, 'file is not in a manifest' AS problem FROM e WHERE blobid % 19 <> 0 AND blobid % 13 = 0
    UNION ALL SELECT bundle, name, 'V16', 'file is missing' FROM e WHERE blobid % 19 = 0 AND blobid % 13 <> 0
    UNION ALL SELECT bundle, name, 'V17', 'checksum differs' FROM e WHERE blobid % 19 <> 0 AND blobid % 13 <> 0 AND blobid % 17 = 0 AND md5 <> 'x')
"""
add("bag_verify", lambda v: validate.bag_problems(_ENTRIES(v), _LISTED(v)), "blo", f"{_BAG} SELECT * FROM p")
add("bag_verify_first", lambda v: validate.bag_problems(_ENTRIES(v), _LISTED(v), first_only=True).select("bundle", "rule", "name"), "blo", f"{_BAG} SELECT bundle, rule, name FROM (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY rule, name) AS n FROM p) WHERE n = 1")
add("write_check", lambda v: validate.written_problems(v.blo.select("item", "blobid", "size", "md5", "sha256", F.when(F.col("blobid") % 5 == 0, F.col("size") + 1).otherwise(0).alias("want_size"), F.when(F.col("blobid") % 7 == 0, "zz").otherwise("").alias("want_md5"), F.lit("").alias("want_sha256"))), "blo", "SELECT item, blobid, 'V14' AS rule, 'content differs from what was stated' AS problem FROM blo WHERE (blobid % 5 = 0 AND size + 1 > 0) OR blobid % 7 = 0")
_SLOTS = lambda v: v.slo.withColumn("blobid", F.when(F.col("blobid") % 5 == 0, F.col("blobid") + 1_000_000).otherwise(F.col("blobid")))
add("reference_check", lambda v: validate.reference_problems(_SLOTS(v), v.pblo.withColumn("deleted", F.lit(None).cast("timestamp"))), "slo pblo", """
    , s AS (SELECT item, CASE WHEN blobid % 5 = 0 THEN blobid + 1000000 ELSE blobid END AS blobid FROM slo)
    SELECT DISTINCT item, blobid, 'X1' AS rule, 'slot without a blob' AS problem FROM s WHERE blobid > 0 AND (item, blobid) NOT IN (SELECT (item, blobid) FROM pblo)
    UNION ALL SELECT item, blobid, 'X2', 'blob without a slot' FROM pblo WHERE (item, blobid) NOT IN (SELECT (item, blobid) FROM s)""")
add("problems_concat", lambda v: validate.verdicts(v.blo.where("blobid > 0"), _PROBLEMS(v)), "blo", f"""
    , p AS ({_UNION})
    SELECT i.item, CASE WHEN p.item IS NULL THEN 'ok' ELSE 'mismatch' END AS status, coalesce(p.notes, '') AS notes
    FROM (SELECT DISTINCT item FROM blo) i LEFT JOIN (SELECT item, string_agg(rule || ' ' || problem, chr(10) ORDER BY rule || ' ' || problem) AS notes FROM p GROUP BY item) p ON i.item = p.item""")
