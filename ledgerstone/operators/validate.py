"""Validation rules: each gives problem rows (item, blobid or versionid or bundle, rule, problem)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerstone.functions import keys as names
from ledgerstone.operators.fixity import outcome


def _problems(rows: DataFrame, keys: list[str], rules: list[tuple[str, Column, str]]) -> DataFrame:
    """One pass: a row for every rule that a row breaks."""
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(text).alias("problem"))) for rule, bad, text in rules]))
    return rows.select(*keys, F.explode(found).alias("_p")).select(*keys, "_p.rule", "_p.problem")


def _length(c: str) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def blob_problems(blobs: DataFrame, digest_bytes: tuple[int, int] = (16, 32)) -> DataFrame:
    """Rules on single blobs; lengths are of the digests as they are stored."""
    dead = F.col("deleted").isNotNull()
    named = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    rules = [
        ("V2", F.col("created").isNull(), "no save date"),
        ("V3", ~dead & (F.col("size") < 0), "negative size"),
        ("V4", ~dead & (F.col("bundle") <= 0), "no bundle"),
        ("V5", ~dead & (_length("md5") != digest_bytes[0]), "bad MD5 length"),
        ("V6", ~dead & (_length("sha256") != digest_bytes[1]), "bad SHA-256 length"),
        ("V7", ~dead & named("deleter"), "deleter on a live blob"),
        ("V8", ~dead & named("deletenote"), "delete note on a live blob"),
        ("V9", dead & (F.col("bundle") != 0), "deleted blob has a bundle"),
        ("V10", dead & (F.col("size") != 0), "deleted blob has a size"),
        ("V11", dead & ~named("deleter"), "deleted blob has no deleter"),
    ]
    return _problems(blobs, ["item", "blobid"], rules)


def manifest_problems(blobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Digests of live blobs against the manifest (item, bundle, file, md5, sha256) of their bundle; a missing entry is a mismatch."""
    m = manifest.select("item", "bundle", F.col("file").alias("_file"), F.col("md5").alias("_md5"), F.col("sha256").alias("_sha"))
    live = blobs.where("deleted is null").withColumn("_file", F.concat(F.lit("blob/"), F.col("blobid").cast("string")))
    rows = live.join(m, ["item", "bundle", "_file"], "left")
    return _problems(rows, ["item", "blobid"], [("V12", ~F.col("md5").eqNullSafe(F.col("_md5")), "MD5 differs from the manifest"), ("V13", ~F.col("sha256").eqNullSafe(F.col("_sha")), "SHA-256 differs from the manifest")])


def written_problems(writes: DataFrame) -> DataFrame:
    """A write's stated size and digests (want_*) against what came (size, md5, sha256); unstated ones (0, empty) match."""
    differs = lambda w, g: (_length(w) > 0) & ~F.col(w).eqNullSafe(F.col(g))
    bad = ((F.col("want_size") > 0) & (F.col("want_size") != F.col("size"))) | differs("want_md5", "md5") | differs("want_sha256", "sha256")
    return _problems(writes, ["item", "blobid"], [("V14", bad, "content differs from what was stated")])


def bag_problems(entries: DataFrame, manifest: DataFrame, first_only: bool = False) -> DataFrame:
    """Files of bags (bundle, name, md5, sha256) against their manifests (bundle, file, md5, sha256; empty digests aren't checked)."""
    m = manifest.select("bundle", F.col("file").alias("name"), F.col("md5").alias("_md5"), F.col("sha256").alias("_sha"), F.lit(True).alias("_listed"))
    rows = entries.withColumn("_there", F.lit(True)).join(m, ["bundle", "name"], "full")
    payload = F.col("name").startswith("data/")
    differs = lambda g, c: (_length(g) > 0) & ~F.col(g).eqNullSafe(F.col(c))
    rules = [
        ("V15", payload & F.col("_listed").isNull(), "file is not in a manifest"),
        ("V16", payload & F.col("_there").isNull(), "file is missing"),
        ("V17", F.col("_there").isNotNull() & F.col("_listed").isNotNull() & (differs("_md5", "md5") | differs("_sha", "sha256")), "checksum differs"),
    ]
    found = _problems(rows, ["bundle", "name"], rules)
    if first_only:
        found = found.groupBy("bundle").agg(F.min(F.struct("rule", "name", "problem")).alias("p")).select("bundle", "p.name", "p.rule", "p.problem")
    return found


def reference_problems(slots: DataFrame, blobs: DataFrame) -> DataFrame:
    """An extension of ours: slots without a blob, blobs without a slot."""
    known = blobs.select("item", "blobid")
    lost = slots.where("blobid > 0").select("item", "blobid").distinct().join(known, ["item", "blobid"], "left_anti").select("item", "blobid", F.lit("X1").alias("rule"), F.lit("slot without a blob").alias("problem"))
    idle = blobs.where("deleted is null").select("item", "blobid").join(slots.select("item", "blobid").distinct(), ["item", "blobid"], "left_anti").select("item", "blobid", F.lit("X2").alias("rule"), F.lit("blob without a slot").alias("problem"))
    return lost.unionByName(idle)


def bytes_checked(entries: DataFrame) -> DataFrame:
    """(item, bytes): the bytes that a check of each item reads, over all entries (bundle, size) of its bundles."""
    return entries.groupBy(names.bundle_item(F.col("bundle")).alias("item")).agg(F.sum("size").alias("bytes"))


def manifest_outcome(parsed: DataFrame) -> DataFrame:
    """(bundle, status) of parsed manifests: a digest that isn't hex makes the bundle's check an error."""
    return parsed.groupBy("bundle").agg(outcome(F.lit(0), F.coalesce(F.bool_or("bad"), F.lit(False))).alias("status"))


def verdicts(items: DataFrame, problems: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """status and notes (the problems in order, one a line) of each item; errors: items whose check failed."""
    line = F.concat_ws(" ", "rule", "problem")
    told = problems.groupBy("item").agg(F.count("*").alias("n"), F.concat_ws("\n", F.array_sort(F.collect_list(line))).alias("notes"))
    rows = items.select("item").distinct().join(told, "item", "left")
    rows = rows.join(errors.select("item", F.lit(True).alias("_e")).distinct(), "item", "left") if errors is not None else rows.withColumn("_e", F.lit(None).cast("boolean"))
    return rows.select("item", outcome(F.coalesce("n", F.lit(0)), F.coalesce("_e", F.lit(False))).alias("status"), F.coalesce("notes", F.lit("")).alias("notes"))
