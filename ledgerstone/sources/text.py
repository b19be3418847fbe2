"""Text formats: manifests, tags, tokens, upload lists, checksum lists. Inputs are rows of text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerstone.functions import scalars


def upload_list(lines: DataFrame) -> DataFrame:
    """name, md5, sha256, mime of lines (value) with four fields between bars; comments and others are dropped."""
    parts = F.split("value", r"\|")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(parts) == 4)).select(parts.alias("p"))
    field = lambda i: F.trim(F.get("p", F.lit(i)))
    return rows.select(field(0).alias("name"), field(1).alias("md5"), field(2).alias("sha256"), field(3).alias("mime"))


def tokens(lines: DataFrame) -> DataFrame:
    """user, role, token of lines (value) with three words."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").startswith("#") & (F.size(parts) == 3)).select(parts.alias("p"))
    return rows.select(F.get("p", F.lit(0)).alias("user"), scalars.role_rank(F.get("p", F.lit(1))).alias("role"), F.get("p", F.lit(2)).alias("token"))


def token_users(requests: DataFrame, known: DataFrame) -> DataFrame:
    """requests (token, ...) with the user and role of exactly this token; role 0 without one."""
    return requests.join(known, "token", "left").withColumn("role", F.coalesce("role", F.lit(0)))


def manifest(lines: DataFrame) -> DataFrame:
    """bundle, algorithm, file, digest, bad from manifest lines (bundle, algorithm, line_no, value).

    A line that isn't two words ends its manifest; a digest that isn't hex is
    bad, which makes the whole check an error.
    """
    parts = F.split(F.trim("value"), r"\s+")
    sound = F.size(parts) == 2
    upto = Window.partitionBy("bundle", "algorithm").orderBy("line_no")
    rows = lines.withColumn("_stop", F.max((~sound).cast("int")).over(upto)).where("_stop = 0")
    digest = F.get(parts, F.lit(0))
    return rows.select("bundle", "algorithm", F.get(parts, F.lit(1)).alias("file"), F.lower(digest).alias("digest"), (~digest.rlike("^([0-9A-Fa-f]{2})+$")).alias("bad"))


def manifest_table(parsed: DataFrame) -> DataFrame:
    """One row for each file: its digests by algorithm."""
    return parsed.groupBy("bundle", "file").pivot("algorithm", ["md5", "sha1", "sha256", "sha512"]).agg(F.first("digest"))


def tags(lines: DataFrame) -> DataFrame:
    """bundle, key, value of tag lines (bundle, line_no, value): a line that begins with a space goes on with the one before; the last of a key wins."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list | None = None
        for pdf in batches:
            out = []
            for bundle, n, text in zip(pdf["bundle"], pdf["line_no"], pdf["value"], strict=True):
                if last and last[0] == bundle and text[:1] in (" ", "\t"):
                    last[3] += f" {text.strip()}"
                    continue
                if last:
                    out.append(last)
                    last = None
                key, colon, value = text.partition(":")
                if colon:
                    last = [bundle, n, key.strip(), value.strip()]
            yield pd.DataFrame(out, columns=["bundle", "line_no", "key", "value"])
        if last:
            yield pd.DataFrame([last], columns=["bundle", "line_no", "key", "value"])

    rows = lines.select("bundle", F.col("line_no").cast("long").alias("line_no"), "value").repartition("bundle").sortWithinPartitions("bundle", "line_no")
    folded = rows.mapInPandas(fold, "bundle string, line_no long, key string, value string")
    return folded.groupBy("bundle", "key").agg(F.max_by("value", "line_no").alias("value"))


def checksum_list(lines: DataFrame) -> DataFrame:
    """checksum, path from comma-separated lines."""
    parts = F.split("value", ",", 2)
    return lines.where(F.size(parts) == 2).select(F.trim(F.get(parts, F.lit(0))).alias("checksum"), F.trim(F.get(parts, F.lit(1))).alias("path"))


def document_store(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """JSON documents (key, value) after changes; the newest of a key stays."""
    rows = docs.select("key", "value").withColumn("_n", F.lit(0)).unionByName(changes.select("key", "value").withColumn("_n", F.lit(1)))
    return rows.groupBy("key").agg(F.max_by("value", "_n").alias("value"))


def as_json(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows as JSON lines, in order."""
    return rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns)).alias("value"))
