"""Key stores as DataFrames: scans, prefix scans, namespaces, locations, tree scans, writes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.functions import keys

_BASE = r"([^/]+)/?$"


def pair_tree_scan(spark: SparkSession, root: str, prefix: str = "", content: bool = False) -> DataFrame:
    """key, size, modified (and content) of files exactly two folders deep; the prefix's first letters prune folders.

    Without content nothing is opened: the column isn't read.
    """
    top, sub = prefix[:2], prefix[2:4]
    glob = f"{root.rstrip('/')}/{top + '*' * (len(top) < 2)}/{sub + '*' * (len(sub) < 2)}/{prefix}*"
    rows = spark.read.format("binaryFile").load(glob)
    out = rows.select(F.regexp_extract("path", _BASE, 1).alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out.where(F.col("key").startswith(prefix)) if prefix else out


def open_key(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The content of one key; a key with a slash is refused."""
    if "/" in key:
        raise ValueError(f"bad key {key!r}")
    a, b = key[:2], key[2:4]
    path = "/".join(x for x in (root.rstrip("/"), a, b, key) if x)
    return spark.read.format("binaryFile").load(path).select(F.lit(key).alias("key"), F.col("length").alias("size"), "content")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create_key(spark: SparkSession, root: str, key: str, content: bytes) -> None:
    """Write to a scratch folder, then rename; an existing key is an error."""
    if "/" in key:
        raise ValueError(f"bad key {key!r}")
    target, fs = _file_system(spark, "/".join(x for x in (root.rstrip("/"), key[:2], key[2:4], key) if x))
    if fs.exists(target):
        raise FileExistsError(key)
    scratch, _ = _file_system(spark, f"{root.rstrip('/')}/scratch/{key}")
    out = fs.create(scratch, True)
    out.write(bytearray(content))
    out.close()
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(scratch, target):
        raise FileExistsError(key)


def delete_key(spark: SparkSession, root: str, key: str) -> None:
    """A missing key is no error."""
    target, fs = _file_system(spark, "/".join(x for x in (root.rstrip("/"), key[:2], key[2:4], key) if x))
    fs.delete(target, False)


def memory_store(spark: SparkSession, values: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in values.items()], "key string, size long, content binary")


def dump(store: DataFrame, most: int = 300, shown: int = 50) -> DataFrame:
    """For debugging: long values are cut."""
    return store.select("key", F.when(F.length("content") > most, F.substring("content", 1, shown)).otherwise(F.col("content")).alias("content"))


def with_prefix(store: DataFrame, prefix: str) -> DataFrame:
    """Keys that start with the prefix."""
    return store.where(F.col("key").startswith(prefix)) if prefix else store


def namespace(store: DataFrame, prefix: str) -> DataFrame:
    """The keys of a namespace, without its prefix."""
    return store.where(keys.in_namespace(F.col("key"), prefix)).withColumn("key", keys.strip_namespace(F.col("key"), prefix))


def object_scan(spark: SparkSession, location: str, prefix: str = "") -> DataFrame:
    """Keys of an object store folder (s3a or another Hadoop scheme), the prefix pushed into the listing."""
    return spark.read.format("binaryFile").load(f"{location.rstrip('/')}/{prefix}*").select(F.regexp_extract("path", _BASE, 1).alias("key"), F.col("length").alias("size"))


@dataclass(frozen=True)
class Location:
    kind: str
    host: str
    bucket: str
    prefix: str


def split_bucket(path: str) -> tuple[str, str]:
    """A bucket and a prefix that ends with a slash, if there is one."""
    bucket, _, prefix = path.strip("/").partition("/")
    return bucket, f"{prefix}/" if prefix else ""


def parse_location(text: str, addition: str = "") -> Location:
    """memory (empty), file (plain or file:), s3 and tape gateways by scheme; addition is a subfolder."""
    if not text:
        return Location("memory", "", "", "")
    scheme, sep, rest = text.partition(":")
    if not sep or scheme == "file":
        return Location("file", "", "", "/".join(x for x in ((rest if sep else text).rstrip("/"), addition) if x))
    kinds = {"s3": "s3", "s3a": "s3", "blackpearl": "tape", "blackpearls": "tape"}
    if scheme not in kinds:
        raise ValueError(f"unknown location {text!r}")
    host, _, path = rest.removeprefix("//").partition("/")
    bucket, prefix = split_bucket(path)
    return Location(kinds[scheme], host, bucket, prefix + (f"{addition}/" if addition else ""))


def tree_scan(spark: SparkSession, root: str, content: bool = True, manifest: str = "manifest.txt") -> DataFrame:
    """name (below root), size, md5 of all files without a dot segment in their path; is_manifest marks those with the manifest's name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{root.rstrip('/').removeprefix('file://')}/", "")
    out = rows.select(name.alias("name"), F.col("length").alias("size"), *([F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256")] if content else []))
    return out.where(~F.col("name").rlike(r"(^|/)\.")).withColumn("is_manifest", F.element_at(F.split("name", "/"), -1) == manifest)


def key_list(spark: SparkSession, text: Iterable[str]) -> DataFrame:
    """A remote listing: JSON arrays of keys."""
    return listed_keys(spark.createDataFrame([(x,) for x in text], "value string"))


def listed_keys(lines: DataFrame) -> DataFrame:
    """key of every JSON array of keys among lines (value), as ``spark.read.text`` gives them."""
    return lines.select(F.explode(F.from_json("value", "array<string>")).alias("key"))


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an SQL server; filters and columns are pushed to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def plan_chunks(files: DataFrame, chunk: int) -> DataFrame:
    """The chunks (name, offset, size) left to send of files (name, size, sent); complete files have none."""
    left = files.where(F.col("sent") < F.col("size"))
    starts = F.explode(F.sequence(F.col("sent"), F.col("size") - 1, F.lit(chunk).cast("long")))
    return left.select("name", F.col("size").alias("_size"), starts.alias("offset")).select("name", "offset", F.least(F.lit(chunk).cast("long"), F.col("_size") - F.col("offset")).alias("size"))


def part_plan(spark: SparkSession, total: int) -> DataFrame:
    """Parts (part, size) of a multi-part upload of ``total`` bytes: 64 MiB doubling to 4 GiB."""
    from ledgerstone.functions.scalars import FIRST_PART, LARGEST_PART

    parts, left, n = [], total, 0
    while left > 0:
        size = min(left, FIRST_PART << n if n < 6 else LARGEST_PART)
        parts.append((n + 1, size))
        left, n = left - size, n + 1
    return spark.createDataFrame(parts, "part int, size long")


def synthetic_items(spark: SparkSession, items: int = 10_000, most_files: int = 10, most_bytes: int = 100_000_000, seed: int = 1) -> DataFrame:
    """A load test's files: item, file, size."""
    draw = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), *c)), 1, 8), 16, 10).cast("long")
    n = draw("id") % most_files + 1
    rows = spark.range(items).select(F.format_string("item-%05d", "id").alias("item"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("file"))
    return rows.select("item", F.col("file").cast("int").alias("file"), (draw("item", "file") % most_bytes).alias("size"))


def throughput(transfers: DataFrame) -> DataFrame:
    """MB/s over transfers (size, seconds)."""
    return transfers.agg((F.sum("size") / 1e6 / F.sum("seconds")).alias("mb_per_s"))
