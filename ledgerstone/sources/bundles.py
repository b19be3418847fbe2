"""Bundles: uncompressed BagIt zips. Entries stream through mapInPandas, one file of a bundle at a time."""

from __future__ import annotations

import hashlib
import io
import itertools
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from datetime import date
from typing import BinaryIO

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.functions import keys, scalars
from ledgerstone.schemas import ITEM_INFO
from ledgerstone.sources import text

CHUNK = 1 << 20
MANIFESTS = {"manifest-md5.txt": "md5", "manifest-sha1.txt": "sha1", "manifest-sha256.txt": "sha256", "manifest-sha512.txt": "sha512", "tagmanifest-md5.txt": "md5"}


def open_ranged(path: str) -> BinaryIO:
    """A seekable file read by ranges, for the schemes that Arrow opens (file, s3, gs, hdfs; s3a as s3)."""
    store, at = FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(at)


def _bag_entries(z: zipfile.ZipFile) -> tuple[str, list[zipfile.ZipInfo]]:
    """The bag's folder (the first entry's first segment) and the entries inside it."""
    infos = [i for i in z.infolist() if not i.is_dir()]
    top = infos[0].filename.partition("/")[0] + "/" if infos else ""
    return top, [i for i in infos if i.filename.startswith(top)]


def entries(files: DataFrame, content: bool = False, opener: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """bundle, name, size, md5, sha256 (and content) of each entry of zips (path, content), or (path) read by ranges through ``opener``.

    Entries outside the bag's folder are left out. Digests are computed chunk
    by chunk; contents only go on if asked for, one entry at a time.
    """
    columns = ["bundle", "name", "size", "md5", "sha256", *(["content"] if content else [])]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["path"] if opener else pdf["content"], strict=True):
                bag, rows, held = path.rsplit("/", 1)[-1], [], 0
                with opener(path) if opener else io.BytesIO(raw) as f, zipfile.ZipFile(f) as z:
                    top, infos = _bag_entries(z)
                    for info in infos:
                        md5, sha, kept = hashlib.md5(), hashlib.sha256(), []
                        with z.open(info) as entry:
                            while part := entry.read(CHUNK):
                                md5.update(part)
                                sha.update(part)
                                if content:
                                    kept.append(part)
                        rows.append((bag, info.filename[len(top) :], info.file_size, md5.hexdigest(), sha.hexdigest(), *([b"".join(kept)] if content else [])))
                        held += info.file_size * content
                        if held >= CHUNK:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    wanted = files.select("path") if opener else files.select("path", "content")
    return wanted.mapInPandas(read, "bundle string, name string, size long, md5 string, sha256 string" + ", content binary" * content)


def scan(spark: SparkSession, location: str, content: bool = False, opener: Callable[[str], BinaryIO] | None = open_ranged) -> DataFrame:
    """Entries of all bundles at a location. Spark lists the paths; bundles are read by ranges, or whole by Spark with ``opener`` None."""
    return entries(spark.read.format("binaryFile").load(location), content, opener)


def fetch(requests: DataFrame, opener: Callable[[str], BinaryIO] = open_ranged) -> DataFrame:
    """path, name, content of single entries (path, name): only a bundle's directory and the entry are read; NULL if it isn't there.

    Requests of one path that stand together share one opening of the bundle.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = (pair for pdf in batches for pair in zip(pdf["path"], pdf["name"], strict=True))
        for path, group in itertools.groupby(pairs, key=lambda pair: pair[0]):
            with opener(path) as f, zipfile.ZipFile(f) as z:
                top, infos = _bag_entries(z)
                at = {info.filename[len(top) :]: info for info in infos}
                for _, name in group:
                    yield pd.DataFrame({"path": [path], "name": [name], "content": [z.read(at[name]) if name in at else None]})

    return requests.select("path", "name").mapInPandas(read, "path string, name string, content binary")


def open_entry(rows: DataFrame, item: str, n: int, name: str) -> DataFrame:
    """One named entry of an item's n-th bundle."""
    return rows.where((keys.bundle_item(F.col("bundle")) == item) & (keys.bundle_number(F.col("bundle")) == n) & (F.col("name") == name))


def manifest_lines(rows: DataFrame) -> DataFrame:
    """(bundle, algorithm, line_no, value, tag) of all manifests among entries with content; missing ones are no matter."""
    kinds = F.create_map(*[F.lit(x) for pair in MANIFESTS.items() for x in pair])
    hit = rows.where(F.col("name").isin(*MANIFESTS))
    lines = F.posexplode(F.split(F.regexp_replace(F.decode("content", "utf-8"), r"\n$", ""), "\n"))
    return hit.select("bundle", F.element_at(kinds, F.col("name")).alias("algorithm"), F.col("name").startswith("tag").alias("tag"), lines.alias("line_no", "value"))


def manifests(rows: DataFrame) -> DataFrame:
    """bundle, file and its digests by algorithm; payload and tag files."""
    lines = manifest_lines(rows)
    parts = [text.manifest(lines.where(F.col("tag") == t)) for t in (False, True)]
    return text.manifest_table(parts[0].unionByName(parts[1]))


def bag_tags(rows: DataFrame) -> DataFrame:
    lines = rows.where("name = 'bag-info.txt'").select("bundle", F.posexplode(F.split(F.decode("content", "utf-8"), "\n")).alias("line_no", "value"))
    return text.tags(lines)


def item_infos(rows: DataFrame) -> DataFrame:
    """The parsed item document of each bundle."""
    return rows.where("name = 'data/item-info.json'").select("bundle", keys.bundle_item(F.col("bundle")).alias("item"), keys.bundle_number(F.col("bundle")).alias("n"), F.decode("content", "utf-8").alias("value"), F.from_json(F.decode("content", "utf-8"), ITEM_INFO).alias("doc"))


def load_items(rows: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """(item, value, max_bundle): the cached document, else that of the newest bundle, whose number is the item's largest."""
    newest = item_infos(rows).groupBy("item").agg(F.max_by("value", "n").alias("value"), F.max("n").alias("max_bundle"))
    if cached is None:
        return newest
    c = cached.select("item", F.col("value").alias("_v"))
    return newest.join(c, "item", "full").select("item", F.coalesce("_v", "value").alias("value"), "max_bundle")


def blob_content(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Contents of blobs (item, blobid, bundle, deleted): deleted ones have the error instead."""
    e = rows.select(keys.bundle_item(F.col("bundle")).alias("item"), keys.bundle_number(F.col("bundle")).alias("bundle"), "name", "content")
    want = blobs.withColumn("name", F.concat(F.lit("data/blob/"), F.col("blobid").cast("string")))
    out = want.join(e, ["item", "bundle", "name"], "left")
    return out.select("item", "blobid", F.when(F.col("deleted").isNull(), F.col("content")).alias("content"), F.when(F.col("deleted").isNotNull(), "deleted").when(F.col("content").isNull(), "missing").otherwise("").alias("error"))


def _fill(z: zipfile.ZipFile, top: str, rows: Iterable[tuple[str, bytes]], stamp: date) -> int:
    """Write a bag's payload in the order given, then its tags and manifests; returns the payload's bytes."""
    size, md5s, shas = 0, [], []
    for name, content in rows:
        z.writestr(zipfile.ZipInfo(f"{top}/data/{name}"), content)
        size += len(content)
        md5s.append(f"{hashlib.md5(content).hexdigest()}  data/{name}\n")
        shas.append(f"{hashlib.sha256(content).hexdigest()}  data/{name}\n")
    unit, label = 1, "Bytes"
    for name, u in scalars.SIZE_UNITS:
        if size >= u:
            unit, label = u, name
    texts = {
        "bagit.txt": "BagIt-Version: 0.97\nTag-File-Character-Encoding: UTF-8\n",
        "bag-info.txt": f"Payload-Oxum: {size}.{len(md5s)}\nBagging-Date: {stamp.isoformat()}\nBag-Size: {size // unit} {label}\n",
        "manifest-md5.txt": "".join(md5s),
        "manifest-sha256.txt": "".join(shas),
    }
    texts["tagmanifest-md5.txt"] = "".join(f"{hashlib.md5(t.encode()).hexdigest()}  {n}\n" for n, t in texts.items())
    for n, t in texts.items():
        z.writestr(zipfile.ZipInfo(f"{top}/{n}"), t)
    return size


def write_bags(files: DataFrame, stamp: date) -> DataFrame:
    """(bundle, content): a stored zip for each bundle of files (bundle, name, content), with manifests and tags.

    A bundle is cut at a fixed size (see ``pack_bundles``), so a group is bounded by that and one blob.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        bundle, out = pdf["bundle"].iloc[0], io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            _fill(z, bundle.removesuffix(".zip"), sorted(zip(pdf["name"], pdf["content"], strict=True)), stamp)
        return pd.DataFrame({"bundle": [bundle], "content": [out.getvalue()]})

    return files.select("bundle", "name", "content").groupBy("bundle").applyInPandas(build, "bundle string, content binary")


def save_bags(files: DataFrame, folder: str, stamp: date) -> DataFrame:
    """(bundle, payload bytes) of the bundles of files, written as zips into a shared folder when the result is read.

    Sorted rows stream into the store, so a worker holds one batch and a
    bundle's manifests. A bundle appears under its name once it is whole: a lost
    or repeated task leaves at most a hidden part behind.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in zip(pdf["bundle"], pdf["name"], pdf["content"], strict=True))
        store, base = FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        store.create_dir(base, recursive=True)
        for bundle, group in itertools.groupby(rows, key=lambda row: row[0]):
            part = f"{base}/.{bundle}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                size = _fill(z, bundle.removesuffix(".zip"), ((name, content) for _, name, content in group), stamp)
            store.move(part, f"{base}/{bundle}")
            yield pd.DataFrame({"bundle": [bundle], "payload": [size]})

    dealt = files.select("bundle", "name", "content").repartition("bundle").sortWithinPartitions("bundle", "name")
    return dealt.mapInPandas(build, "bundle string, payload long")


def manifest_checksum(table: DataFrame, names: DataFrame) -> DataFrame:
    """Digests of payload names (bundle, name), NULL where a manifest lacks them."""
    return names.withColumn("file", F.concat(F.lit("data/"), F.col("name"))).join(table, ["bundle", "file"], "left").drop("file")
