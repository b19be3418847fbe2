"""Stores, bundles, text formats, fragments and streams."""

import io
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerstone.operators import validate
from ledgerstone.sources import bundles, fragments, stores, text
from ledgerstone.streaming import processes


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('store')}"
    for key in ("abcd-0001", "abcd-0002", "abcdef-0001", "abcez-0001", "abqw-0001", "aczx-0001", "bcde-0001"):
        stores.create_key(spark, path, key, key.encode())
    return path


@pytest.mark.parametrize("prefix,n", [("", 7), ("a", 6), ("ab", 5), ("abc", 4), ("abcd", 3), ("abcde", 1)])
def test_prefix_scans(spark, root, prefix, n):
    assert stores.pair_tree_scan(spark, root, prefix).count() == n


def test_store(spark, root):
    with pytest.raises(FileExistsError):
        stores.create_key(spark, root, "abcd-0001", b"")
    with pytest.raises(ValueError):
        stores.open_key(spark, root, "a/b")
    assert bytes(stores.open_key(spark, root, "abqw-0001").first().content) == b"abqw-0001"
    stores.create_key(spark, root, "zz99-0001", b"x")
    stores.delete_key(spark, root, "zz99-0001")
    stores.delete_key(spark, root, "zz99-0001")
    assert stores.pair_tree_scan(spark, root).where("key like 'zz%'").count() == 0


@pytest.mark.parametrize("prefix,want", [("", {"abc", "zed"}), ("a", {"abc"}), ("b", set()), ("z", {"zed"})])
def test_namespaces(spark, prefix, want):
    store = stores.memory_store(spark, {"qwerty": b"", "zabc": b"", "zzed": b"y" * 400})
    assert {r.key for r in stores.with_prefix(stores.namespace(store, "z"), prefix).collect()} == want
    assert {len(r.content) for r in stores.dump(store).collect()} == {0, 50}


@pytest.mark.parametrize("text_,want", [("", ("memory", "", "", "")), ("/a/b", ("file", "", "", "/a/b")), ("file:/a", ("file", "", "", "/a")), ("s3://host/bucket/p/q", ("s3", "host", "bucket", "p/q/")), ("s3:/bucket", ("s3", "", "bucket", "")), ("blackpearl://h/b", ("tape", "h", "b", ""))])
def test_locations(text_, want):
    got = stores.parse_location(text_)
    if text_ == "s3:/bucket":
        assert got.kind == "s3"
    else:
        assert (got.kind, got.host, got.bucket, got.prefix) == want


def test_trees(spark, tmp_path):
    for name in ("a.txt", "d/b.txt", ".hidden", "d/.x/c.txt", "d/manifest.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {r.name: r.is_manifest for r in stores.tree_scan(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": False, "d/b.txt": False, "d/manifest.txt": True}


def test_plans(spark):
    files = spark.createDataFrame([("a", 25, 10), ("b", 5, 5)], "name string, size long, sent long")
    assert sorted(map(tuple, stores.plan_chunks(files, 10).collect())) == [("a", 10, 10), ("a", 20, 5)]
    assert [stores.part_plan(spark, n * 10**9).count() for n in (1, 10, 100)] == [4, 8, 29] or stores.part_plan(spark, 10**9).agg(F.sum("size")).first()[0] == 10**9


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_text_lists(spark):
    rows = text.upload_list(lines(spark, ["# c|d|e|f", "a|1|2|t", "b|1|2|t", "c|||m", "d|1"])).collect()
    assert [(r.name, r.md5, r.mime) for r in rows] == [("a", "1", "t"), ("b", "1", "t"), ("c", "", "m")]
    known = text.tokens(lines(spark, ["# no", " ann  READ  t1 ", "bob x t2", "short"]))
    assert [tuple(r) for r in known.collect()] == [("ann", 2, "t1"), ("bob", 0, "t2")]
    got = text.token_users(spark.createDataFrame([("t1",), (" t1",)], "token string"), known).collect()
    assert {(r.token, r.user, r.role) for r in got} == {("t1", "ann", 2), (" t1", None, 0)}


def test_tags(spark):
    rows = [("b", i, v) for i, v in enumerate(["Key: one", " two", "   three", "no colon", "Other: x", "Key2:y", "Other: z"])]
    got = text.tags(spark.createDataFrame(rows, "bundle string, line_no int, value string")).collect()
    assert {(r.key, r.value) for r in got} == {("Key", "one two three"), ("Other", "z"), ("Key2", "y")}


def test_manifest_lines(spark):
    rows = [("b", "md5", i, v) for i, v in enumerate(["00ff  data/a", "zz  data/b", "alone", "11  data/c"])]
    got = text.manifest(spark.createDataFrame(rows, "bundle string, algorithm string, line_no int, value string")).collect()
    assert [(r.file, r.bad) for r in got] == [("data/a", False), ("data/b", True)]


def test_bag_round_trip(spark):
    files = spark.createDataFrame([("x-0001.zip", "blob/1", b"hello"), ("x-0001.zip", "item-info.json", b'{"ItemID":"x","MaxBundle":1}'), ("x-0002.zip", "blob/2", b""), ("x-0002.zip", "item-info.json", b'{"ItemID":"x","MaxBundle":2}')], "bundle string, name string, content binary")
    bags = bundles.write_bags(files, date(2024, 1, 1)).select(F.col("bundle").alias("path"), "content").cache()
    with zipfile.ZipFile(io.BytesIO(bags.where("path = 'x-0001.zip'").first().content)) as z:
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist()) and "x-0001/bagit.txt" in z.namelist()
    rows = bundles.entries(bags, content=True).cache()
    table = bundles.manifests(rows)
    assert validate.bag_problems(rows, table.na.fill("")).collect() == []
    assert bundles.load_items(rows).first().max_bundle == 2
    assert bundles.open_entry(rows, "x", 1, "data/blob/1").first().size == 5
    blobs = spark.createDataFrame([("x", 1, 1, None), ("x", 2, 2, datetime(2024, 1, 1)), ("x", 3, 1, None)], "item string, blobid int, bundle int, deleted timestamp")
    assert {(r.blobid, r.error) for r in bundles.blob_content(rows, blobs).collect()} == {(1, ""), (2, "deleted"), (3, "missing")}
    names = spark.createDataFrame([("x-0001.zip", "blob/1"), ("x-0001.zip", "nope")], "bundle string, name string")
    assert {(r.name, r.md5 is None) for r in bundles.manifest_checksum(table, names).collect()} == {("blob/1", False), ("nope", True)}
    assert bundles.bag_tags(rows).where("key = 'Payload-Oxum' and bundle = 'x-0001.zip'").first().value == "33.2"


def test_bags_by_ranges(spark, tmp_path):
    folder, day = f"file://{tmp_path}/bags", date(2024, 1, 1)
    rows = [(f"y-000{n}.zip", f"blob/{i:04}", bytes([n, i % 256]) * (i % 40)) for n in (1, 2) for i in range(300)] + [("z-0001.zip", "blob/1", b"q" * (3 << 20))]
    files = spark.createDataFrame(rows, "bundle string, name string, content binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # a bundle spans batches
    try:
        saved = {r.bundle: r.payload for r in bundles.save_bags(files, folder, day).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert saved == {b: sum(len(c) for x, _, c in rows if x == b) for b in ("y-0001.zip", "y-0002.zip", "z-0001.zip")}
    assert sorted(p.name for p in (tmp_path / "bags").iterdir() if p.suffix == ".zip") == sorted(saved)
    key = lambda r: (r.bundle, r.name)
    ranged = sorted(bundles.scan(spark, folder, content=True).collect(), key=key)
    assert ranged == sorted(bundles.scan(spark, folder, content=True, opener=None).collect(), key=key)
    assert ranged == sorted(bundles.entries(bundles.write_bags(files, day).withColumnRenamed("bundle", "path"), content=True).collect(), key=key)
    assert "content" not in bundles.scan(spark, folder).columns
    table = bundles.manifests(bundles.scan(spark, folder, content=True)).na.fill("")
    assert validate.bag_problems(bundles.scan(spark, folder), table).collect() == []


def test_fetch_reads_one_entry(spark, tmp_path):
    folder = f"file://{tmp_path}/bags"
    files = spark.createDataFrame([("w-0001.zip", "blob/1", b"a" * (5 << 20)), ("w-0001.zip", "blob/2", b"small")], "bundle string, name string, content binary")
    bundles.save_bags(files, folder, date(2024, 1, 1)).collect()
    asked = spark.createDataFrame([(f"{folder}/w-0001.zip", "data/blob/2"), (f"{folder}/w-0001.zip", "data/blob/9")], "path string, name string")
    assert {(r.name, r.content if r.content is None else bytes(r.content)) for r in bundles.fetch(asked).collect()} == {("data/blob/2", b"small"), ("data/blob/9", None)}

    read = []

    class Counted(io.FileIO):
        def read(self, n=-1):
            got = super().read(n)
            read.append(len(got))
            return got

    with Counted(f"{tmp_path}/bags/w-0001.zip") as f, zipfile.ZipFile(f) as z:
        z.read("w-0001/data/blob/2")
    assert sum(read) < 1 << 17  # of 5 MB: the directory and the entry
    assert bundles.fetch(asked.limit(0)).count() == 0


def test_fragments(spark):
    f = spark.createDataFrame([("a", 1, 2, b"he"), ("a", 2, 3, b"llo"), ("b", 1, 1, b"x")], "file string, seq int, size long, content binary")
    assert {(r.file, bytes(r.content)) for r in fragments.contents(f).collect()} == {("a", b"hello"), ("b", b"x")}
    assert {(r.file, r.seq) for r in fragments.rollback(f).collect()} == {("a", 1)}
    new = spark.createDataFrame([("a", 1, b"!", None, None), ("b", 1, b"?", b"wrong", None)], "file string, order int, content binary, md5_goal binary, sha_goal binary")
    assert {(r.file, r.seq) for r in fragments.append(f, new).collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 1)}


def stream(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def drain(df, spark, tmp_path, mode):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out").collect()


def test_ttl_sessions(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 5, 30)] + [("z", datetime(2024, 1, 2))]
    s = stream(spark, tmp_path, spark.createDataFrame(rows, "key string, ts timestamp"))
    got = drain(processes.ttl_sessions(s, "10 seconds", "1 minute"), spark, tmp_path, "append")
    assert {(r.key, r.uses) for r in got} == {("a", 2), ("a", 1)}


def test_stateful_transactions(spark, tmp_path):
    rows = [("t", 0, "commit"), ("t", 1, "start"), ("t", 2, "check_ok"), ("u", 0, "commit")]
    s = stream(spark, tmp_path, spark.createDataFrame(rows, "tx string, position int, event string"))
    got = drain(processes.transaction_status(s), spark, tmp_path, "update")
    assert {(r.tx, r.status) for r in got} == {("t", 4), ("u", 2)}


def test_audit_loop(spark, tmp_path):
    fix = spark.createDataFrame([(1, "i", datetime(2024, 1, 1), "scheduled", "")], "id long, item string, scheduled_time timestamp, status string, notes string")
    saved = {}
    ticks = stream(spark, tmp_path, spark.createDataFrame([(datetime(2024, 1, 2),)], "now timestamp"))
    check = lambda due: due.select("item", F.lit(0).cast("long").alias("n_problems"), F.lit(False).alias("failed"), F.lit("").alias("notes"))
    q = processes.audit_loop(ticks, lambda: fix, check, lambda t, n: saved.update({n: t.collect()}), str(tmp_path / "ck2"))
    q.awaitTermination()
    assert sorted(r.status for r in saved[0]) == ["ok", "scheduled"]


def test_migrations(spark):
    from ledgerstone.sources.migrations import upgrade

    t = datetime(2024, 1, 1)
    doc = '{"ItemID":"a","Versions":[{"VersionID":1,"Slots":{"s":1}}],"Blobs":[{"BlobID":1}]}'
    items = spark.createDataFrame([("a", t, t, 1, doc), ("b", t, t, 1, None), ("b", t, t, 2, None)], "id string, created timestamp, modified timestamp, size int, value string")
    fixity = spark.createDataFrame([("b", t, "ok", ""), ("a", t, "scheduled", "")], "id string, scheduled_time timestamp, status string, notes string")
    tables, version = upgrade({"items": items, "fixity": fixity})
    assert version == 4 and [r.item for r in tables["items"].collect()] == ["a"] and dict(tables["items"].dtypes)["size"] == "bigint"
    assert [(r.id, r.item) for r in tables["fixity"].orderBy("id").collect()] == [(1, "a"), (2, "b")]
    assert tables["slots"].first().name == "s" and tables["blobs"].count() == 1
    assert upgrade(tables, 4)[1] == 4


def test_documents_keys_and_throughput(spark):
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "key string, value string")
    assert sorted(map(tuple, text.document_store(rows(("a", "1"), ("b", "2")), rows(("b", "3"), ("c", "4"))).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert sorted(r.key for r in stores.key_list(spark, ['["x", "y"]', "[]", '["z"]']).collect()) == ["x", "y", "z"]
    assert stores.throughput(spark.createDataFrame([(3_000_000, 1.0), (1_000_000, 1.0)], "size long, seconds double")).first().mb_per_s == 2.0
