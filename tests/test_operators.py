"""Operators on literal cases."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerstone.operators import caching, catalog, diff, dml, fixity, transactions, validate, versions
from ledgerstone.plans.catalogue import ORACLES, QUERIES

SMOKE = "/root/testdata/sf0.001/events.parquet"
NOW = datetime(2024, 5, 1, 12)
FIX = "id long, item string, scheduled_time timestamp, status string, notes string"


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([(1, "abc", NOW, "ok", ""), (2, "abc", NOW, "error", ""), (3, "abc", NOW, "scheduled", ""), (4, "def", NOW, "scheduled", "")], FIX)


@pytest.mark.parametrize(
    "start,end,item,status,n",
    [(1, None, None, None, 0), (None, -1, None, None, 0), (None, None, "abc", None, 3), (None, None, "def", None, 1), (None, None, "def", "scheduled", 1), (None, None, "abc", "ok", 1), (None, None, "def", "ok", 0), (None, None, None, None, 4), (-1, 1, None, None, 4), (None, None, None, "scheduled", 2), (None, None, None, "ok", 1)],
)
def test_search(seeds, start, end, item, status, n):
    at = lambda h: None if h is None else NOW + timedelta(hours=h)
    assert fixity.search(seeds, at(start), at(end), item, status).count() == n


def test_search_is_pushed_to_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("item"), F.col("ts").alias("scheduled_time"), F.col("event_type").alias("status"), F.col("props").alias("notes"))
    plan = fixity.search(df, NOW, NOW, status="view")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "GreaterThanOrEqual(ts" in pushed and "EqualTo(event_type,view)" in pushed


def test_fixity_sequence(spark):
    row = lambda id_, item, h, status: (id_, item, NOW + timedelta(hours=h), status, "")
    frame = lambda *rows: spark.createDataFrame(list(rows), FIX)
    t = fixity.update(frame().limit(0), frame(row(0, "seq-1", 0, ""), row(0, "seq-1", 1, "")))
    assert [(r.id, r.status) for r in t.orderBy("id").collect()] == [(1, "scheduled"), (2, "scheduled")]
    t = fixity.update(t, frame(row(1, "seq-1", 0, "ok")))
    t = fixity.update(t, frame(row(1, "seq-1", 0, "whatever")))
    assert fixity.by_id(t, 1).first().status == "ok"
    assert [tuple(r) for r in fixity.next_check(t).collect()] == [("seq-1", NOW + timedelta(hours=1))]
    assert fixity.next_due(t, NOW + timedelta(hours=1, minutes=1)).first().id == 2
    t = fixity.update(t, frame(row(0, "fixity-2", 0, "ok")))
    assert fixity.next_check(t).where("item = 'fixity-2'").count() == 0


def test_delete_keeps_what_ran(seeds):
    assert {r.id for r in fixity.delete_scheduled(seeds, [1, 2, 3]).collect()} == {1, 2, 4}


def test_audit(spark, seeds):
    results = spark.createDataFrame([("abc", 2, False, "bad"), ("def", 0, False, "")], "item string, n_problems long, failed boolean, notes string")
    rows = fixity.audit(seeds, results, NOW).orderBy("id").collect()
    assert [(r.item, r.status) for r in rows][:4] == [("abc", "ok"), ("abc", "error"), ("abc", "mismatch"), ("def", "ok")]
    assert {(r.item, r.status) for r in rows[4:]} == {("abc", "scheduled"), ("def", "scheduled")}
    assert all(timedelta(days=182) <= r.scheduled_time - NOW < timedelta(days=365) for r in rows[4:])


def test_audit_closes_the_check_with_id_0(spark):
    fix = spark.createDataFrame([(0, "abc", NOW, "scheduled", ""), (1, "abc", NOW, "error", ""), (None, "def", NOW, "scheduled", "")], FIX)
    results = spark.createDataFrame([("abc", 0, False, ""), ("def", 0, False, "")], "item string, n_problems long, failed boolean, notes string")
    rows = sorted(((r.id, r.item, r.status) for r in fixity.audit(fix, results, NOW).collect()), key=str)
    assert [r for r in rows if r[0] is None or r[0] < 2] == [(0, "abc", "ok"), (1, "abc", "error"), (None, "def", "scheduled")]
    assert {(r[1], r[2]) for r in rows if r[0] is not None and r[0] > 1} == {("abc", "scheduled"), ("def", "scheduled")} and len(rows) == 5


def test_audit_loop_query_where_the_first_event_is_due(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT event_id - (SELECT min(event_id) FROM '{SMOKE}' WHERE event_type = 'click') AS event_id, * EXCLUDE (event_id) FROM '{SMOKE}') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES["fixity_audit_loop"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(ORACLES["fixity_audit_loop"]).fetchall())


@pytest.fixture(scope="module")
def abcd(spark):
    v = spark.createDataFrame([("abcd", 1), ("abcd", 2)], "item string, versionid int")
    s = spark.createDataFrame([("abcd", 1, 1, "a"), ("abcd", 1, 2, "b"), ("abcd", 1, 3, "c"), ("abcd", 2, 2, "b"), ("abcd", 2, 4, "c"), ("abcd", 2, 5, "d")], "item string, versionid int, blobid int, name string")
    b = spark.createDataFrame([("abcd", i, i * 10, 1) for i in range(1, 6)], "item string, blobid int, size int, bundle int")
    return v, s, b


def test_extended_slots(spark, abcd):
    cases = {"a": 0, "@1/a": 1, "b": 2, "@1/b": 2, "c": 4, "@1/d": 0, "@blob/4": 4, "@blob/04": 4, "@blob/0x4": 0, "@blob/": 0, "@x/a": 0, "@1": 0, "@9/a": 0}
    got = catalog.resolve(spark.createDataFrame([("abcd", p) for p in cases], "item string, path string"), *abcd).collect()
    assert {r.path: r.blobid for r in got} == cases


def test_maxima(spark, abcd):
    v, s, b = abcd
    assert catalog.max_version(v).first().max_version == 2
    more = v.unionByName(spark.createDataFrame([("none", 1)], v.schema))
    assert {tuple(r) for r in catalog.max_blob(more, b).collect()} == {("abcd", 5), ("none", 0)}


def test_documents_round_trip(spark):
    v = spark.createDataFrame([("i", 1, NOW, "me", "n"), ("i", 2, NOW, "me", "")], "item string, versionid int, created timestamp, creator string, note string")
    s = spark.createDataFrame([("i", 1, 1, "a/b"), ("i", 2, 1, "a/b"), ("i", 2, 2, "c")], "item string, versionid int, blobid int, name string")
    b = spark.createDataFrame([("i", 1, 3 << 31, 1, NOW, "me", b"\x01" * 16, b"\x02" * 32, "x/y", None, "", ""), ("i", 2, 5, 2, NOW, "me", b"\x03" * 16, b"\x04" * 32, "", NOW, "d", "w")], "item string, blobid int, size long, bundle int, created timestamp, creator string, md5 binary, sha256 binary, mimetype string, deleted timestamp, deleter string, deletenote string")
    back = catalog.documents_to_tables(catalog.tables_to_documents(v, s, b))
    for name, df in (("versions", v), ("slots", s), ("blobs", b)):
        assert sorted(map(tuple, back[name].select(*df.columns).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    doc = '{"ItemID":"z","Versions":[{"VersionID":1,"SaveDate":"0001-01-01T00:00:00Z","Slots":{"s":1}}],"Blobs":[{"BlobID":1,"DeleteDate":"0001-01-01T00:00:00Z","MD5":"00ff"}]}'
    t = catalog.documents_to_tables(spark.createDataFrame([(doc,)], "value string"))
    assert t["versions"].first().created is None and t["blobs"].first().deleted is None and bytes(t["blobs"].first().md5) == b"\x00\xff"


def test_carry_forward(spark):
    v = spark.createDataFrame([("i", n) for n in (1, 2, 3)], "item string, versionid int")
    c = spark.createDataFrame([("i", 1, "slot", 5), ("i", 3, "slot", 0), ("i", 3, "poem", 6)], "item string, versionid int, name string, blobid int")
    assert sorted(map(tuple, versions.carry_forward(c, v).collect())) == [("i", 1, "slot", 5), ("i", 2, "slot", 5), ("i", 3, "poem", 6)]


def test_packing(spark):
    rows = [("i", n, s) for n, s in enumerate((300, 300, 50, 600, 10), 1)] + [("j", 1, 5)]
    got = versions.pack_bundles(spark.createDataFrame(rows, "item string, blobid int, size long"), cutoff=500).orderBy("item", "blobid").collect()
    assert [r.bundle for r in got] == [1, 1, 2, 2, 3, 1]


def test_first_occurrence(spark):
    rows = [("i", 1, 5, "h", "g"), ("i", 2, 5, "h", "g"), ("i", 3, 5, "", ""), ("i", 4, 5, "", ""), ("i", 5, 0, "h", "g"), ("i", 6, 0, "h", "g"), ("j", 7, 5, "h", "g")]
    got = versions.first_occurrence(spark.createDataFrame(rows, "item string, blobid int, size long, md5 string, sha256 string")).collect()
    assert {r.blobid: r.canonical for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}


def test_upload_plan(spark):
    schema = "name string, md5 string, mime string"
    local = spark.createDataFrame([("same", "1", "t"), ("mime", "1", "t"), ("moved", "2", "t"), ("new", "9", "t"), ("new2", "9", "t")], schema)
    remote = spark.createDataFrame([("same", "1", "t", 1), ("mime", "1", "u", 1), ("other", "2", "t", 2)], schema + ", blobid int")
    got = {r.name: (r.action, r.blobid) for r in diff.plan_upload(local, remote).collect()}
    assert got == {"same": ("same", 1), "mime": ("mime", 1), "moved": ("relink", 2), "new": ("new", None), "new2": ("local_dup", None)}


def test_tombstones(spark):
    b = spark.createDataFrame([("i", n, 9, 1, "t", None, "", "") for n in range(1, 11)], "item string, blobid int, size long, bundle int, mimetype string, deleted timestamp, deleter string, deletenote string")
    ask = spark.createDataFrame([("i", n, "me", "x") for n in (1, 2, 3, 4, 5, 1)], "item string, blobid int, deleter string, note string")
    rows = {r.blobid: r for r in dml.tombstone(b, ask, NOW).collect()}
    assert (rows[1].bundle, rows[1].size, rows[1].mimetype, rows[1].deleter) == (0, 0, "", "me") and rows[10].deleted is None
    assert {r.blobid for r in dml.bundle_survivors(b, ask).collect()} == {6, 7, 8, 9, 10}


BLOB = "item string, blobid int, created timestamp, size long, bundle int, md5 binary, sha256 binary, deleted timestamp, deleter string, deletenote string"
GOOD = ("i", 0, NOW, 5, 1, b"m" * 16, b"s" * 32, None, "", "")


@pytest.mark.parametrize("rule,change", [("V2", {2: None}), ("V3", {3: -1}), ("V4", {4: 0}), ("V5", {5: b"m"}), ("V6", {6: None}), ("V7", {8: "d"}), ("V8", {9: "n"}), ("V9", {7: NOW, 8: "d", 3: 0}), ("V10", {7: NOW, 8: "d", 4: 0}), ("V11", {7: NOW, 3: 0, 4: 0})])
def test_blob_rules(spark, rule, change):
    bad = tuple(change.get(i, x) for i, x in enumerate(GOOD))
    got = validate.blob_problems(spark.createDataFrame([GOOD, ("i", 1, *bad[2:])], BLOB)).collect()
    assert [(r.blobid, r.rule) for r in got] == [(1, rule)]


def test_bag_rules(spark):
    entries = spark.createDataFrame([("ok", "data/a", "1", "2"), ("extra", "data/a", "1", "2"), ("sum", "data/a", "9", "2"), ("tag", "extra.txt", "1", "2")], "bundle string, name string, md5 string, sha256 string")
    listed = spark.createDataFrame([("ok", "data/a", "1", "2"), ("missing", "data/a", "1", "2"), ("sum", "data/a", "1", ""), ("tag", "gone.txt", "1", "")], "bundle string, file string, md5 string, sha256 string")
    assert {(r.bundle, r.rule) for r in validate.bag_problems(entries, listed).collect()} == {("extra", "V15"), ("missing", "V16"), ("sum", "V17")}


def test_commands(spark):
    good = [["delete", "4"], ["slot", "a", "b"], ["note", ""], ["add", "f"], ["mimetype", "f", "t"], ["sleep"]]
    bad = [["delete", "x"], ["delete"], ["slot", "a"], ["move", "a"], [], ["add"], ["sleep", "1"]]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in good + bad], "c array<string>").select(transactions.well_formed(F.col("c"))).collect()]
    assert got == [True] * 6 + [False] * 7


def test_replay_stops_at_the_first_error(spark):
    c = spark.createDataFrame([("t", 0, ["add", "file1"]), ("t", 1, ["add", "file2"]), ("t", 2, ["slot", "a", "file1"]), ("u", 0, ["add", "known"]), ("u", 1, ["slot", "a", "known"]), ("u", 2, ["note", "hi"])], "tx string, position int, words array<string>")
    got = {r.tx: r for r in transactions.replay(c, spark.createDataFrame([("u", "known")], "tx string, file string")).collect()}
    assert (got["t"].error, got["t"].applied, got["t"].status) == ("missing file1", 0, 6)
    assert (got["u"].error, got["u"].applied, got["u"].n_slots, got["u"].note, got["u"].status) == ("", 3, 1, "hi", 5)


def test_status_machine(spark):
    e = spark.createDataFrame([("a", 0, "commit"), ("a", 1, "start"), ("a", 2, "check_ok"), ("a", 3, "ingest_ok"), ("b", 0, "start"), ("b", 1, "commit"), ("b", 2, "start"), ("b", 3, "check_failed")], "tx string, position int, event string")
    assert {tuple(r) for r in transactions.replay_status(e).collect()} == {("a", 5), ("b", 6)}


def test_lru(spark):
    log = spark.createDataFrame([(f"k{i}", NOW + timedelta(seconds=i), 11) for i in range(10)] + [("k9", NOW + timedelta(seconds=20), 11), ("k0", NOW + timedelta(seconds=21), 11), ("big", NOW + timedelta(seconds=22), 110)], "key string, ts timestamp, size long")
    got = caching.lru_replay(log, 100).orderBy("ts").collect()
    assert sum(r.evicted for r in got[:10]) == 1 and got[10].hit and not got[11].hit and not got[12].stored


def test_ttl(spark):
    at = lambda s: NOW + timedelta(seconds=s)
    log = spark.createDataFrame([(f"k{i}", at(0)) for i in range(100)] + [(f"k{i}", at(0.5)) for i in range(0, 100, 2)] + [(f"k{i}", at(1.1)) for i in range(100)], "key string, ts timestamp")
    last = caching.ttl_hits(log, 1).where(F.col("ts") == F.lit(at(1.1))).collect()
    assert {int(r.key[1:]) for r in last if r.hit} == set(range(0, 100, 2))


def test_file_fields(spark):
    old = datetime(2020, 1, 1)
    files = spark.createDataFrame([("a", "me", None, None, "text/plain", "x", old), ("b", "me", "m", "s", "", "y", old)], "id string, creator string, md5 string, sha256 string, mimetype string, extra string, modified timestamp")
    patched = dml.patch_uploads(files, spark.createDataFrame([("a", "", "image/png")], "id string, extra string, mimetype string"), NOW)
    assert sorted(map(tuple, patched.select(*files.columns).collect())) == [("a", "me", None, None, "image/png", "x", NOW), ("b", "me", "m", "s", "", "y", old)]
    changes = spark.createDataFrame([("a", "you", "m1", "s1", None, "")], "id string, creator string, md5 string, sha256 string, mimetype string, extra string")
    assert sorted(map(tuple, dml.set_file_fields(files, changes, NOW).collect())) == [("a", "you", "m1", "s1", "text/plain", "", NOW), ("b", "me", "m", "s", "", "y", old)]


def test_transaction_changes(spark):
    old = datetime(2020, 1, 1)
    tx = spark.createDataFrame([("t1", 1, [["note", "a"]], ["e0"], old), ("t2", 1, [], [], old)], "tx string, status int, commands array<array<string>>, errors array<string>, modified timestamp")
    rows = lambda df: sorted(map(tuple, df.select(*tx.columns).collect()))
    batches = spark.createDataFrame([("t1", [["sleep"], ["delete", "4"]]), ("t2", [["sleep"], ["delete", "x"]])], "tx string, new array<array<string>>")
    assert rows(transactions.append_commands(tx, batches, NOW)) == [("t1", 1, [["note", "a"], ["sleep"], ["delete", "4"]], ["e0"], NOW), ("t2", 1, [], [], old)]
    assert rows(transactions.set_status(tx, spark.createDataFrame([("t2", 2)], "tx string, status int"), NOW)) == [("t1", 1, [["note", "a"]], ["e0"], old), ("t2", 2, [], [], NOW)]
    errors = spark.createDataFrame([("t1", 2, "b"), ("t1", 1, "c")], "tx string, position int, error string")
    assert rows(transactions.append_errors(tx, errors)) == [("t1", 1, [["note", "a"]], ["e0", "c", "b"], old), ("t2", 1, [], [], old)]


def test_last_note_and_item_document(spark):
    commands = spark.createDataFrame([("t", 1, "note", "old"), ("t", 3, "note", "new"), ("t", 4, "add", "f"), ("u", 1, "add", "f")], "tx string, position int, verb string, arg string")
    assert [tuple(r) for r in dml.last_note(commands).collect()] == [("t", "new")]
    items = spark.createDataFrame([("a", '{"ItemID": "a"}'), ("b", '{"ItemID": "b"}')], "item string, value string")
    assert [(r.item, r.doc.ItemID) for r in catalog.item_document(items, "b").collect()] == [("b", "b")]
    assert catalog.item_document(items, "c").collect() == []
