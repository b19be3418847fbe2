"""Scalar functions and keys on literal cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerstone.functions import keys, scalars


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def strings(spark, values, *columns):
    return one(spark, [(v,) for v in values], "s string", *columns)


def test_bundle_keys(spark):
    cases = {"xyz-0001": ("xyz", 1), "b930agg8z-002003": ("b930agg8z", 2003), "abcdefg": ("", 0), "abc-0001-1": ("abc-0001", 1), "abc-0001-2": ("abc-0001", 2), "abc-0001-z": ("", 0), "q-7.zip": ("q", 7), "a- 4": ("", 0)}
    assert strings(spark, cases, keys.bundle_item(F.col("s")), keys.bundle_number(F.col("s"))) == list(cases.values())
    assert one(spark, [("a", 1), ("a", 12345)], "i string, n int", keys.bundle_key(F.col("i"), F.col("n"))) == [("a-0001.zip",), ("a-12345.zip",)]


def test_blob_names(spark):
    assert strings(spark, ["blob/234", "abc/6", "blob/3/5", "blob/cdef", "blob/"], keys.blob_number(F.col("s"))) == [(234,), (0,), (0,), (0,), (0,)]


def test_pair_tree(spark):
    cases = {"": "./", "x": "x/", "xy": "xy/", "xyz": "xy/z/", "wxyz": "wx/yz/", "vwxyz": "vw/xy/", "b930agg8z": "b9/30/"}
    assert strings(spark, cases, keys.pair_tree(F.col("s"))) == [(v,) for v in cases.values()]


def test_key_validity(spark):
    assert strings(spark, ["abc", "a/b", "a b", "a b", "a\x07", "é-1", ""], keys.key_valid(F.col("s"))) == [(True,), (False,), (False,), (False,), (False,), (True,), (True,)]


def test_numbered_and_quoted(spark):
    assert one(spark, [("it", 7)], "i string, n int", keys.numbered_key(F.col("i"), F.col("n")), keys.etag(F.col("n")), keys.upload_key(F.col("i"), F.lit("ab"))) == [("it+0007", '"7"', "it-ab")]


def test_slot_names(spark):
    assert strings(spark, ["/a/b/c", "/a/b", "/x/y"], keys.slot_name(F.col("s"), "/a/b")) == [("c",), ("b",), ("x/y",)]


def test_human_sizes(spark):
    cases = {-1: "-1 Bytes", 0: "0 Bytes", 10: "10 Bytes", 999: "999 Bytes", 1000: "1 KB", 999999: "999 KB", 10**6: "1 MB", 10**7: "10 MB", 10**8: "100 MB", 10**9: "1 GB", 10**10: "10 GB", 10**11: "100 GB", 10**12: "1 TB", 10**16: "10000 TB"}
    assert one(spark, [(k,) for k in cases], "n long", scalars.human_size(F.col("n"))) == [(v,) for v in cases.values()]


def test_times(spark):
    cases = {"": True, "*": True, "2017-10-01": True, "2017-10-01T05:10:15Z": True, "2017-10-01T05:10:15.25+02:00": True, "2017-10": False, "2017": False, "not a time": False, "Sep 5, 2017": False, "2017-10-01T05:10:15": False}
    at, valid = scalars.parse_time(F.col("s"), F.lit("2000-01-01").cast("timestamp"))
    got = strings(spark, cases, valid, at.cast("string"))
    assert [g[0] for g in got] == list(cases.values())
    assert [g[1] for g in got][:5] == ["2000-01-01 00:00:00", None, "2017-10-01 00:00:00", "2017-10-01 05:10:15", "2017-10-01 03:10:15.25"]


def test_statuses_and_roles(spark):
    assert strings(spark, ["ok", "scheduled", "error", "mismatch", "", "something", "OK", "mismatches"], scalars.fixity_status_valid(F.col("s"))) == [(True,)] * 5 + [(False,)] * 3
    assert strings(spark, ["MDOnly", "read", "WRITE", "Admin", "unknown", "other"], scalars.role_rank(F.col("s"))) == [(1,), (2,), (3,), (4,), (0,), (0,)]
    assert one(spark, [(0,), (5,), (6,), (7,), (-1,)], "n int", scalars.tx_status_label(F.col("n"))) == [("StatusUnknown",), ("StatusFinished",), ("StatusError",), ("Status(7)",), ("Status(-1)",)]


def test_digests(spark):
    raw = b"0123456789" * 7
    md5, sha = hashlib.md5(raw), hashlib.sha256(raw)
    df = spark.createDataFrame([(raw, md5.digest(), sha.digest()), (raw, b"", None), (raw, b"x", None)], "c binary, m binary, s binary")
    assert [tuple(r) for r in df.select(*scalars.digests(F.col("c"))).distinct().collect()] == [(md5.hexdigest(), sha.hexdigest())]
    assert [r[0] for r in df.select(scalars.stream_verified(F.col("c"), F.col("m"), F.col("s"))).collect()] == [True, True, False]
    assert strings(spark, ["00ff", "zz"], F.length(scalars.from_hex(F.col("s")))) == [(2,), (0,)]
    assert strings(spark, ["YWI=", "@@"], scalars.from_base64(F.col("s")).cast("string")) == [("ab",), (None,)]


def test_numbers(spark):
    assert one(spark, [(35,), (36,), (71,)], "n long", scalars.base36(F.col("n"))) == [("z",), ("10",), ("1z",)]
    assert one(spark, [(0,), (5,), (6,), (30,)], "n int", scalars.part_size(F.col("n"))) == [(64 << 20,), (2048 << 20,), (4 << 30,), (4 << 30,)]
    assert one(spark, [(12,), (13,)], "n long", scalars.cacheable(F.col("n"), F.lit(104)), scalars.cacheable(F.col("n"), F.lit(0))) == [(True, True), (False, True)]


def test_jitter_stays_in_range(spark):
    rows = spark.range(500).select(scalars.jittered(F.lit("2024-01-01").cast("timestamp"), F.col("id"), 10, 100).alias("t")).selectExpr("min(t) >= timestamp '2024-01-01 00:00:10'", "max(t) < timestamp '2024-01-01 00:01:40'", "count(distinct t) > 50").first()
    assert tuple(rows) == (True, True, True)


@pytest.mark.parametrize("text,want", [("2017-10-01T05:10:15.123Z", "2017-10-01 05:10:15"), ("2017-10-01T05:10:15", "2017-10-01 05:10:15")])
def test_shown_dates(spark, text, want):
    assert strings(spark, [text], scalars.shown_date(F.col("s"))) == [(want,)]
