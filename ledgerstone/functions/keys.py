"""Names and keys: bundles, slots, blobs, caches, fragments, pair-tree folders. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BUNDLE = r"^(.*)-([+-]?[0-9]+)$"


def _int(text: Column) -> Column:
    """A captured run of digits as INT; NULL if there is none or it is too large."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def bundle_key(item: Column, n: Column) -> Column:
    """``item-0001.zip``: padded to four digits, longer numbers in full."""
    return F.format_string("%s-%04d.zip", item, n)


def _bare(key: Column) -> Column:
    return F.regexp_replace(key, r"\.zip$", "")


def bundle_number(key: Column) -> Column:
    """The number after the last dash; 0 if the key isn't a bundle's."""
    return F.coalesce(_int(F.regexp_extract(_bare(key), _BUNDLE, 2)), F.lit(0))


def bundle_item(key: Column) -> Column:
    """The item before the last dash; empty if the key isn't a bundle's."""
    return F.when(_int(F.regexp_extract(_bare(key), _BUNDLE, 2)).isNotNull(), F.regexp_extract(_bare(key), _BUNDLE, 1)).otherwise("")


def slot_kind(path: Column) -> Column:
    """``blob`` for @blob/N, ``version`` for @N/path, else ``latest``."""
    return F.when(path.startswith("@blob/"), "blob").when(path.rlike("^@[^/]*/"), "version").otherwise("latest")


def slot_blob(path: Column) -> Column:
    return _int(F.regexp_extract(path, "^@blob/(.*)$", 1))


def slot_version(path: Column) -> Column:
    return _int(F.regexp_extract(path, "^@([^/]*)/", 1))


def slot_path(path: Column) -> Column:
    return F.when(slot_kind(path) == "version", F.regexp_extract(path, "^@[^/]*/(.*)$", 1)).otherwise(path)


def blob_number(name: Column) -> Column:
    """``blob/N`` to N, else 0."""
    return F.coalesce(_int(F.regexp_extract(name, r"^blob/([+-]?[0-9]+)$", 1)), F.lit(0))


def numbered_key(stem: Column, n: Column) -> Column:
    """Cache and fragment keys: ``stem+0001``."""
    return F.format_string("%s+%04d", stem, n)


def pair_tree(key: Column) -> Column:
    """The two folder levels of a key: ``abcdef`` lies in ``ab/cd/``; short keys have shorter paths."""
    n = F.length(key)
    return F.when(n == 0, "./").when(n <= 2, F.concat(key, F.lit("/"))).otherwise(F.concat(F.substring(key, 1, 2), F.lit("/"), F.substring(key, 3, 2), F.lit("/")))


def key_valid(key: Column) -> Column:
    """No slash, white space or control character, and sound UTF-8."""
    return F.is_valid_utf8(key) & ~key.rlike(r"(?U)[/\s\p{Cntrl}]")


def in_namespace(key: Column, prefix: str) -> Column:
    return key.startswith(prefix)


def strip_namespace(key: Column, prefix: str) -> Column:
    return F.substring(key, len(prefix) + 1, 1 << 30)


def upload_key(item: Column, md5_hex: Column) -> Column:
    return F.concat_ws("-", item, md5_hex)


def etag(blob: Column) -> Column:
    return F.format_string('"%d"', blob)


def slot_name(path: Column, parent: str = "") -> Column:
    """A slot's name for a local path: without ``parent``, or the base name if that is all there is; no leading slash."""
    base = F.element_at(F.split(path, "/"), -1)
    inner = F.when(path == parent, base).when(path.startswith(parent), F.substring(path, len(parent) + 1, 1 << 30)).otherwise(path)
    return F.regexp_replace(inner, "^/", "")
