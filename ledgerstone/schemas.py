"""Explicit schemas of the catalog's tables and documents. Unset times are NULL."""

from pyspark.sql import types as T

_s, _i, _l, _t, _b = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType(), T.BinaryType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ITEMS = _struct(("item", _s), ("created", _t), ("modified", _t), ("size", _l), ("value", _s))
FIXITY = _struct(("id", _l), ("item", _s), ("scheduled_time", _t), ("status", _s), ("notes", _s))
BLOBS = _struct(("item", _s), ("blobid", _i), ("size", _l), ("bundle", _i), ("created", _t), ("creator", _s), ("md5", _b), ("sha256", _b), ("mimetype", _s), ("deleted", _t), ("deleter", _s), ("deletenote", _s))
VERSIONS = _struct(("item", _s), ("versionid", _i), ("created", _t), ("creator", _s), ("note", _s))
SLOTS = _struct(("item", _s), ("versionid", _i), ("blobid", _i), ("name", _s))
TABLES = {"items": ITEMS, "fixity": FIXITY, "blobs": BLOBS, "versions": VERSIONS, "slots": SLOTS}
ITEM_INFO = _struct(
    ("ItemID", _s), ("ByteCount", _l), ("MaxBundle", _i),
    ("Versions", T.ArrayType(_struct(("VersionID", _i), ("SaveDate", _t), ("Creator", _s), ("Note", _s), ("Slots", T.MapType(_s, _i))))),
    ("Blobs", T.ArrayType(_struct(("BlobID", _i), ("Bundle", _i), ("ByteCount", _l), ("MD5", _s), ("SHA256", _s), ("MimeType", _s), ("SaveDate", _t), ("Creator", _s), ("DeleteDate", _t), ("Deleter", _s), ("DeleteNote", _s)))),
)
ITEM_API = _struct(
    ("ID", _s), ("MaxBundle", _i),
    ("Blobs", T.ArrayType(_struct(("ID", _i), ("SaveDate", _t), ("Creator", _s), ("Bundle", _i), ("Size", _l), ("MD5", _s), ("SHA256", _s), ("MimeType", _s), ("DeleteDate", _t), ("Deleter", _s), ("DeleteNote", _s)))),
    ("Versions", T.ArrayType(_struct(("ID", _i), ("SaveDate", _t), ("Creator", _s), ("Note", _s), ("Slots", T.MapType(_s, _i))))),
)
TRANSACTION = _struct(("ID", _s), ("ItemID", _s), ("Status", _i), ("Creator", _s), ("Started", _t), ("Modified", _t), ("Commands", T.ArrayType(T.ArrayType(_s))), ("BlobMap", T.MapType(_s, _i)), ("Err", T.ArrayType(_s)))
FRAGMENTED_FILE = _struct(("ID", _s), ("Size", _l), ("Created", _t), ("Modified", _t), ("Creator", _s), ("MD5", _b), ("SHA256", _b), ("MimeType", _s), ("Extra", _s), ("Children", T.ArrayType(_struct(("ID", _s), ("Size", _l)))))
CACHE_INDEX = T.MapType(_s, _struct(("Key", _s), ("Size", _l), ("Expires", _t)))
BAG_ENTRY = _struct(("bundle", _s), ("name", _s), ("size", _l), ("content", _b))
FRAGMENT = _struct(("file", _s), ("seq", _i), ("size", _l), ("content", _b))
