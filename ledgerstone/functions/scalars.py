"""Other scalar functions: digests, sizes, times, roles, statuses, labels. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roles by rank, transaction statuses by number, fixity statuses, size units.
ROLES = {"unknown": 0, "mdonly": 1, "read": 2, "write": 3, "admin": 4}
TX_STATUS = ("Unknown", "Open", "Waiting", "Checking", "Ingest", "Finished", "Error")
TX_LABELS = tuple(f"Status{s}" for s in TX_STATUS)
FIXITY_STATUS = ("scheduled", "mismatch", "ok", "error")
SIZE_UNITS = (("Bytes", 1), ("KB", 1000), ("MB", 1000**2), ("GB", 1000**3), ("TB", 1000**4))
#: Fixed values of uploads: first part of a multi-part upload, and the largest.
FIRST_PART, LARGEST_PART = 64 << 20, 4 << 30


def digests(content: Column) -> tuple[Column, Column]:
    """MD5 and SHA-256 as lower-case hex."""
    return F.md5(content), F.sha2(content, 256)


def hash_matches(goal: Column, found: Column) -> Column:
    """An empty or missing goal matches anything."""
    return F.coalesce(F.length(goal), F.lit(0)).eqNullSafe(F.lit(0)) | goal.eqNullSafe(found)


def stream_verified(content: Column, md5_goal: Column, sha_goal: Column) -> Column:
    """Content against binary goals; without goals it is true."""
    return hash_matches(md5_goal, F.unhex(F.md5(content))) & hash_matches(sha_goal, F.unhex(F.sha2(content, 256)))


def from_hex(text: Column) -> Column:
    return F.coalesce(F.unhex(text), F.lit(b""))


def to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def from_base64(text: Column) -> Column:
    """NULL for malformed text."""
    return F.try_to_binary(text, F.lit("base64"))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def human_size(size: Column) -> Column:
    """Whole decimal units, cut off, TB at most."""
    out = F.when(size < 1000, F.concat(size.cast("string"), F.lit(" Bytes")))
    for name, unit in SIZE_UNITS[1:-1]:
        out = out.when(size < unit * 1000, F.concat(F.floor(size / unit).cast("string"), F.lit(f" {name}")))
    name, unit = SIZE_UNITS[-1]
    return out.otherwise(F.concat(F.floor(size / unit).cast("string"), F.lit(f" {name}")))


def parse_time(text: Column, default: Column) -> tuple[Column, Column]:
    """(time, valid): empty gives the default, ``*`` NULL; else RFC 3339 with a zone or YYYY-MM-DD."""
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(text))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    found = F.coalesce(full, day)
    return F.when(text == "", default).when(text == "*", F.lit(None).cast("timestamp")).otherwise(found), text.isin("", "*") | found.isNotNull()


def day_bounds(now: Column) -> tuple[Column, Column]:
    start = F.date_trunc("day", now)
    return start, start + F.expr("interval 24 hours")


def role_rank(name: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(ranks, F.lower(name)), F.lit(0))


def role_allows(rank: Column, least: str) -> Column:
    return rank >= ROLES[least]


def tx_status_label(n: Column) -> Column:
    names = F.array(*[F.lit(s) for s in TX_LABELS])
    return F.when((n >= 0) & (n < len(TX_LABELS)), F.get(names, n)).otherwise(F.format_string("Status(%d)", n))


def fixity_status_valid(status: Column) -> Column:
    return status.isin("", *FIXITY_STATUS)


def shown_date(text: Column) -> Column:
    return F.get(F.split(F.replace(text, F.lit("T"), F.lit(" ")), r"\."), F.lit(0))


def jittered(now: Column, key: Column, earliest_s: int, latest_s: int, seed: int = 0) -> Column:
    """A time between the two offsets after now, fixed by the key."""
    offset = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(latest_s - earliest_s)) + earliest_s
    return F.timestamp_seconds(F.unix_micros(now) / 1_000_000 + offset)


def cacheable(size: Column, most: Column) -> Column:
    return (most == 0) | (size < F.floor(most / 8))


def part_size(part: Column) -> Column:
    """The part of a multi-part upload from which on it is sent."""
    return F.when(part < 6, F.call_function("shiftleft", F.lit(FIRST_PART).cast("long"), part)).otherwise(F.lit(LARGEST_PART).cast("long"))


def action_label(kind: Column, name: Column, blob: Column) -> Column:
    return F.when(kind == "new", F.format_string("new blob %s", name)).when(kind == "mime", F.format_string("set mime %s", name)).when(kind == "relink", F.format_string("use blob %d for %s", blob, name)).otherwise(F.format_string("use local copy for %s", name))


def zero_based(n: Column) -> Column:
    return n - 1
