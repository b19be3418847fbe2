"""Secret scans: all rules in one minimal automaton, one pass over the bytes of whole texts.

A forward automaton tells where matches of any rule may end; the same rules
reversed then give the leftmost start of each, and a rule's check (least
length, length of the value) drops matches that fail it. Matches of a rule
are leftmost and don't overlap; different rules may.

Null texts count as empty; empty texts and tables have no spans; repeated rows
are scanned each; further columns pass through (``scan_secrets``) whatever
their names, unless they are named as an output column, which is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm import arrow_text as at
from ledgerstone.llm.automaton import compile_rules, scan
from ledgerstone.llm.shared import other_columns


@dataclass(frozen=True)
class Rule:
    """pattern: for the automata. least: least length of the match or, with ``value``, of that group of it."""

    kind: str
    pattern: str
    least: int
    fold: bool = False
    value: str = ""


#: Fixed patterns. The first three are the base kinds, in this order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)"""
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
RULES = (
    Rule("assign", ASSIGN, 12, True, r"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)"""),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    # A key's first line with what follows of a body that may have no end, and the key up to its END line.
    Rule("pem", PEM + r"[A-Za-z0-9+/=\\\x0d\n]*", 1),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("cloud", r"AIza[A-Za-z0-9_\-]+", 39),
    Rule("key", PEM + r"(-{0,4}[^\-])*-----END [A-Z ]*PRIVATE KEY-----", 1),
)
BASE_KINDS = ("assign", "access", "hex")
PLACEHOLDER = "[secret]"


@lru_cache(4)
def _automata(rules: tuple[Rule, ...]):
    pairs = [(r.pattern, r.fold) for r in rules]
    return compile_rules(pairs), [compile_rules([p], search=False, flip=True) for p in pairs]


def find_spans(buf: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """Byte spans (start, end, rule) of each row that has any, by start and then rule."""
    forward, backward = _automata(rules)
    if not len(buf):
        return {}
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    classes = np.full(len(buf) + len(offsets), forward.classes - 1, np.uint8)
    place = np.arange(len(buf)) + rows  # one gap after each row
    classes[place] = forward.byte_class[buf]
    hit = forward.accepts[scan(forward, classes)][place]
    found: dict[int, list[tuple[int, int, int]]] = {}
    some = np.flatnonzero(hit)
    follows = np.zeros(len(hit) + 1, hit.dtype)
    follows[:-1] = hit
    follows[offsets[:-1]] = 0
    for k, rule in enumerate(rules):
        bit = np.uint32(1 << k)
        # A run of accepting bytes is one match that grows; its last byte ends the match.
        ends = some[(hit[some] & bit != 0) & (follows[some + 1] & bit == 0)]
        done: dict[int, int] = {}
        for e in ends.tolist():
            row = int(rows[e])
            low = max(done.get(row, 0), int(offsets[row]))
            start = _leftmost(backward[k], buf, low, e)
            if start is None:
                continue
            done[row] = e + 1
            size = e + 1 - start
            if rule.value:
                size = len(re.fullmatch(rule.value, buf[start : e + 1].tobytes().decode("ascii"))[1])
            if size >= rule.least:
                base = int(offsets[row])
                found.setdefault(row, []).append((start - base, e + 1 - base, k))
    for spans in found.values():
        spans.sort(key=lambda s: (s[0], s[2]))
    return found


def _leftmost(auto, buf: np.ndarray, low: int, end: int) -> int | None:
    """The least start of a match that ends with byte ``end``, not below ``low``."""
    table, accepts, best, state = auto.table, auto.accepts, None, 0
    dead = _dead(auto)
    for i in range(end, low - 1, -1):
        state = int(table[state * auto.classes + int(auto.byte_class[buf[i]])])
        if accepts[state]:
            best = i
        if state == dead:
            break
    return best


def _dead(auto) -> int:
    """The state that nothing leads out of, or -1."""
    moves = auto.table.reshape(-1, auto.classes)[:, :-1]
    stuck = np.flatnonzero((moves == np.arange(len(moves))[:, None]).all(1) & (auto.accepts == 0))
    return int(stuck[0]) if len(stuck) else -1


def to_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code point offsets."""
    if text.isascii():
        return spans
    before = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return [(int(before[a]), int(before[b]), k) for a, b, k in spans]


def redact(text: bytes, spans: list[tuple[int, int, int]]) -> str:
    """text with each group of overlapping spans replaced by the placeholder."""
    out, at_, i = [], 0, 0
    while i < len(spans):
        a, b, _ = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[at_:a], PLACEHOLDER.encode()]
        at_, i = b, i + 1
    return b"".join([*out, text[at_:]]).decode("utf-8", "replace")


def _batches(batches: Iterator[pa.RecordBatch], column: str, rules: tuple[Rule, ...], make) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = at.column_bytes(batch.column(column))
        spans: dict[int, list] = {}
        for lo, hi in at.slices(offsets):
            a, b = offsets[lo], offsets[hi]
            spans |= {lo + r: s for r, s in find_spans(buf[a:b], offsets[lo : hi + 1] - a, rules).items()}
        yield make(batch, lambda r, buf=buf, offsets=offsets: buf[offsets[r] : offsets[r + 1]].tobytes(), spans)


def scan_secrets(docs: DataFrame, column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The other columns of docs with n_<base kind> (long), base_sha256 and spans (``kind:start:end``, comma-joined)."""
    kept = other_columns(docs, [column, *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])
    empty = hashlib.sha256(b"").hexdigest()

    def make(batch, text, spans):
        n = batch.num_rows
        counts, digests, shown = [[0] * n for _ in BASE_KINDS], [empty] * n, [""] * n
        for r, found in spans.items():
            points = to_points(text(r), found)
            say = [f"{rules[k].kind}:{a}:{b}" for a, b, k in points]
            shown[r] = ",".join(say)
            digests[r] = hashlib.sha256(",".join(s for s, (_, _, k) in zip(say, points, strict=True) if rules[k].kind in BASE_KINDS).encode()).hexdigest()
            for j, kind in enumerate(BASE_KINDS):
                counts[j][r] = sum(rules[k].kind == kind for _, _, k in points)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(shown, pa.string())], [*kept, *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(0).cast("long").alias(f"n_{k}") for k in BASE_KINDS], F.lit("").alias("base_sha256"), F.lit("").alias("spans")).schema
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(column)).mapInArrow(lambda b: _batches(b, column, rules, make), schema)


def redact_secrets(docs: DataFrame, column: str = "text", length: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span in ``column`` replaced by a placeholder and ``length``, where there, set to the new code points of changed texts."""

    def make(batch, text, spans):
        out = batch.column(column).to_pylist()
        sizes = batch.column(length).to_pylist() if length in batch.schema.names else None
        for r, found in spans.items():
            out[r] = redact(text(r), found)
            if sizes:
                sizes[r] = len(out[r])
        cols = {c: batch.column(c) for c in batch.schema.names} | {column: pa.array(out, pa.string())}
        if sizes:
            cols[length] = pa.array(sizes, pa.int64())
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = docs.schema
    cast = docs.withColumn(length, F.col(length).cast("long")) if length in docs.columns else docs
    return cast.mapInArrow(lambda b: _batches(b, column, rules, make), cast.schema if length in docs.columns else schema)
