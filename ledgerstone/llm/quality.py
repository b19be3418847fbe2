"""Quality rules: hashed word and character n-grams, a calibrated logistic regression, fixed thresholds.

The classifier is fitted on at most ``SAMPLE`` labelled rows, half of each
class where there are enough, chosen by a hash of doc_id. Their hashed
frequencies, at most ``2 * BUCKETS`` numbers a row, go to the driver; texts
don't. Scoring runs in Arrow batches over whole texts.

Null and empty texts have no words and fail the base rule; repeated rows are
scored each; a doc_id labelled 0 and 1 counts in both classes; ties at a threshold count as reached; without labels of both
classes nothing is rejected but by the base rule; an empty table gives an
empty result; further columns pass through unless named as an output, in whatever case.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm import arrow_text as at
from ledgerstone.llm.linear import Rows, fit, platt, sigmoid
from ledgerstone.llm.shared import other_columns

BUCKETS = 1 << 16
SAMPLE = 1500
#: Lengths of the n-grams, in words and in code points.
WORD_GRAMS = (1, 2, 3)
CHAR_GRAMS = (3, 5)
#: Sampled rows that a bucket must occur in to have a weight, folds of the calibration, steps of a fit.
LEAST_ROWS = 10
FOLDS = 2
STEPS = 80
#: A document is rejected if its probability of high quality is below this.
LEAST_GOOD = 0.25
MIN_WORDS = 50
#: Bytes that are measured and scored at a time.
STRIP = 1 << 18
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # words first, then character n-grams
    bias: float
    slope: float
    offset: float


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each code point as one number, and the offsets of the rows in code points."""
    lead = (buf & 0xC0) != 0x80
    at_ = np.flatnonzero(lead)
    points, follows = buf[at_].astype(np.uint32), np.ones(len(at_), bool)
    for j in range(1, 4):
        place = np.minimum(at_ + j, max(len(buf) - 1, 0))
        follows &= (at_ + j < len(buf)) & ~lead[place]
        points = np.where(follows, points << np.uint32(8) | buf[place], points)
    return points, np.searchsorted(at_, offsets)


def gram_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[list, list]:
    """(bucket, row) of all word n-grams, then of all character n-grams."""
    starts, ends, first = at.word_bounds(buf, offsets)
    rows = np.arange(len(offsets) - 1)
    row, hashes = np.repeat(rows, np.diff(first)), at.word_hashes(buf, starts, ends)
    words, chars = [], []
    for n in WORD_GRAMS:
        h = at.gram_hashes(hashes, n)
        inside = row[: len(h)] == row[n - 1 :]
        words.append(((h[inside] % np.uint64(BUCKETS)).astype(np.int64), row[: len(h)][inside]))
    points, bounds = code_points(buf, offsets)
    row = np.repeat(rows, np.diff(bounds))
    for n in CHAR_GRAMS:
        h = np.zeros(max(0, len(points) - n + 1), np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) ^ points[j : j + len(h)]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        inside = row[: len(h)] == row[n - 1 :]
        chars.append((h[inside] % np.uint32(BUCKETS), row[: len(h)][inside]))
    return words, chars


def scores(buf: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """The probability of high quality of each row."""
    n = len(offsets) - 1
    z = np.full(n, model.bias)
    for grams, weights in zip(gram_buckets(buf, offsets), (model.weights[:BUCKETS], model.weights[BUCKETS:]), strict=True):
        total, count = np.zeros(n), np.zeros(n)
        for bucket, row in grams:
            total += np.bincount(row, weights[bucket], n)
            count += np.bincount(row, minlength=n)
        z += total / np.maximum(count, 1)
    return sigmoid(model.slope * z + model.offset)


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows that occur twice or more among those of one text."""
    ids: dict[bytes, int] = {}
    row = [ids.setdefault(w, len(ids)) for w in words]
    windows = list(zip(*[row[j:] for j in range(width)], strict=False))
    seen = Counter(windows)
    total, done = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + width - max(done, i)
            done = i + width
    return total


def measures(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each row. Hashes of windows only say which rows may repeat one; their words are then compared."""
    n = len(offsets) - 1
    starts, ends, first = at.word_bounds(buf, offsets)
    out = {"n_words": np.diff(first)}
    points = np.concatenate([[0], np.cumsum(~at.SPACE[buf] & (buf & 0xC0 != 0x80))])
    out["word_chars"] = points[offsets[1:]] - points[offsets[:-1]]
    marks = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
    out["n_symbols"] = marks[offsets[1:]] - marks[offsets[:-1]]
    dup, raw, ends_ = np.zeros(n, np.int64), buf.tobytes(), offsets.tolist()
    for r in range(n):
        lines = [x for x in raw[ends_[r] : ends_[r + 1]].split(b"\n") if x and not x.isspace()]
        dup[r] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    row = np.repeat(np.arange(n), np.diff(first))
    grams = at.gram_hashes(at.word_hashes(buf, starts, ends), 3)
    repeat = np.zeros(n, np.int64)
    if len(grams):
        inside = np.flatnonzero(row[: len(grams)] == row[2:])
        order = inside[np.lexsort((grams[inside], row[inside]))]
        same = (grams[order[1:]] == grams[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        for r in np.unique(row[order[1:][same]]).tolist():
            repeat[r] = repeat_words(raw[ends_[r] : ends_[r + 1]].split())
    out["n_repeat_words"] = repeat
    return out


def _features(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Sparse relative frequencies of each row: words, and character n-grams, sum to 1 each."""
    for batch in batches:
        buf, offsets = at.column_bytes(batch.column(column))
        index, value = [], []
        for r in range(len(offsets) - 1):
            i, v = [], []
            for grams, shift in zip(gram_buckets(buf[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]])), (0, BUCKETS), strict=True):
                bucket = np.concatenate([b for b, _ in grams])
                found, n = np.unique(bucket, return_counts=True)
                i.append(found.astype(np.int64) + shift)
                v.append(n / max(1, n.sum()))
            index.append(np.concatenate(i).astype(np.int32))
            value.append(np.concatenate(v).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["label", "index", "value"])


def bounded_sample(labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """doc_id and label of at most ``most`` labelled rows, at most half of either class, by a hash of doc_id."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    half = [rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for y in (0, 1)]
    return half[0].unionByName(half[1])


def train(docs: DataFrame, labels: DataFrame, column: str = "text", label: str = "quality", most: int = SAMPLE) -> Model:
    chosen = bounded_sample(labels, label, most)
    rows = docs.select("doc_id", column).join(F.broadcast(chosen), "doc_id").select("label", "doc_id", column)
    got = rows.mapInArrow(lambda b: _features(b, column), "label int, index array<int>, value array<float>").toArrow()
    y = got.column("label").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(2 * BUCKETS), 0.0, 1.0, 10.0)
    lists = [got.column(c).combine_chunks() for c in ("index", "value")]
    bounds = np.asarray(lists[0].offsets).astype(np.int64)
    data = Rows(lists[0].values.to_numpy(), lists[1].values.to_numpy() * np.float32(100), bounds)
    # Rows arrive in any order: folds and sums follow their contents instead.
    order = np.lexsort((np.diff(data.bounds), data.dot(np.arange(2 * BUCKETS, dtype=float))))
    data, y = data.take(order), y[order]
    used = (np.bincount(data.index, minlength=2 * BUCKETS) >= LEAST_ROWS)[data.index]
    data = Rows(data.index[used], data.value[used], np.concatenate([[0], np.cumsum(used)])[data.bounds])
    # Every row is scored for the calibration by weights that were fitted without it.
    fold, z = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(FOLDS):
        w, b = fit(data.take(np.flatnonzero(fold != k)), y[fold != k], 2 * BUCKETS, steps=STEPS)
        z[fold == k] = data.take(np.flatnonzero(fold == k)).dot(w) + b
    slope, offset = platt(z, y)
    w, b = fit(data, y, 2 * BUCKETS, steps=STEPS)
    return Model(w * 100, float(b), max(slope, 1e-3), offset)


def assess(docs: DataFrame, model: Model, column: str = "text", least: float = LEAST_GOOD, keep_text: bool = False) -> DataFrame:
    """docs (without ``column`` unless asked for) with the measures, base_failed, p_good and kept."""
    new = [*MEASURES, "base_failed", "p_good", "kept"]
    names = other_columns(docs, new if keep_text else [*new, column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = at.column_bytes(batch.column(column))
            parts = []
            for lo, hi in at.slices(offsets, STRIP):
                a, b = offsets[lo], offsets[hi]
                m = measures(buf[a:b], offsets[lo : hi + 1] - a)
                m["p_good"] = scores(buf[a:b], offsets[lo : hi + 1] - a, model)
                parts.append(m)
            m = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (*MEASURES, "p_good")}
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            kept = ~failed & (m["p_good"] >= least)
            cols = [*[pa.array(m[k].astype(np.int64)) for k in MEASURES], pa.array(failed.astype(bool)), pa.array(m["p_good"].astype(float)), pa.array(kept.astype(bool))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *cols], [*names, *new])

    types = [*["long"] * len(MEASURES), "boolean", "double", "boolean"]
    schema = docs.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(t).alias(c) for c, t in zip(new, types, strict=True)]).schema
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, column])]).mapInArrow(run, schema)


def filter_quality(docs: DataFrame, labels: DataFrame, column: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns, whatever their names."""
    packed = docs.select(F.col(column).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return assess(packed, train(docs, labels, column)).where("kept").select("_row.*")
