"""Substring dedup by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words. Its anchor is the least hash among
its grams of ``GRAM`` words, so equal windows have equal anchors (winnowing).
Anchors that occur in several documents are kept with their least document,
which names the reference shard: all runs of windows whose anchors begin in
that document. Equal runs are merged, and shards of more than ``SHARD_WORDS``
words are dealt by anchors, or by single windows where one anchor has as
many. A suffix automaton of each shard, its
states marked with the least document in which they occur, then streams the
shard's runs: matching statistics of at least ``WINDOW`` words give the least
document of each window, and words under a window that begins in a document
with a smaller doc_id are removed. Hashes only route; words decide.

Instead of broadcasting every shard to all documents, which costs their
product, a document's runs are sent to the shards that can match them.

Null texts have no words; texts of fewer words than a window keep all; rows
with equal doc_ids never remove from each other; rows with a null doc_id keep
all and remove nothing; empty tables give empty results; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm import arrow_text as at
from ledgerstone.llm.shared import join_small, materialize

WINDOW = 13
GRAM = 5
#: Words of a shard's distinct runs beyond which it is dealt further, and of the runs that one automaton takes together.
SHARD_WORDS = 20_000
AUTOMATON_WORDS = 40_000


def window_anchors(buf: np.ndarray, offsets: np.ndarray):
    """Word starts, ends, first word of each row; windows (by first word) inside a row; anchor hash of each."""
    starts, ends, first = at.word_bounds(buf, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    span = WINDOW - GRAM + 1
    grams = at.gram_hashes(at.word_hashes(buf, starts, ends), GRAM)
    n = len(starts) - WINDOW + 1
    if n <= 0:
        return starts, ends, first, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = grams[:n].copy()
    for j in range(1, span):
        np.minimum(low, grams[j : j + n], out=low)
    inside = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    return starts, ends, first, inside, low[inside]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct anchors."""
    for batch in batches:
        buf, offsets = at.column_bytes(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, hi in at.slices(offsets):
            a, b = offsets[lo], offsets[hi]
            _, _, first, at_, low = window_anchors(buf[a:b], offsets[lo : hi + 1] - a)
            row = np.searchsorted(first, at_, "right") - 1
            if not len(row):
                continue
            order = np.lexsort((low, row))
            row, low = row[order], low[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (low[1:] != low[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64)), pa.array(ids[lo + row[new]].astype(np.int64))], ["h", "doc_id"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive windows with the same shard: lo, doc_id, the row's text hash, first windows, words, text.

    A row's equal runs are one, with the places of all of them.
    """
    for batch in batches:
        buf, offsets = at.column_bytes(batch.column("text"))
        ids, marks = (batch.column(c).to_pylist() for c in ("doc_id", "th"))
        hashes, shared = batch.column("hs"), batch.column("ids")
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for r in range(len(ids)):
            part = buf[offsets[r] : offsets[r + 1]]
            starts, ends, _, at_, low = window_anchors(part, np.array([0, len(part)]))
            if not len(at_):
                continue
            h = np.asarray(hashes[r].values).view(np.uint64)
            order = np.argsort(h)
            h, lo = h[order], np.asarray(shared[r].values)[order]
            place = np.minimum(np.searchsorted(h, low), len(h) - 1)
            shard = np.where(h[place] == low, lo[place], np.int64(-1) << 62)
            known = h[place] == low
            edge = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (known[1:] != known[:-1])]))
            raw, found = part.tobytes(), {}
            for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(at_)], strict=True):
                if known[x]:
                    words = [raw[a:b] for a, b in zip(starts[x : y + WINDOW - 1].tolist(), ends[x : y + WINDOW - 1].tolist(), strict=True)]
                    found.setdefault((int(shard[x]), len(words), b" ".join(words)), []).append(x)
            for (name, n, run), places in found.items():
                for column, v in zip(out, (name, ids[r], marks[r], places, n, run), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.int32()), pa.array([x.decode("utf-8", "surrogateescape") for x in out[5]], pa.string())], ["lo", "doc_id", "th", "starts", "n", "run"])


class Automaton:
    """A generalised suffix automaton over words; ``least``: the smallest document of each state's occurrences."""

    def __init__(self):
        self.step, self.link, self.size, self.least = [{}], [-1], [0], [1 << 62]

    def _state(self, size: int, step: dict, link: int, least: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.least.append(least)
        return len(self.size) - 1

    def add(self, words: list, doc: int) -> None:
        step, link, size, least, last = self.step, self.link, self.size, self.least, 0
        for w in words:
            to = step[last].get(w)
            if to is not None and size[to] == size[last] + 1:
                last = to
            else:
                one = None
                if to is None:
                    one = self._state(size[last] + 1, {}, 0, doc)
                p = last
                while p >= 0 and w not in step[p]:
                    step[p][w] = one
                    p = link[p]
                if p >= 0:
                    to = step[p][w]
                    if size[p] + 1 == size[to]:
                        target = to
                    else:
                        target = self._state(size[p] + 1, dict(step[to]), link[to], 1 << 62)
                        while p >= 0 and step[p].get(w) == to:
                            step[p][w] = target
                            p = link[p]
                        link[to] = target
                    if one is None:
                        one = target
                    else:
                        link[one] = target
                last = one
            if doc < least[last]:
                least[last] = doc

    def finish(self) -> None:
        """Hand the least documents down the suffix links, longest states first."""
        least, link = self.least, self.link
        for s in sorted(range(1, len(link)), key=self.size.__getitem__, reverse=True):
            p = link[s]
            if least[s] < least[p]:
                least[p] = least[s]

    def windows(self, words: list, width: int) -> list[int]:
        """The least document of each window: where the matching statistics reach ``width``."""
        step, link, size, least, state, length, out = self.step, self.link, self.size, self.least, 0, 0, []
        for i, w in enumerate(words):
            while state and w not in step[state]:
                state = link[state]
                length = size[state]
            state = step[state].get(w, 0)
            length = length + 1 if state else 0
            while length > width and size[link[state]] >= width:
                state = link[state]
                length = size[state]
            if i >= width - 1:
                out.append(least[state] if length >= width else 1 << 62)
        return out


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of (lo, sub), whole shards to an automaton: for each run the least document of each window."""

    def give(rows: list):
        auto, ids, split = Automaton(), {}, []
        for _, _, run, doc in rows:
            words = [ids.setdefault(w, len(ids)) for w in run.split(" ")]
            split.append(words)
            auto.add(words, doc)
        auto.finish()
        found = [auto.windows(words, WINDOW) for words in split]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array(found, pa.list_(pa.int64()))], ["lo", "run", "least"])

    held, words, last = [], 0, None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:2] != last and words >= AUTOMATON_WORDS:
                yield give(held)
                held, words = [], 0
            last = row[:2]
            held.append(row)
            words += row[2].count(" ") + 1
    if held:
        yield give(held)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words, n_removed and the hash of the kept words of each row."""
    for batch in batches:
        buf, offsets = at.column_bytes(batch.column("text"))
        spans = batch.column("spans")
        counts, gone, digests = [], [], []
        for lo, hi in at.slices(offsets):
            part = spans.slice(lo, hi - lo)
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(part)
            starts, hits = pc.struct_field(flat, "starts"), pc.struct_field(flat, "hit")
            times, each = (pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (starts, hits))
            begin = pc.list_flatten(starts).to_numpy(zero_copy_only=False).astype(np.int64)
            flags = pc.list_flatten(hits).to_numpy(zero_copy_only=False).astype(bool)
            # Every place of a span, with the span's flags.
            span = np.repeat(np.arange(len(each)), times)
            long = each[span]
            place = np.repeat(np.arange(len(span)), long)
            step = np.arange(len(place)) - (np.cumsum(long) - long)[place]
            hit = flags[(np.cumsum(each) - each)[span][place] + step]
            place, step = place[hit], step[hit]
            owner = np.repeat(np.arange(hi - lo), sizes)[span]
            base = offsets[lo]
            word, end, first = at.word_bounds(buf[base : offsets[hi]], offsets[lo : hi + 1] - base)
            drop = np.zeros(len(word) + 1, np.int64)
            where = first[owner[place]] + begin[place] + step
            np.add.at(drop, where, 1)
            np.add.at(drop, where + WINDOW, -1)
            cover = np.cumsum(drop)[:-1] > 0
            raw = buf[base : offsets[hi]].tobytes()
            word, end, kept = word.tolist(), end.tolist(), np.flatnonzero(~cover)
            edge, first = np.searchsorted(kept, first).tolist(), first.tolist()
            kept = kept.tolist()
            for r in range(hi - lo):
                counts.append(first[r + 1] - first[r])
                gone.append(counts[-1] - (edge[r + 1] - edge[r]))
                digests.append(hashlib.sha256(b" ".join([raw[word[i] : end[i]] for i in kept[edge[r] : edge[r + 1]]])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _split(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
    """Runs cut by the anchors of their windows or, with single, into their windows; sub: the anchor, or the window's hash."""
    names = ["lo", "doc_id", "th", "starts", "n", "run", "sub"]
    for batch in batches:
        buf, offsets = at.column_bytes(batch.column("run"))
        lo, doc, th = (batch.column(c).to_pylist() for c in names[:3])
        places = batch.column("starts")
        for a, b in at.slices(offsets):
            base = offsets[a]
            part = buf[base : offsets[b]]
            starts, ends, word, window, low = window_anchors(part, offsets[a : b + 1] - base)
            row = np.searchsorted(word, window, "right") - 1
            edge = np.concatenate([[True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])]) | single if len(low) else np.zeros(0, bool)
            x = np.flatnonzero(edge)
            y = np.append(x[1:], len(low))  # each piece: windows x to y
            raw, found = part.tobytes(), {}
            at_, sub, n = (window[x] - word[row[x]]).tolist(), low[x].view(np.int64).tolist(), (y - x + WINDOW - 1).tolist()
            for k, (i, j) in enumerate(zip(starts[window[x]].tolist(), ends[window[y - 1] + WINDOW - 1].tolist(), strict=True)):
                r, piece = a + int(row[x[k]]), raw[i:j]
                key = (lo[r], doc[r], th[r], n[k], piece, crc32(piece) if single else sub[k])
                found.setdefault(key, []).extend(s + at_[k] for s in places[r].as_py())
            cols = list(zip(*found, strict=True)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([*[pa.array(cols[i], pa.int64()) for i in range(3)], pa.array(list(found.values()), pa.list_(pa.int64())), pa.array(cols[3], pa.int32()), pa.array([p.decode("utf-8", "surrogateescape") for p in cols[4]], pa.string()), pa.array(cols[5], pa.int64())], names)


def _too_large(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose distinct runs have more words than a shard may."""
    merged = pieces.groupBy(*keys, "run").agg(F.first("n").alias("n"))
    return materialize(merged.groupBy(*keys).agg(F.sum("n").alias("words")).where(F.col("words") > SHARD_WORDS).select(*keys, F.lit(True).alias("large")), "large")


def _dealt(runs: DataFrame) -> DataFrame:
    """Runs with their part of the shard (sub), cut so that a part's distinct runs fit an automaton.

    A shard that is too long is dealt by the anchors of its windows, and an
    anchor that is still too long by the windows themselves: equal windows
    meet at either level, whatever surrounds them.
    """
    kind = "lo long, doc_id long, th long, starts array<long>, n int, run string, sub long"
    columns = ["lo", "doc_id", "th", "starts", "n", "run"]
    large = _too_large(runs, ["lo"])
    if not large.count():
        return runs.withColumn("sub", F.lit(0).cast("long"))
    marked = join_small(runs, large, ["lo"], "left")
    whole = marked.where("large is null").select(*columns, F.lit(0).cast("long").alias("sub"))
    cut = materialize(marked.where("large").select(*columns).mapInArrow(lambda b: _split(b, False), kind), "cut")
    large = _too_large(cut, ["lo", "sub"])
    if not large.count():
        return whole.union(cut)
    marked = join_small(cut, large, ["lo", "sub"], "left")
    single = marked.where("large").select(*columns).mapInArrow(lambda b: _split(b, True), kind)
    return whole.union(marked.where("large is null").select(*columns, "sub")).union(single)


def repeated_spans(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, th (xxhash64 of the text) and spans: array of (starts: first windows, hit: whether each window from there is to go)."""
    texts = docs.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text"))
    anchors = texts.mapInArrow(_anchors, "h long, doc_id long")
    shared = anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "lo")
    held = anchors.join(shared, "h").groupBy("doc_id").agg(F.collect_list("h").alias("hs"), F.collect_list("lo").alias("ids"))  # as long as one document
    runs = texts.withColumn("th", F.xxhash64("text")).join(held, "doc_id").mapInArrow(_runs, "lo long, doc_id long, th long, starts array<long>, n int, run string")
    runs = materialize(runs, "runs")
    pieces = _dealt(runs)
    distinct = pieces.groupBy("lo", "sub", "run").agg(F.min("doc_id").alias("first"))
    least = distinct.repartition("lo", "sub").sortWithinPartitions("lo", "sub").select("lo", "sub", "run", "first").mapInArrow(_match, "lo long, run string, least array<long>")
    name = F.unhex(F.sha2("run", 256)).alias("name")  # a run's words, 32 bytes long
    least = least.select("lo", name, "least")
    found = pieces.select("lo", name, "doc_id", "th", "starts").join(least, ["lo", "name"])
    hits = found.select("doc_id", "th", F.struct("starts", F.transform("least", lambda m: m < F.col("doc_id")).alias("hit")).alias("span")).where(F.exists("span.hit", lambda x: x))
    return hits.groupBy("doc_id", "th").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    spans = repeated_spans(docs, column).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text"))
    rows = rows.join(spans, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string")
