"""SimHash near-dedup through a byte-position inverted index with count filtering.

Fingerprints of 64 bits are 8 positional bytes. Two that differ in at most 3
bits share at least 5 of them, so at least 3 within the first or the last four
positions: postings are kept for the 4 + 4 triples of positions there. Within
a posting list the shared positional bytes of each pair are tallied, pairs
with at least ``8 - DISTANCE`` stay, and their bits are compared. Lists of
over ``LIST_MOST`` fingerprints are dealt anew by two further bytes (a pair
has five in common), and a list that is still larger (at most 2^24, for
three bytes are free) is searched by flipping up to 3 bits of each entry.

Equal fingerprints are merged before the index, and a list gives a spanning
forest of its links, so that large groups never become all their pairs.

Null and empty texts have fingerprint zero and link like others; repeated
rows and exact copies share one entry; a null doc_id takes part but is never
a component's id unless the component has no other; an empty table gives an
empty result; further columns are ignored or, in ``drop_near_copies``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm import arrow_text as at
from ledgerstone.llm.components import connected_components
from ledgerstone.llm.shared import join_small, materialize, other_columns

SEED = 42
SHINGLE = 3
DISTANCE = 3
LIST_MOST = 2048
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``size`` words joined by one space; of the whole sequence if it is shorter."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return []
    line, ends, at_ = b" ".join(words), [], -1
    for w in words:
        at_ += len(w) + 1
        ends.append(at_)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    digest = xxhash.xxh64_intdigest
    starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """uint64: a bit is 1 if it is set in over half of a text's shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text), ">u8")
        if len(hashes):
            ones = np.zeros(64, np.int64)
            for lo in range(0, len(hashes), 1 << 16):
                ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out[i] = weights[2 * ones > len(hashes)].sum(dtype=np.uint64)
    return out


def with_fingerprint(docs: DataFrame, column: str = "text", name: str = "_fp", drop_text: bool = False) -> DataFrame:
    """docs with the fingerprint as a signed long."""
    kept = other_columns(docs, [name, column] if drop_text else [name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = at.column_bytes(batch.column(column))
            found = []
            for lo, hi in at.slices(offsets):
                raw, base = buf[offsets[lo] : offsets[hi]].tobytes(), int(offsets[lo])
                ends = (offsets[lo : hi + 1] - base).tolist()
                found.append(fingerprints([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]))
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(fp.view(np.int64))], [*kept, name])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias(name)).schema
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, column])]).mapInArrow(run, schema)


def _bytes(fp: Column, positions: tuple[int, ...]) -> Column:
    """The given bytes of a fingerprint, the others zero."""
    mask = sum(255 << 8 * (7 - p) for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node) that join the same nodes as the links (u, v)."""
    nodes, at_ = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at_[: len(u)], at_[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _verified(x: np.ndarray) -> np.ndarray:
    """Whether pairs with these XORs reach the guaranteed shared bytes and then the distance."""
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    out = tally >= 8 - DISTANCE
    out[out] = np.bitwise_count(x[out]) <= DISTANCE
    return out


def _list_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: each entry against those 1, 2, ... places on, run by run."""
    us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    live, step, held = np.arange(len(key) - 1), 1, 0
    while len(live):
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        a, b = fp[live], fp[live + step]
        ok = _verified(a ^ b)
        us.append(a[ok])
        vs.append(b[ok])
        held += int(ok.sum())
        if held > 1 << 20:  # fold what has been found, so that memory follows the entries
            u, v = _forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
        step += 1
    return _forest(np.concatenate(us), np.concatenate(vs))


def _flip_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one very long list, by looking up each entry with 1 to 3 bits flipped among its free bits."""
    fp = np.sort(fp)
    free = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [1 << i for i in range(64) if free >> i & 1]
    u, v = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for n in range(1, DISTANCE + 1):
        for some in combinations(bits, n):
            x = fp ^ np.uint64(sum(some))
            there = np.minimum(np.searchsorted(fp, x), len(fp) - 1)
            ok = (fp[there] == x) & (x > fp)
            if ok.any():
                u, v = _forest(np.concatenate([u, fp[ok]]), np.concatenate([v, x[ok]]))
    return u, v


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from postings (slot, key, fp) that come in order of slot and key."""

    def give(slot: np.ndarray, key: np.ndarray, fp: np.ndarray):
        run = np.cumsum(np.concatenate([[True], (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])])) if len(slot) else slot
        sizes = np.bincount(run) if len(run) else np.zeros(0, int)
        long = np.flatnonzero(sizes > 2 * LIST_MOST)
        usual = ~np.isin(run, long)
        for u, v in [_list_links(run[usual], fp[usual]), *[_flip_links(fp[run == r]) for r in long]]:
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        cols[2] = cols[2].astype(np.int64).view(np.uint64)
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        # The last list may go on in the next batch.
        whole = (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])
        yield from give(*[c[whole] for c in cols])
        rest = [c[~whole] for c in cols]
    if rest is not None:
        yield from give(*rest)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fp`` as all pairs within the distance do."""
    fp = F.col("fp")
    postings = prints.select("fp", F.posexplode(F.array(*[_bytes(fp, t) for t in TRIPLES])).alias("slot", "key"))
    large = postings.groupBy("slot", "key").count().where(F.col("count") > LIST_MOST).select("slot", "key", F.lit(True).alias("large"))
    dealt = join_small(postings, large, ["slot", "key"], "left")
    further = [F.array(*[_bytes(fp, (*t, *two)) for two in combinations([p for p in range(8) if p not in t], 2)]) for t in TRIPLES]
    fine = dealt.where("large").select("fp", "slot", F.posexplode(F.element_at(F.array(*further), F.col("slot") + 1)).alias("two", "key"))
    lists = dealt.where("large is null").select("slot", "key", "fp").union(fine.select((100 + 10 * F.col("slot") + F.col("two")).alias("slot"), "key", "fp"))
    return lists.repartition("slot", "key").sortWithinPartitions("slot", "key").mapInArrow(_search, "u long, v long")


def near_components(prints: DataFrame) -> DataFrame:
    """``fp``, ``root`` (least fingerprint reachable), ``component_id`` (least doc_id reachable) from rows (doc_id, fp)."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    roots = connected_components(fingerprint_links(classes.select("fp")))
    # Few fingerprints have a root of another: the rest stand for themselves.
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_copies(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs."""
    prints = materialize(with_fingerprint(docs.select("doc_id", column), column, "fp", drop_text=True), "fingerprints")
    out = prints.join(near_components(prints), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with one row of each component: that of its least doc_id, null only if it has no other (of rows equal in doc_id and fingerprint, any one)."""
    prints = materialize(with_fingerprint(docs.select("doc_id", column), column, "fp", drop_text=True), "fingerprints")
    kept = prints.join(near_components(prints), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Components may share their least doc_id or have none, so their root names them. Rows of one document
    # may have several texts: the component's row has the least fingerprint of them.
    kept = kept.groupBy("root").agg(F.min("doc_id").alias("_id"), F.min("fp").alias("_print")).drop("root")
    kept = materialize(kept, "kept")
    # An id that one row has names its row; only rows that share an id, or have none, need their fingerprint again.
    many = materialize(prints.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "repeated")
    single = kept.join(many, kept["_id"].eqNullSafe(many["doc_id"]), "left_anti").select("_id")
    out = docs.join(single, docs["doc_id"] == single["_id"], "left_semi")
    if not many.limit(1).count():
        return out
    packed = docs.select("doc_id", F.col(column).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    shared = packed.join(many.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    marked = with_fingerprint(shared, drop_text=True)
    match = marked["_fp"].eqNullSafe(kept["_print"]) & marked["doc_id"].eqNullSafe(kept["_id"])
    return out.unionByName(marked.join(kept, match, "left_semi").dropDuplicates(["doc_id", "_fp"]).select("_row.*"))
