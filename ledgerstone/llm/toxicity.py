"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are authored lexicons, patterns, and words and stems that labelled rows
(never of the held-out remainder) show to go with toxic labels; each votes
toxic or abstains. The label model is fitted by expectation maximisation on the
votes of all documents, whose labels it does not see: how often each voter
speaks under both classes, how often the class occurs, and which voters speak
together beyond that, who share their weight. A linear classifier on hashed
words and word beginnings is trained on the posteriors of all documents, then
calibrated on labelled rows whose labels neither the voters nor it have seen.
Labels, lang, source and doc_id are no inputs.

Nothing is sampled: every usable label and every document counts. Executors
count; documents with the same votes, and then those with the same features of
the classifier, become one row with their number, and each step of a fit sums
over these rows. The driver holds vectors over voters and features only. Sums
are of whole numbers (``UNIT`` parts of 1), so that their order is no matter.

Null and empty texts score as texts without words; repeated rows are scored
each; equal scores are kept equal; a doc_id labelled 0 and 1 counts in both
classes; without labels of both classes the authored lexicons alone decide;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm import arrow_text as at
from ledgerstone.llm.linear import minimise, platt, sigmoid
from ledgerstone.llm.shared import join_small, materialize

BUCKETS = 1 << 19
#: Parts of 1 that sums are taken in, and of a gradient.
UNIT, FINE = 1 << 28, 1 << 24
#: Labels up to which their side of the join with texts is broadcast.
BROADCAST_LABELS = 1 << 21
STEMS = (4, 5, 6, 8)
THRESHOLD = 0.3
FOLDS, HELD = 4, 2
#: Labelled rows are dealt to so many folds; one calibrates, the others' rows give voters.
LABEL_FOLDS = 5
#: Least toxic rows of a mined voter, also as a part of them all, least ratio of its rates, and voters that are enough for one row.
LEAST_ROWS, LEAST_PART, LEAST_LIFT, ENOUGH = 5, 1 / 500, 10, 6
#: Least documents of a feature of the classifier, also as a part of the toxic ones, least log ratio of its rates, and least ratio of its counts.
LEAST_DOCS, LEAST_DOCS_PART, LEAST_LOG, LEAST_RATIO = 4, 1 / 2000, 1.5, 0.25
#: Authored lexicons, one voter each.
LEXICONS = (
    "idiot idiots moron morons imbecile fool stupid dumb dimwit halfwit",
    "loser losers pathetic worthless useless nobody failure",
    "scum trash filth vermin garbage parasite pig swine",
    "disgusting revolting vile repulsive nasty sickening",
    "clown jerk creep freak bastard hate kill die",
    "idiota imbecil tonto estupido basura asqueroso patetico",
    "idiot dumm dummkopf abschaum widerlich trottel versager",
    "idiote imbecile stupide ordure minable pauvre",
)
#: Authored patterns over a text's bytes, one voter each.
PATTERNS = tuple(
    re.compile(p)
    for p in (
        rb"(?i)\byou(?:'re| are)? (?:such )?an? [a-z]+[.!]",
        rb"(?i)\b(?:shut up|get lost|drop dead|go to hell|go away)\b",
        rb"(?i)\b(?:hate|despise) (?:you|them|him|her|these|those)\b",
        rb"(?i)\b(?:kill|hang|hurt) yourself\b",
        rb"(?:\b[A-Z]{3,}\b[^A-Za-z]{1,3}){5}",
        rb"\b[A-Za-z]+[*@#$]+[A-Za-z]+\b",
        rb"!{3}",
    )
)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and the row of each: every word without closing marks, and its first bytes at several lengths."""
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    # Words here are runs of letters: other marks are turned into spaces, byte by byte.
    starts, ends, first = at.word_bounds(np.where(letter, low, 32).astype(np.uint8), offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found, rows, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + at.SLICE_BYTES, "right")))
        a = starts[lo]
        prefix = at.prefix_hash(low[a : ends[hi - 1]] + np.uint64(1))
        s, e, r = starts[lo:hi] - a, ends[lo:hi] - a, row[lo:hi]
        found.append(at.span_hash(prefix, s, e))
        rows.append(r)
        for n in STEMS:
            long = e - s > n
            found.append(at.span_hash(prefix, s[long], s[long] + n) + np.uint64(n))
            rows.append(r[long])
        lo = hi
    return (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(rows)


def word_bucket(word: str) -> int:
    raw = word.encode()
    return int(buckets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][0])


def features(buf: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the distinct features of each row in order, a slice of rows at a time; of the wanted buckets only, if given."""
    for lo, hi in at.slices(offsets):
        a, b = offsets[lo], offsets[hi]
        index, row = buckets(buf[a:b], offsets[lo : hi + 1] - a)
        if wanted is not None:
            here = wanted[index]
            index, row = index[here], row[here]
        key = np.unique((row + lo) * BUCKETS + index)
        yield key // BUCKETS, key % BUCKETS


def margins(buf: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of each row's features."""
    z = np.zeros(len(offsets) - 1)
    for row, index in features(buf, offsets, weights != 0):
        z += np.bincount(row, weights[index], len(z))
    return z


def scores(buf: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    return sigmoid(model.slope * (model.bias + margins(buf, offsets, model.weights)) + model.offset)


@dataclass(frozen=True)
class Voters:
    """Lexicons, then patterns, then mined buckets."""

    groups: list[np.ndarray]
    mined: np.ndarray

    def __len__(self) -> int:
        return len(self.groups) + len(PATTERNS) + len(self.mined)

    def cast(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, voter) of all votes, by row, then voter."""
        buf, offsets = at.column_bytes(column)
        wanted, first, n = np.zeros(BUCKETS, bool), len(self.groups) + len(PATTERNS), len(offsets) - 1
        voter = np.full(BUCKETS, -1)
        voter[self.mined] = first + np.arange(len(self.mined))
        for some in (*self.groups, self.mined):
            wanted[some] = True
        rows, said = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, index in features(buf, offsets, wanted):
            for j, group in enumerate(self.groups):
                hit = row[np.isin(index, group)]
                rows.append(hit)
                said.append(np.full(len(hit), j))
            mine = voter[index] >= 0
            rows.append(row[mine])
            said.append(voter[index[mine]])
        for k, p in enumerate(PATTERNS):
            hit = np.flatnonzero(found(column, p))
            rows.append(hit)
            said.append(np.full(len(hit), len(self.groups) + k))
        key = np.unique(np.concatenate(rows) * max(1, len(self)) + np.concatenate(said)) if n else np.zeros(0, np.int64)
        return key // len(self), key % len(self)


def found(column: pa.Array, pattern: re.Pattern) -> np.ndarray:
    """Which rows' bytes hold a pattern: bytes as Latin-1, so that it means the same as to ``re``, in linear time."""
    raw = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    return pc.match_substring_regex(raw, pattern.pattern.decode()).to_numpy(zero_copy_only=False)


def lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values, in order of their rows, as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def unlisted(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all elements of lists."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False)), values


def bucket_counts(docs: DataFrame, column: str, weigh: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """bucket, pos, n: the sum of whole weights of the rows that have a feature, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            weight = weigh(batch)
            for row, index in features(*at.column_bytes(batch.column(column))):
                # A slice's sums are below 2^53, so they are exact.
                pos += np.bincount(index, weight[row], BUCKETS).astype(np.int64)
                n += np.bincount(index, minlength=BUCKETS)
        seen = np.flatnonzero(n)
        for lo in range(0, len(seen), 1 << 16):
            part = seen[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(pos[part]), pa.array(n[part])], ["bucket", "pos", "n"])

    return docs.mapInArrow(run, "bucket int, pos long, n long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def pair_counts(rows: DataFrame, size: int) -> DataFrame:
    """a, b, n: of rows (list, n), how many have both, for any two different elements, either way round, and for one with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, times = batch.column("list"), batch.column("n").to_numpy(zero_copy_only=False)
            for lo in range(0, len(held), 256):
                row, value = unlisted(held.slice(lo, 256))
                bounds = np.searchsorted(row, np.arange(min(256, len(held) - lo) + 1))
                sets = [value[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                key = np.concatenate([(v[:, None] * size + v).ravel() for v in sets])
                pair, place = np.unique(key, return_inverse=True)
                count = np.zeros(len(pair), np.int64)
                np.add.at(count, place, np.repeat(times[lo : lo + 256], [len(v) ** 2 for v in sets]))
                yield pa.RecordBatch.from_arrays([pa.array((pair // size).astype(np.int32)), pa.array((pair % size).astype(np.int32)), pa.array(count)], ["a", "b", "n"])

    return rows.select("list", "n").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def total(rows: DataFrame, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """Vectors of whole numbers that ``add`` fills from batches, summed over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for batch in batches:
            add(batch, out)
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.int64()))], ["sums"])

    got = rows.mapInArrow(run, "sums array<long>").toArrow().column("sums").combine_chunks()
    return np.asarray(got.flatten()).reshape(-1, size).sum(0)


def mine_voters(docs: DataFrame, known: DataFrame, column: str) -> np.ndarray:
    """Buckets that go with toxic rows of known (doc_id, label), best evidence first, until each such row has voters enough that are no others' echo."""
    rows = join_small(docs.select("doc_id", column), known, ["doc_id"], rows=BROADCAST_LABELS).select("label", column)
    counts = bucket_counts(rows, column, lambda b: b.column("label").to_numpy().astype(np.int64))
    n1, n0 = (known.where(F.col("label") == y).join(docs.select("doc_id"), "doc_id").count() for y in (1, 0))
    lift = (F.col("pos") + 0.1) / max(1, n1) / ((F.col("n") - F.col("pos") + 0.5) / max(1, n0))
    good = counts.where((F.col("pos") >= max(LEAST_ROWS, n1 * LEAST_PART)) & (lift >= LEAST_LIFT)).select("bucket", "pos", lift.alias("lift")).toArrow()
    bucket, pos, rate = (good.column(c).to_numpy() for c in ("bucket", "pos", "lift"))
    bucket = bucket[np.lexsort((bucket, -pos * np.log(rate)))].astype(np.int64)
    place = np.full(BUCKETS, -1)
    place[bucket] = np.arange(len(bucket))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, index in features(*at.column_bytes(batch.column(column)), place >= 0):
                some, who = np.unique(row, return_inverse=True)
                order = np.lexsort((place[index], who))
                yield pa.RecordBatch.from_arrays([lists(who[order], place[index][order], len(some))], ["list"])

    toxic = join_small(docs.select("doc_id", column), known.where("label = 1"), ["doc_id"], rows=BROADCAST_LABELS).select(column)
    return bucket[choose(materialize(toxic.mapInArrow(candidates, "list array<int>").groupBy("list").agg(F.count("*").alias("n")), "candidates"), len(bucket))]


def choose(rows: DataFrame, size: int, block: int = 32) -> np.ndarray:
    """Which of ``size`` candidates, in their order, still find rows enough with fewer than ``ENOUGH`` chosen ones.

    ``rows`` (list, n) says how many rows have which candidates. A block of
    candidates is decided by counts of rows alike to it: as many chosen so far,
    the same candidates of the block.
    """
    chosen = np.zeros(size, bool)
    for lo in range(0, size, block):

        def alike(batches: Iterator[pa.RecordBatch], lo: int = lo) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, value = unlisted(batch.column("list"))
                here, heard = (value >= lo) & (value < lo + block), np.bincount(row[chosen[value]], minlength=batch.num_rows)
                mask = np.zeros(batch.num_rows, np.int64)
                np.add.at(mask, row[here], np.int64(1) << (value[here] - lo))
                some = mask > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(heard, ENOUGH)[some]), pa.array(mask[some]), batch.column("n").filter(pa.array(some))], ["heard", "mask", "n"])

        got = rows.mapInArrow(alike, "heard long, mask long, n long").groupBy("heard", "mask").agg(F.sum("n").alias("n")).toArrow()
        heard, mask, n = (got.column(c).to_numpy().copy() for c in ("heard", "mask", "n"))
        for k in range(min(block, size - lo)):
            mine = mask >> k & 1 == 1
            if n[mine & (heard < ENOUGH)].sum() >= max(3, n[mine].sum() / 5):
                heard[mine] += 1
                chosen[lo + k] = True
    return chosen


@dataclass(frozen=True)
class LabelModel:
    """How likely each voter speaks under the toxic and the clean class, its share of the weight, and the class's prior."""

    p1: np.ndarray
    p0: np.ndarray
    share: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of the toxic class; a voter that abstains says nothing, for it may only know another language's insults."""
        return sigmoid(np.log(self.prior / (1 - self.prior)) + votes @ (np.log(self.p1 / self.p0) * self.share))

    def posterior_of(self, row: np.ndarray, voter: np.ndarray, n: int) -> np.ndarray:
        """The same for n rows by the places of their votes."""
        return sigmoid(np.log(self.prior / (1 - self.prior)) + np.bincount(row, (np.log(self.p1 / self.p0) * self.share)[voter], n))


def estimate(sums: Callable[[LabelModel | None], tuple], together: np.ndarray, prior: float, steps: int = 40, still: float = 1e-4) -> LabelModel:
    """Fitted by EM to votes without their labels, for a class that occurs as often as ``prior`` says.

    ``sums(model)`` gives the number of rows, the sums of their posteriors and of
    their squares, and for each voter the sum of posteriors where it spoke;
    ``together`` in how many rows two voters spoke. Without a model, rows with two
    voters or more are toxic. Voters vote for the toxic class, so they speak there
    twice as often at least. Halfway, or once nothing moves, the correlations of
    voters given the class are estimated; voters that speak together share the
    weight of one.
    """
    said = np.diag(together).astype(float)
    share, model = np.ones(len(said)), None
    for half in (0, 1):
        for step in range(steps // 2):
            n, post, square, mine = sums(model)
            p1 = np.clip((mine + 0.5) / (post + 1), 1e-4, 0.999)
            p0 = np.clip((said - mine + 0.05) / (n - post + 1), 1e-5, 0.45)
            p1 = np.maximum(p1, p0 * 2)
            if half and not step:
                a, c = np.outer(mine, p1), np.outer(said - mine, p0)
                mixed = np.outer(p1, p0)
                cov = together - a - a.T - c - c.T + square * np.outer(p1, p1) + (post - square) * (mixed + mixed.T) + (n - 2 * post + square) * np.outer(p0, p0)
                cov = cov / max(n, 1)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr = np.abs(cov / np.outer(sd, sd))
                np.fill_diagonal(corr, 0)
                share = 1 / np.sqrt(1 + np.where(corr > 0.2, corr, 0).sum(1))
            before, model = model, LabelModel(p1, p0, share, prior)
            if before is not None and step and max(np.abs(p1 - before.p1).max(), np.abs(p0 - before.p0).max()) < still:
                break
    return model


def first_guess(said: np.ndarray) -> np.ndarray:
    return np.where(said >= 2, 0.9, np.where(said > 0, 0.1, 0.01))


def label_model(votes: np.ndarray, prior: float, steps: int = 40) -> LabelModel:
    """``estimate`` for votes at hand (rows x voters, 0 or 1)."""

    def sums(model: LabelModel | None) -> tuple:
        post = first_guess(votes.sum(1)) if model is None else model.posterior(votes)
        return len(votes), post.sum(), (post * post).sum(), votes.T @ post

    return estimate(sums, votes.T @ votes, prior, steps)


def label_model_of(votes: DataFrame, voters: int, prior: float) -> tuple[LabelModel, int, float]:
    """``estimate`` for a table of votes (list, n); with the number of rows and the sum of their posteriors."""
    pairs = pair_counts(votes, voters).toArrow()
    together = np.zeros((voters, voters))
    together[pairs.column("a").to_numpy(), pairs.column("b").to_numpy()] = pairs.column("n").to_numpy()

    def sums(model: LabelModel | None) -> tuple:
        def add(batch: pa.RecordBatch, out: np.ndarray) -> None:
            row, voter = unlisted(batch.column("list"))
            n = batch.column("n").to_numpy(zero_copy_only=False)
            post = first_guess(np.bincount(row, minlength=len(n))) if model is None else model.posterior_of(row, voter, len(n))
            mine = np.rint(post * UNIT).astype(np.int64) * n
            out[0] += n.sum()
            out[1] += mine.sum()
            out[2] += (np.rint(post * post * UNIT).astype(np.int64) * n).sum()
            np.add.at(out, 3 + voter, mine[row])

        got = total(votes, 3 + voters, add)
        return int(got[0]), got[1] / UNIT, got[2] / UNIT, got[3:] / UNIT

    model = estimate(sums, together, prior)
    return model, *sums(model)[:2]


def vote(docs: DataFrame, voters: Voters, column: str) -> DataFrame:
    """list, n: how many rows of docs have which votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([lists(*voters.cast(batch.column(column)), batch.num_rows)], ["list"])

    return docs.select(column).mapInArrow(run, "list array<int>").groupBy("list").agg(F.count("*").alias("n"))


def posteriors(docs: DataFrame, voters: Voters, model: LabelModel, column: str, used: np.ndarray) -> DataFrame:
    """list, n, t, t2: how many rows of docs have which of the used buckets, by place, and the sums of their posteriors and of the squares."""
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            post = model.posterior_of(*voters.cast(batch.column(column)), batch.num_rows)
            parts = list(features(*at.column_bytes(batch.column(column)), place >= 0))
            row, index = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in (0, 1))
            both = [np.rint(p * UNIT).astype(np.int64) for p in (post, post * post)]
            yield pa.RecordBatch.from_arrays([lists(row, place[index], batch.num_rows), *map(pa.array, both)], ["list", "t", "t2"])

    rows = docs.select(column).mapInArrow(run, "list array<int>, t long, t2 long")
    return rows.groupBy("list").agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.sum("t2").alias("t2"))


def classify(rows: DataFrame, size: int, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression on a table of ``posteriors``, both classes weighing the same."""
    n, t = (int(x) for x in rows.agg(F.sum("n"), F.sum("t")).first())
    share = float(np.clip(t / UNIT / n, 1e-6, 1 - 1e-6))
    toxic, clean = 1 / share / 2, 1 / (1 - share) / 2

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def add(batch: pa.RecordBatch, out: np.ndarray) -> None:
            row, index = unlisted(batch.column("list"))
            count, t, t2 = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "t", "t2"))
            t, t2 = t / UNIT, t2 / UNIT
            z = theta[-1] + np.bincount(row, theta[index], len(count))
            # Over the rows of a group: the sums of their weights and of weight times target.
            weight, aim = toxic * t + clean * (count - t), toxic * t2 + clean * (t - t2)
            error = np.rint((weight * sigmoid(z) - aim) * FINE).astype(np.int64)
            np.add.at(out, index, error[row])
            out[size] += error.sum()
            out[size + 1] += np.rint((weight * np.logaddexp(0, z) - aim * z) * FINE).astype(np.int64).sum()

        got = total(rows, size + 2, add) / FINE / n
        w = np.append(theta[:-1], 0)
        return got[-1] + ridge / 2 * float(w @ w), got[:-1] + ridge * w

    theta = minimise(loss, size + 1)
    return theta[:-1], float(theta[-1])


def calibrate(docs: DataFrame, known: DataFrame, weights: np.ndarray, bias: float, column: str) -> tuple[float, float]:
    """Slope and offset by the rows of known (doc_id, label), counted by their sums to three digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.round((bias + margins(*at.column_bytes(batch.column(column)), weights)) * 1000)
            yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int64)), batch.column("label")], ["z", "label"])

    rows = join_small(docs.select("doc_id", column), known, ["doc_id"], rows=BROADCAST_LABELS).select("label", column)
    got = rows.mapInArrow(run, "z long, label int").groupBy("z", "label").count().orderBy("z", "label").toArrow()
    z, label, count = (got.column(c).to_numpy().astype(float) for c in ("z", "label", "count"))
    return platt(z / 1000, label, count=count)


def train(docs: DataFrame, labels: DataFrame, column: str = "text") -> Model:
    words = [np.unique([word_bucket(w) for w in group.split()]) for group in LEXICONS]
    usable = labels.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD).where("toxic in (0, 1)")
    known = usable.select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    if len(known.join(docs.select("doc_id"), "doc_id").select("label").distinct().collect()) < 2:
        weights = np.zeros(BUCKETS)
        weights[np.concatenate(words)] = 4.0
        return Model(weights, -3.0, 1.0, 0.0)
    counts = dict(map(tuple, usable.groupBy(F.col("toxic").cast("int")).count().collect()))
    prior = float(np.clip(counts.get(1, 0) / max(1, sum(counts.values())), 0.002, 0.5))
    held = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(LABEL_FOLDS)) == 0
    voters = Voters(words, mine_voters(docs, known.where(~held), column))
    model, n, post = label_model_of(materialize(vote(docs, voters, column), "votes"), len(voters), prior)
    # The classifier: features that the posterior separates.
    weigh = lambda b: np.rint(model.posterior_of(*voters.cast(b.column(column)), b.num_rows) * UNIT).astype(np.int64)
    pos, neg = F.col("pos") / UNIT, F.col("n") - F.col("pos") / UNIT
    apart = F.abs(F.log((pos + 0.3) / post / ((neg + 0.3) / (n - post)))) > LEAST_LOG
    enough = F.col("n") >= max(LEAST_DOCS, post * LEAST_DOCS_PART)
    used = np.sort(bucket_counts(docs.select(column), column, weigh).where(enough & apart & (pos > neg * LEAST_RATIO)).select("bucket").toArrow().column("bucket").to_numpy())
    w = np.zeros(BUCKETS)
    w[used], b = classify(materialize(posteriors(docs, voters, model, column, used), "posteriors"), len(used))
    slope, offset = calibrate(docs, known.where(held), w, b, column)
    return Model(w, b, max(slope, 1e-3), offset)


def score_toxicity(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = at.column_bytes(batch.column(column))
            score = scores(buf, offsets, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), column)
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
