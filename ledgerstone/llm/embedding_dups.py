"""Embedding near-dedup by collision-counting projections.

Every distinct vector is projected on many seeded directions. A line holds all
vectors sorted by one projection, within cells cut by the signs of further
ones; a query's window is the stretch of its cell whose projections lie within
``WIDTH`` deviations of its own. A pair's count is the number of lines on which
the two meet in a window; pairs that reach the count calibrated for ``RECALL``
at the threshold cosine are verified in double precision. A pair is counted,
over all lines, on the first line where it meets, so that it is verified once.

Windows on bare lines hold about a third of all vectors at 64 dimensions and a
cosine of 0.95, whatever their number, so their collisions would grow with its
square. Cells keep them to about ``CELL`` vectors; lines are added as cells are
cut finer, so that the recall stays. A cell of any size is cut into blocks of
its sorted order, and blocks within a window of one another meet in a task of
their own, which gives link counts and a spanning forest of its links, never
all its pairs.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing; equal vectors are one entry with its multiplicity, so copies of
any number cost one; vectors of other lengths than the partner's don't link;
repeated vec_ids count as vectors each and get the same row values; empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, comb, erf, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm.components import connected_components
from ledgerstone.llm.shared import join_small, materialize, offsets, ordered
from ledgerstone.llm.simhash import _forest

COSINE = 0.95
RECALL = 0.999
#: Lines on which a candidate must meet at least.
LEAST = 2
#: Half-width of a window, in standard deviations of the difference of a pair at the threshold.
WIDTH = 1.9
#: Vectors of a cell, if they spread evenly, and rows of a block.
CELL = 32
BLOCK = 2048
SEED = 11
#: Steps of a unit vector's components and of a direction's.
UNIT, GRAIN = 1 << 15, 1 << 10
#: Candidate pairs that are counted at a time.
STRIP = 1 << 16


@dataclass(frozen=True)
class Lines:
    """How many lines, the sign bits of their cells, the half-width of their windows, and the calibrated count."""

    number: int
    bits: int
    width: float
    least: int
    seed: int

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the projection of each vector on each line, by one direction that sorts it and one for each sign.

        Vectors and directions are rounded to whole numbers, whose products
        and sums are exact in doubles, so every task places a vector alike.
        """
        across = np.rint(np.random.default_rng(self.seed).standard_normal((unit.shape[1], self.number * (1 + self.bits))) * GRAIN)
        all_ = (np.rint(unit * UNIT) @ across).reshape(len(unit), self.number, 1 + self.bits)
        cell = (all_[:, :, 1:] > 0) @ (1 << np.arange(self.bits, dtype=np.int64))
        return cell.astype(np.int32), (all_[:, :, 0] / GRAIN).astype(np.int32)

    @property
    def reach(self) -> int:
        """The half-width of a window in the projections' units."""
        return int(self.width * UNIT)


def calibrated(rows: int, cosine: float = COSINE, recall: float = RECALL, seed: int = SEED) -> Lines:
    """Lines for so many vectors: a pair at the threshold meets on ``LEAST`` of them with probability ``recall``.

    Two unit vectors fall on one side of a random direction with a probability
    given by their angle, and their projections differ by a normal variable
    with their distance as deviation, whatever the vectors.
    """
    bits = min(31, max(0, round(log2(max(rows, 1) / CELL))))
    meet = (1 - acos(cosine) / pi) ** bits * erf(WIDTH / sqrt(2))
    number = LEAST
    while sum(comb(number, k) * meet**k * (1 - meet) ** (number - k) for k in range(LEAST)) > 1 - recall:
        number += 1
    return Lines(number, bits, WIDTH * sqrt(max(0.0, 2 * (1 - cosine))), LEAST, seed)


def window_pairs(cell_x: np.ndarray, at_x: np.ndarray, cell_y: np.ndarray, at_y: np.ndarray, reach: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose rows share a cell and a window; both sides in order of cell and projection."""
    lo, hi = np.zeros(len(cell_x), np.int64), np.zeros(len(cell_x), np.int64)
    for c in np.intersect1d(cell_x, cell_y).tolist():
        a, b = np.searchsorted(cell_y, [c, c + 1])
        rows = slice(*np.searchsorted(cell_x, [c, c + 1]))
        lo[rows] = a + np.searchsorted(at_y[a:b], at_x[rows] - reach)
        hi[rows] = a + np.searchsorted(at_y[a:b], at_x[rows] + reach, "right")
    if same:
        lo = np.maximum(lo, np.arange(len(lo)) + 1)
    size = np.maximum(hi - lo, 0)
    upto = np.concatenate([[0], np.cumsum(size)])
    start = 0
    while start < len(size):  # rows together while their windows hold at most STRIP, or one row
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + STRIP, "right")) - 1)
        n = size[start:end]
        i = np.repeat(np.arange(start, end), n)
        if len(i):
            yield i, np.arange(len(i)) - np.repeat(upto[start:end] - upto[start], n) + np.repeat(lo[start:end], n)
        start = end


def counted(cells: np.ndarray, leads: np.ndarray, i: np.ndarray, j: np.ndarray, line: int, lines: Lines) -> np.ndarray:
    """Which pairs meet on ``line``, on no line before it, and on the calibrated number of lines in all."""
    tally, kept = np.zeros(len(i), np.int64), np.arange(len(i))
    for k in [line, *range(line), *range(line + 1, lines.number)]:
        a, b = i[kept], j[kept]
        meet = (cells[a, k] == cells[b, k]) & (np.abs(leads[a, k] - leads[b, k]) <= lines.reach)
        tally[kept] += meet
        if k <= line:  # the pair belongs to the first line on which it meets
            kept = kept[meet if k == line else ~meet]
    return kept[tally[kept] >= lines.least]


def _units(vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of the rows of each dimension."""
    dims = np.array([len(e) for e in vectors], np.int64)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        rows = np.stack([np.asarray(vectors[r], np.float64) for r in at])
        yield at, rows / np.linalg.norm(rows, axis=1)[:, None]


def _placed(batches: Iterator[pa.RecordBatch], lines: Lines) -> Iterator[pa.RecordBatch]:
    """rep and dims with each vector's cells and projections."""
    for batch in batches:
        cells, leads = np.zeros((batch.num_rows, lines.number), np.int32), np.zeros((batch.num_rows, lines.number), np.int32)
        for at, unit in _units(batch.column("e").to_numpy(zero_copy_only=False)):
            cells[at], leads[at] = lines.place(unit)
        lists = [pa.array(list(x), pa.list_(pa.int32())) for x in (cells, leads)]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("dims"), *lists], ["rep", "dims", "cells", "leads"])


def _pair(pdf: pd.DataFrame, cosine: float, lines: Lines) -> pd.DataFrame:
    """Link counts (node, n) and links (node, other) of one pair of blocks of one line."""
    pdf = pdf.sort_values(["side", "cell", "lead", "rep"])
    ((_, unit),) = _units(pdf["e"].to_numpy())
    line = int(pdf["line"].iloc[0])
    cells, leads = lines.place(unit)
    left = int((pdf["side"] == 0).sum())
    same = left == len(pdf)
    x, y = slice(0, left), slice(0, left) if same else slice(left, None)
    ids, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
    total = np.zeros(len(ids), np.int64)
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, j in window_pairs(cells[x, line], leads[x, line], cells[y, line], leads[y, line], lines.reach, same):
        j = j if same else j + left
        some = counted(cells, leads, i, j, line, lines)
        i, j = i[some], j[some]
        ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        i, j = i[ok], j[ok]
        np.add.at(total, i, copies[j])
        np.add.at(total, j, copies[i])
        u, v = np.concatenate([u, ids[i]]), np.concatenate([v, ids[j]])
        if len(u) > 1 << 18:
            u, v = _forest(u, v)
    u, v = _forest(u, v) if len(u) else (u, v)
    some = np.flatnonzero(total)
    counts = pd.DataFrame({"node": ids[some], "other": pd.array([None] * len(some), "Int64"), "n": total[some]})
    links = pd.DataFrame({"node": u, "other": pd.array(v, "Int64"), "n": np.zeros(len(u), np.int64)})
    return pd.concat([counts, links]) if len(some) or len(u) else counts


def _blocks(ranked: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their block: small cells whole, those of more than ``BLOCK`` rows cut by rank."""
    cells = ranked.groupBy(*on, "cell").agg(F.min("rank").alias("start"), F.count("*").alias("size"))
    place = F.when(F.col("size") > BLOCK, F.col("rank")).otherwise(F.col("start"))
    return ranked.join(cells, [*on, "cell"]).select(*on, "cell", "lead", "rep", F.floor(place / BLOCK).alias("block"))


def _block_pairs(blocks: DataFrame, on: list[str], reach: int) -> DataFrame:
    """Blocks of a line that hold rows of one cell within a window of one another."""
    point = F.struct("cell", "lead")
    bounds = blocks.groupBy(*on, "block").agg(F.min(point).alias("low"), F.max(point).alias("high"))
    # A cell in several blocks ends all of them but the last and begins all but the first.
    first = bounds.select(*on, F.col("block").alias("j"), F.col("low.cell").alias("cell"), F.col("low.lead").alias("next"))
    ends = bounds.select(*on, F.col("block").alias("i"), F.col("high.cell").alias("cell"), F.col("high.lead").alias("end"))
    met = ends.join(first, [*on, "cell"]).where((F.col("j") > F.col("i")) & (F.col("next") - F.col("end") <= reach))
    return met.select(*on, "i", "j").union(bounds.select(*on, "block", "block"))


def link_embeddings(vectors: DataFrame, cosine: float = COSINE, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    e = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False)) & ~F.coalesce(F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True)) & F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(sound, e).alias("e"))
    classes = rows.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.select("rep", "copies", "e", F.size("e").alias("dims")), "vectors")
    lines, on = calibrated(classes.count(), cosine, seed=seed), ["dims", "line"]
    # Only places are sorted and ranked; vectors join them when the blocks are known.
    placed = classes.mapInArrow(lambda b: _placed(b, lines), "rep long, dims int, cells array<int>, leads array<int>")
    places = placed.select("rep", "dims", F.posexplode(F.arrays_zip("cells", "leads")).alias("line", "at")).select(*on, F.col("at.cells").alias("cell"), F.col("at.leads").alias("lead"), "rep")
    ranked = offsets(ordered(materialize(places, "places"), [*on, "cell", "lead", "rep"], "lines"), on, {"rank": F.lit(1).cast("long")})
    blocks = materialize(_blocks(ranked, on), "blocks")
    pairs = materialize(_block_pairs(blocks, on, lines.reach), "pairs")
    sides = [(blocks.withColumnRenamed("block", "i"), pairs, "i", 0), (blocks.withColumnRenamed("block", "j"), pairs.where("i < j"), "j", 1)]
    members = [join_small(b, p, [*on, at]).select(*on, "i", "j", F.lit(side).alias("side"), "cell", "lead", "rep") for b, p, at, side in sides]
    members = members[0].union(members[1]).join(classes.select("rep", "copies", "e"), "rep")
    found = members.groupBy(*on, "i", "j").applyInPandas(lambda pdf: _pair(pdf, cosine, lines), "node long, other long, n long")
    found = materialize(found, "found")
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n")).select(F.col("node").alias("rep"), "n")
    roots = connected_components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("rep"), "root")
    known = classes.join(counts, "rep", "left").join(roots, "rep", "left")
    known = known.select("e", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.join(known, "e", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
