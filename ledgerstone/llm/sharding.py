"""Sharding along a Hilbert curve; DataFrame functions only.

Each document's source, language and size are quantised to ``BITS`` bits:
sources and languages by the share of rows before them in code point order, so
that a cell, and a shard, holds names that lie side by side, and sizes on a
logarithmic scale. Rows are ordered by their index on the Hilbert curve through that cube (then
by a hash of the text, so equal texts with equal metadata lie side by side),
and the order is cut into runs of equal row counts: the ``rows`` law. A file
of one run spans small ranges in all three dimensions at once.

Null texts have no bytes (size 16, checksum 0); nulls in the dimensions take
cell 0; ties are broken by text hash and doc_id, and repeated rows
may fall on either side of a cut, which leaves the same rows; fewer rows than
shards leave shards empty; empty tables give empty results; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm.shared import join_small, materialize, offsets, ordered

SHARDS = 40
BITS = 5
ROW_BYTES = 16


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """The index on the Hilbert curve of a point with ``bits``-bit coordinates (Skilling's transposition)."""
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        own = F.element_at(x, step["i"] + 1)
        hit = own.bitwiseAND(step["q"]) != 0
        low = step["q"] - 1
        t = F.when(hit, low).otherwise(F.element_at(x, 1).bitwiseXOR(own).bitwiseAND(low))
        return F.transform(x, lambda v, j: F.when((j == 0) | ((j == step["i"]) & ~hit), v.bitwiseXOR(t)).otherwise(v))

    # On axis 0 the exchange is with itself: t is 0 there unless it hits.
    turned = F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), turn)
    grey = F.aggregate(F.sequence(F.lit(2), F.lit(n)), turned, lambda x, i: F.transform(x, lambda v, j: F.when(j == i - 1, v.bitwiseXOR(F.element_at(x, i - 1))).otherwise(v)))
    last = lambda x: F.element_at(x, n)
    flip = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.struct(F.lit(0).alias("t"), grey.alias("x")), lambda a, q: F.struct(F.when(last(a["x"]).bitwiseAND(q) != 0, a["t"].bitwiseXOR(q - 1)).otherwise(a["t"]).alias("t"), a["x"].alias("x")))
    final = F.transform(flip["x"], lambda v: v.bitwiseXOR(flip["t"]))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    packed = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("h"), final.alias("x")), lambda a, p: F.struct((a["h"] * 2 + F.when(F.element_at(a["x"], p["i"] + 1).bitwiseAND(F.call_function("shiftleft", F.lit(1), p["b"])) != 0, 1).otherwise(0)).alias("h"), a["x"].alias("x")))
    return packed["h"]


def name_cells(rows: DataFrame, axes: list[str], most: int, n: int) -> DataFrame:
    """(_axis, _name, _cell): cells 1 to ``most`` of each axis's names, by the rows (of n) whose names come before."""
    named = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_axis"), F.col(c).cast("string").alias("_name")) for c in axes])).alias("_a")).select("_a.*")
    counted = named.where("_name is not null").groupBy("_axis", "_name").agg(F.count("*").alias("_n"))
    before = offsets(ordered(counted, ["_axis", "_name"], "names"), ["_axis"], {"_before": F.col("_n")})
    return materialize(before.select("_axis", "_name", (F.expr(f"_before * {most} div {max(n, 1)}") + 1).cast("int").alias("_cell")), "cells")


def shard_documents(docs: DataFrame, column: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index ``hilbert`` of each row."""
    text = F.coalesce(F.col(column), F.lit(""))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    most = (1 << BITS) - 1
    # Written first: range partitioning reads its rows twice, and texts are to be read once.
    flat = docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_text"))
    flat = materialize(flat, "metadata")
    n = flat.count()
    names = name_cells(flat, ["source", "lang"], most, n)
    for c in ("source", "lang"):
        cells = names.where(F.col("_axis") == c).select(F.col("_name").alias(c), F.col("_cell").alias(f"_{c}"))
        flat = join_small(flat, cells, [c], "left")
    scale = F.least(F.lit(most), F.floor(F.log2(F.col("size").cast("double")) * 1.25).cast("int"))
    axes = [F.coalesce("_source", F.lit(0)), F.coalesce("_lang", F.lit(0)), scale]
    flat = flat.withColumn("hilbert", hilbert_index(axes)).drop("source", "lang", "_source", "_lang")
    rows = ordered(flat, ["hilbert", "_text", "doc_id"], "curve")
    ranked = offsets(rows, [], {"_rank": F.lit(1).cast("long")})
    shard = F.expr(f"_rank * {shards} div {max(n, 1)}")
    ranked = ranked.withColumn("shard", shard.cast("int"))
    start = F.expr(f"(shard * cast({n} as bigint) + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
