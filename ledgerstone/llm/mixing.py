"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share the
corpus's words; a target stops at ``MOST_REPEATS`` times its source's words
and the excess is shared anew by weight. Blocks of equal words are apportioned
to the sources by highest quotients, and each source's blocks again to its
shards (hash cells of documents). After whole passes over a shard, the line of
its documents (in seeded order) is cut into at most ``RUNS`` equal runs of
blocks, and runs are drawn by a seeded hash until the shard's blocks are
taken, the last run in part. A document gives the parts that lie in drawn runs.

Null texts have no words and null sources form the last source; an empty
source has target 0; rows that repeat a doc_id within a source share one
entry and take in proportion to their sizes; empty tables give empty results;
further columns pass through ``mix_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerstone.llm.shared import join_small, materialize

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
#: Most words of a block, and least blocks of the smallest target among sources that aren't full (those give all they may).
BLOCK_WORDS = 2048
TARGET_BLOCKS = 1024
#: Words for each shard of a source, and most shards of one.
SHARD_WORDS = 1 << 17
MOST_SHARDS = 4096
#: Most runs of blocks into which a shard's line is cut; more runs cut more documents.
RUNS = 16
SEED = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def sainte_lague(df: DataFrame, group: list[str], key: list[str], value: str, seats: str, name: str) -> DataFrame:
    """df with ``name``: the seats that each row wins of its group's ``seats`` by highest quotients value / (2k + 1).

    Rounding at the common divisor gives nearly all seats; only the few that
    are over or missing are ranked by their quotients (ties by key). Rows of a
    group have distinct keys.
    """
    of = Window.partitionBy(*group)
    df = df.withColumn("_v", F.sum(value).over(of)).withColumn("_n", F.count("*").over(of))
    df = df.withColumn("_base", F.when(F.col("_v") > 0, F.floor(F.col(value).cast("double") * F.col(seats) / F.col("_v") + 0.5)).otherwise(0).cast("long"))
    df = df.withColumn("_more", F.when(F.col("_v") > 0, F.col(seats) - F.sum("_base").over(of)).otherwise(0).cast("long"))
    reach = F.ceil(F.col(value) / F.col("_v") * F.col("_n") / 2).cast("long") + 2
    tries = F.when((F.col("_more") == 0) | F.col("_v").isNull() | (F.col("_v") <= 0), F.lit(0).cast("long")).otherwise(reach)
    ranked = df.select(*group, *key, value, "_base", "_more", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(tries, F.lit(1).cast("long")))).alias("_k")).where("_more <> 0")
    at = F.when(F.col("_more") > 0, F.col("_base") + F.col("_k")).otherwise(F.col("_base") - F.col("_k") + 1)
    ranked = ranked.withColumn("_seat", at).where("_seat >= 1").withColumn("_q", F.col(value) / (2 * F.col("_seat") - 1))
    best = Window.partitionBy(*group).orderBy(F.when(F.col("_more") > 0, -F.col("_q")).otherwise(F.col("_q")), *key, "_k")
    won = ranked.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= F.abs("_more"))
    won = won.groupBy(*group, *key).agg(F.sum(F.signum("_more")).cast("long").alias("_extra"))
    out = df.join(won, [*group, *key], "left").withColumn(name, F.col("_base") + F.coalesce("_extra", F.lit(0)))
    return out.drop("_v", "_n", "_base", "_more", "_extra")


def targets(sizes: DataFrame) -> DataFrame:
    """source_size, target and blocks for each source (_null, _name) of rows with ``size``."""
    src = sizes.groupBy("_null", "_name").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("_null", "_name")
    all_ = Window.partitionBy()
    src = src.withColumn("_w", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("_total", F.sum("source_size").over(all_))
    src = src.withColumn("_cap", F.col("source_size") * MOST_REPEATS)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_null", "_name")
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("_level", level)
    # Sources in order of words a weight: the first that isn't full sets the level for it and all after it.
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("_level", F.first(F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.col("_level")), True).over(whole))
    src = src.withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_w") * F.col("_level"), F.col("_cap").cast("double"))))
    # Blocks are only counted, never laid out, so a small source may make them small for all.
    smallest = F.min(F.when((F.col("target") > 0) & (F.col("target") < F.col("_cap")), F.col("target"))).over(all_)
    block = F.coalesce(F.least(F.lit(BLOCK_WORDS), (smallest / TARGET_BLOCKS).cast("long")), F.lit(1))
    src = src.withColumn("_block", F.greatest(F.lit(1), block).cast("long"))
    src = src.withColumn("_all", F.round(F.col("_total") / F.col("_block")).cast("long"))
    src = sainte_lague(src, [], ["_null", "_name"], "target", "_all", "_blocks")
    shards = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("int")
    full = F.col("target") >= F.col("_cap")
    return src.select("_null", "_name", "source_size", "target", full.alias("_full"), "_block", "_blocks", shards.alias("_shards"))


def allocate(sizes: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """From written rows (doc_id, source, size): the sources, and passes and pieces for each (doc_id, source) entry.

    An entry gives its words ``passes`` times, then each piece: ``n`` of them from ``lead`` on.
    """
    keyed = sizes.select("doc_id", F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_name"), "size")
    entries = keyed.groupBy("doc_id", "_null", "_name").agg(F.sum("size").alias("_size"))
    sources = materialize(targets(keyed), "sources")
    name = ["_null", "_name"]
    entries = join_small(entries, sources.select(*name, "_shards"), name)
    entries = entries.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("_shards")).cast("int")).drop("_shards")
    cells = join_small(entries.groupBy(*name, "_shard").agg(F.sum("_size").alias("_words")), sources, name)
    cells = sainte_lague(cells, name, ["_shard"], "_words", "_blocks", "_quota")
    most = F.col("_words") * MOST_REPEATS
    words = F.when(F.col("_full"), most).otherwise(F.least(F.col("_quota") * F.col("_block"), most))
    cells = cells.withColumn("_take", words).withColumn("passes", F.when(F.col("_words") > 0, F.floor(F.col("_take") / F.col("_words"))).otherwise(0).cast("long"))
    rest = (F.col("_take") - F.col("passes") * F.col("_words")).alias("_rest")
    cells = cells.select(*name, "_shard", "_words", "passes", rest, _run_words().alias("_run"))
    cells = cells.withColumn("_drawn", _drawn(F.xxhash64(F.lit(seed + 1), *name, "_shard"))).drop("_words", "_rest")
    line = Window.partitionBy(*name, "_shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    lined = entries.withColumn("_at", F.coalesce(F.sum("_size").over(line), F.lit(0))).join(cells, [*name, "_shard"])
    lined = lined.withColumn("pieces", _pieces(F.col("_at"), F.col("_at") + F.col("_size")))
    return sources, lined.select("doc_id", *name, "_size", "passes", "pieces")


def _run_words() -> Column:
    """Words of a run of a shard's line: whole blocks, at most RUNS of them to the line."""
    blocks = F.ceil(F.col("_words") / F.col("_block"))
    return F.greatest(F.lit(1), F.ceil(blocks / RUNS) * F.col("_block")).cast("long")


def _drawn(seed: Column) -> Column:
    """The words that each run of a line gives, from its start: runs in order of a seeded hash until ``_rest`` words are drawn."""
    zero = F.lit(0).cast("long")
    last = F.greatest(zero, F.expr("(_words - 1) div _run"))
    numbers = F.sequence(zero, last)
    by_hash = F.transform(F.array_sort(F.transform(numbers, lambda i: F.struct(F.xxhash64(seed, i).alias("h"), i.alias("i")))), lambda s: s["i"])
    width = F.col("_words") - last * F.col("_run")

    def give(i: Column) -> Column:
        place = F.array_position(by_hash, i) - 1
        # All runs are of one width but the last of the line, which may have been drawn before.
        short = F.when(F.array_position(by_hash, last) - 1 < place, F.col("_run") - width).otherwise(zero)
        return F.greatest(zero, F.least(F.when(i == last, width).otherwise(F.col("_run")), F.col("_rest") - place * F.col("_run") + short))

    return F.transform(numbers, give)


def _pieces(lo: Column, hi: Column) -> Column:
    """(lead, n) of the parts of places lo to hi of a line that lie in drawn words, in order; parts that touch are one."""
    run, kind = F.col("_run"), "array<struct<lead:bigint,n:bigint>>"
    numbers = F.sequence(F.floor(lo / run).cast("long"), F.greatest(F.floor(lo / run), F.floor((hi - 1) / run)).cast("long"))

    def meet(i: Column) -> Column:
        start = F.greatest(lo, i * run)
        return F.struct((start - lo).alias("lead"), (F.least(hi, i * run + F.coalesce(F.get("_drawn", i.cast("int")), F.lit(0))) - start).alias("n"))

    def merge(done: Column, piece: Column) -> Column:
        end = F.get(done, F.size(done) - 1)
        joined = F.struct(end["lead"].alias("lead"), (end["n"] + piece["n"]).alias("n"))
        touch = F.coalesce(end["lead"] + end["n"] == piece["lead"], F.lit(False))
        head = F.when(touch, F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(done)
        return F.concat(head, F.array(F.when(touch, joined).otherwise(piece))).cast(kind)

    met = F.filter(F.transform(numbers, meet), lambda x: x["n"] > 0).cast(kind)
    return F.aggregate(met, F.array().cast(kind), merge)


def _taken(rows: DataFrame, sources: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (with size) joined with their source's figures, passes, and their share of their entry's pieces."""
    rows = rows.withColumn("_null", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    right = entries.select(F.col("doc_id").alias("_id"), F.col("_null").alias("_n"), F.col("_name").alias("_s"), "_size", "passes", "pieces")
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_null") == F.col("_n")) & (F.col("_name") == F.col("_s"))
    out = join_small(rows.join(right, match), sources.select("_null", "_name", "source_size", "target"), ["_null", "_name"])
    out = out.withColumn("_part", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    # Rows that share an entry give one piece each. In decimals: the product of two sizes may pass 2^63.
    share = F.floor(F.col("_part").cast("decimal(38,0)") * F.col("size") / F.greatest(F.col("_size"), F.lit(1))).cast("long")
    alone = F.col("_size") == F.col("size")
    lead = F.least(F.coalesce(F.get("pieces", F.lit(0))["lead"], F.lit(0)), F.col("size") - F.col("_part"))
    one = F.array(F.struct(lead.alias("lead"), F.col("_part").alias("n")))
    out = out.withColumn("_part", F.when(alone, F.col("_part")).otherwise(share))
    out = out.withColumn("_pieces", F.when(alone, F.col("pieces")).when(F.col("_part") > 0, one))
    return out.drop("_id", "_n", "_s", "_null", "_name", "pieces")


def mix(docs: DataFrame, column: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) for each row of docs."""
    sizes = materialize(docs.select("doc_id", "source", n_words(F.col(column)).alias("size")), "sizes")
    sources, entries = allocate(sizes, seed)
    out = _taken(sizes, sources, entries)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("_part")).alias("taken"))


def mix_documents(docs: DataFrame, column: str = "text", length: str = "n_chars", seed: int = SEED) -> DataFrame:
    """The mix itself: a document's row once for each whole pass over it, and once for each piece taken, its words joined by a space."""
    sizes = materialize(docs.select("doc_id", "source", n_words(F.col(column)).alias("size")), "sizes")
    sources, entries = allocate(sizes, seed)
    names = docs.columns
    packed = docs.select("doc_id", "source", n_words(F.col(column)).alias("size"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    out = _taken(packed, sources, entries)
    whole = F.struct(F.lit(0).cast("long").alias("lead"), F.col("size").alias("n"))
    given = F.concat(F.array_repeat(whole, F.col("passes").cast("int")), F.coalesce("_pieces", F.array().cast("array<struct<lead:bigint,n:bigint>>")))
    out = out.where("size > 0").select("_row", "size", F.explode(given).alias("_given"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("_row")[column], F.lit(f"({WORD})"), F.lit(1)), (F.col("_given.lead") + 1).cast("int"), F.col("_given.n").cast("int")), " ")
    short = F.col("_given.n") < F.col("size")
    out = out.withColumn("_text", F.when(short, cut).otherwise(F.col("_row")[column])).withColumn("_short", short)
    cols = []
    for c in names:
        one = F.col("_row")[c]
        if c == column:
            one = F.col("_text")
        elif c == length:
            one = F.when(F.col("_short"), F.length("_text").cast("long")).otherwise(one)
        cols.append(one.alias(c))
    return out.select(*cols)
