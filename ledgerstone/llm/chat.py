"""Multi-party perspective rotation: each dialogue once from the side of each participant.

For every participant (distinct speaker other than ``system``) of a
conversation, each turn is rendered with that speaker as ``assistant``, other
speakers as users with their names, and system turns as they are. The mask is
true for turns to train on: those of the perspective's speaker. Turns stay
rows, with code point offsets in the dialogue, so a conversation of any length
is never gathered; ``rendered`` joined by position is the dialogue.

Null roles speak as ``unknown``; null texts count as empty; turns with equal or
null numbers (nulls first) go by role and text; repeated turns stay repeated;
null conv_ids form one conversation; conversations of system turns only have
no perspective; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm.shared import offsets, ordered

SYSTEM = "system"


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, rendered, trained, char_start, char_end."""
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    sides = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(sides, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    trained = F.col("speaker") == F.col("perspective")
    name = F.when(trained, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    seen = seen.withColumn("trained", trained).withColumn("rendered", F.concat(F.lit("<|"), name, F.lit("|>\n"), F.col("text"), F.lit("\n")))
    rows = ordered(seen, ["conv_id", "perspective", "turn", "speaker", "text"], "turns")
    size = F.length("rendered").cast("long")
    out = offsets(rows, ["conv_id", "perspective"], {"position": F.lit(1).cast("long"), "char_start": size})
    return out.select("conv_id", "perspective", "position", "turn", "speaker", "rendered", "trained", "char_start", (F.col("char_start") + size).alias("char_end"))
