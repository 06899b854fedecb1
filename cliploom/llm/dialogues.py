"""Training texts from dialogues of several speakers, one for each speaker's point of view.

The recorder that this library follows keeps no dialogues, so the operator is general: it works on any
table of turns.

Method: perspective rotation.  For every participant the dialogue is written out with that participant as
the assistant and the others as users with their names; the mask covers what the participant says.  All
of it is SQL functions.  A dialogue is written in parts of ``part_turns`` turn numbers, so no dialogue is
gathered whole, however long; a part is an array of the turns that have its numbers.  Texts are shuffled once, by
dialogue and part; speakers meet the names of the parts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 512
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def rotate(turns: DataFrame, conversation_column: str = "conv_id", order_column: str = "turn", speaker_column: str = "role",
           text_column: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, speaker, part, n_turns, text, mask`` for each participant and part of a dialogue.

    A turn is written as ``<|im_start|>`` head, line end, text, ``<|im_end|>``, line end.  The head is
    ``assistant`` for the speaker whose point of view it is, ``system`` for system turns and ``user`` with
    ``name=`` for others.  ``mask`` holds (start, end) in code points of what the speaker says, with the
    closing mark, so a model learns to stop.  The texts of a dialogue's parts, in order, follow each other
    without a gap.  Part ``p`` has the turn numbers from ``p * part_turns`` on.

    System turns have no point of view of their own.  A null speaker is a user without a name and has no
    point of view; a null text is empty.  Turns of one number are in order of speaker and text, all of
    them kept; turns without a number come last, in a part of null number.  Dialogues of null id count as
    one.  A dialogue without participants has no rows.  A part grows with the turns that share a number, and the
    part of null number with all turns without one.  Marks and line ends inside a text or a name stay as they
    are, so whoever reads the result trusts its texts.  Other columns are not read.
    """
    order = F.col(order_column).cast("long")
    said = turns.select(
        F.col(conversation_column).alias("conv_id"), order.alias("turn"), F.col(speaker_column).cast("string").alias("by"),
        F.coalesce(F.col(text_column), F.lit("")).alias("said"), F.floor(order / part_turns).cast("long").alias("part"))
    # one struct holds dialogue and part: null keys match in the join, and grouping and join share a shuffle
    key = F.struct("conv_id", "part").alias("key")
    speakers = said.where(F.col("by").isNotNull() & (F.col("by") != SYSTEM)).select(
        F.struct("conv_id").alias("conv"), F.col("by").alias("speaker")).distinct()
    names = said.select(F.struct("conv_id").alias("conv"), key).distinct().join(speakers, "conv").select("key", "speaker")
    parts = said.select(key, "turn", "by", "said").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("turn", "by", "said"))).alias("turns"))
    views = parts.join(names, "key").select("key.*", "speaker", "turns")

    def head(by: Column) -> Column:
        return (
            F.when(by == F.col("speaker"), F.lit(f"{OPEN}assistant\n")).when(by == SYSTEM, F.lit(f"{OPEN}system\n"))
            .when(by.isNull(), F.lit(f"{OPEN}user\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), by, F.lit("\n"))))

    pieces = views.select(
        "conv_id", "speaker", "part",
        F.transform("turns", lambda t: F.struct(
            head(t["by"]).alias("head"), F.concat(t["said"], F.lit(CLOSE)).alias("body"),
            F.coalesce(t["by"] == F.col("speaker"), F.lit(False)).alias("own"))).alias("pieces"))
    # running places of the masked stretches
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["head"])
        end = start + F.char_length(p["body"])
        span = F.struct(start.alias("start"), (end - 1).alias("end"))  # without the line end
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id", "speaker", "part", F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("pieces", empty, add)["spans"].alias("mask"))
