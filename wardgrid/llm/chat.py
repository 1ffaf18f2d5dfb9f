"""Chat formatting by perspective rotation: each participant in turn is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
#: Turns of one slice; offsets are summed per slice first, so that no task orders a whole long conversation.
SLICE_TURNS = 64


def rotate(conversations: DataFrame, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """One row per conversation, perspective and turn: the rendered segment, its place, and whether it is trained on.

    A perspective is a participant: a role of the conversation other than `system`; a null or empty role is the
    participant `unknown`. The perspective's own turns have role `assistant` and no name, system turns stay `system`,
    and all others are `user` with the speaker's role as name. A segment is
    `<|im_start|>role name=...\\ncontent<|im_end|>\\n`; `start` and `stop` are its code points in the conversation
    rendered for that perspective, and `mask_start` to `mask_stop` (content and end mark) is trained on if `trained`.
    A null text is an empty one; rows without conv_id belong to no conversation and give none; a null turn comes
    first. Turns with equal numbers, repeated rows included, all stay and are ordered by role, then text. A
    conversation of system turns alone has no participant and gives no rows. Other columns are ignored.
    """
    c = conversations.where("conv_id is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("content"))
    seats = c.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    role = F.when(system, SYSTEM).when(own, "assistant").otherwise("user")
    head = F.concat(F.lit("<|im_start|>"), F.col("role"),
                    F.when(F.col("name") == "", "").otherwise(F.concat(F.lit(" name="), F.col("name"))), F.lit("\n"))
    rows = (c.join(seats, "conv_id")
            .withColumn("role", role).withColumn("name", F.when(system | own, "").otherwise(F.col("speaker")))
            .withColumn("head", head)
            .withColumn("segment", F.concat("head", "content", F.lit("<|im_end|>\n")))
            .withColumn("slice", F.coalesce(F.floor(F.col("turn") / slice_turns), F.lit(-(2 ** 62)))))
    per_slice = (rows.groupBy("conv_id", "perspective", "slice")
                 .agg(F.sum(F.length("segment")).alias("chars"), F.count("*").alias("turns")))
    before = Window.partitionBy("conv_id", "perspective").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.select("conv_id", "perspective", "slice",
                                 F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("base"),
                                 F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("base_turns"))
    order = Window.partitionBy("conv_id", "perspective", "slice").orderBy("turn", "speaker", "content")
    stop = F.col("base") + F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (rows.join(per_slice, ["conv_id", "perspective", "slice"])
            .withColumn("stop", stop).withColumn("seq", F.col("base_turns") + F.row_number().over(order) - 1)
            .withColumn("start", F.col("stop") - F.length("segment"))
            .select("conv_id", "perspective", F.col("seq").cast("long").alias("seq"), "turn", "role", "name", "segment",
                    F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
                    (F.col("start") + F.length("head")).cast("long").alias("mask_start"),
                    (F.col("stop") - 1).cast("long").alias("mask_stop"), own.alias("trained")))
