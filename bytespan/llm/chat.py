"""Operator 9: chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as assistant, all others as named users, and a mask that is set on the
assistant's own segments.  One row per conversation, perspective and segment,
with the character range that the segment takes in the rendered dialogue, so
the dialogue is the segments put together in order; no conversation is ever
gathered into one row or task.  Ranges are prefix sums in two steps, within
runs of ``RUN`` turn numbers and over the runs, so a conversation that holds a
large part of all rows is dealt out over many tasks.

Only DataFrame functions.

Defined results: a null role is the speaker ``unknown``; turns of the role
``system`` are system segments in every perspective and no perspective of their
own; null text is empty; a null turn sorts before the first; repeated rows are
segments of their own, in the order turn, role, text (equal rows are alike, so
their order does not matter); rows with a null conv_id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = 256
SYSTEM = "system"


def perspectives(conversations: DataFrame) -> DataFrame:
    """-> conv_id, perspective, turn, speaker, segment, target, start, end."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    people = turns.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = (F.when(F.col("speaker") == SYSTEM, F.lit("<|im_start|>system\n")).when(own, F.lit("<|im_start|>assistant\n"))
            .otherwise(F.concat(F.lit("<|im_start|>user name="), F.col("speaker"), F.lit("\n"))))
    seg = (turns.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
           .select("conv_id", "perspective", "turn", "speaker", F.concat(head, "text", F.lit("<|im_end|>\n")).alias("segment"), own.alias("target"))
           .withColumn("n", F.length("segment").cast("long"))
           .withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-1 << 62))))
    keys = ["conv_id", "perspective"]
    total = seg.groupBy(*keys, "run").agg(F.sum("n").alias("total"))   # partial sums before the shuffle
    upto = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "run")], F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("before"))
    within = (Window.partitionBy(*keys, "run").orderBy(F.col("turn").asc_nulls_first(), "speaker", "segment")
              .rowsBetween(Window.unboundedPreceding, -1))
    out = seg.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("perspective") == F.col("_perspective")) & (F.col("run") == F.col("_run"))
    out = out.join(before, same)
    start = F.col("before") + F.col("at")
    return out.select("conv_id", "perspective", "turn", "speaker", "segment", "target", start.alias("start"), (start + F.col("n")).alias("end"))
