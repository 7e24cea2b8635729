"""Multi-party perspective rotation of dialogues (operator 6); DataFrame functions only.

For every participant the dialogue is rendered with that speaker as assistant and the others as named users.
A row is one rendered turn with its mask and its place in the rendered text, so a dialogue of any length
is never gathered in one row or task; joined in order of their start, the rows' texts are the rendered dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Speakers that are context for everyone and take no perspective.
CONTEXT = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns whose lengths are summed before the sums are: a dialogue's offsets aren't one task's running sum.
SPAN = 64


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Every turn of every dialogue from every participant's perspective.

    Returns conv_id, perspective, turn, as_role (assistant, user or system), name (of a user), rendered, start (characters of
    the rendered dialogue before it), mask_start, mask_end (characters of the rendered dialogue that are to be learned: an
    assistant's text with its end mark; equal where there is nothing to learn).

    A null speaker is the participant ``unknown``; a null text is empty; a null dialogue id is a dialogue of its own kind;
    null turns come first.  Turns with one number stand in the order of speaker and text, and turns that repeat
    all of these are rendered each.  Marks of turns inside texts and names lose their bars (``<im_end>``), so a text can't pose as a turn.  A dialogue that only context speakers take part in has no perspective and no rows; an empty
    table gives none.  Other columns aren't read.
    """
    who = F.coalesce(F.col(speaker), F.lit("unknown"))
    bare = lambda c: F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "<$1>")
    base = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), bare(who).alias("speaker"), bare(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    # Turns that repeat one another are told apart by a number, which their order doesn't depend on.
    base = base.groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("times"))
    base = base.select("conv_id", "turn", "speaker", "text", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    voices = base.filter(~F.col("speaker").isin(*CONTEXT)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seen = base.join(voices.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    role = F.when(F.col("speaker") == F.col("perspective"), "assistant").when(F.col("speaker").isin(*CONTEXT), F.col("speaker")).otherwise("user")
    seen = seen.select("*", role.alias("as_role"), F.when(role == "user", F.col("speaker")).alias("name"))
    head = F.concat(F.lit(OPEN), F.col("as_role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    seen = seen.select("*", head.alias("head"), F.concat(head, F.col("text"), F.lit(CLOSE)).alias("rendered"), F.floor(F.col("turn") / SPAN).alias("span"))
    # Running sums by span of turns first, then over the spans' sums.
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text"), F.col("copy")]
    inner = Window.partitionBy("conv_id", "perspective", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv_id", "perspective").orderBy(F.col("span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    spans = seen.groupBy("conv_id", "perspective", "span").agg(F.sum(F.length("rendered")).alias("size")).select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("span").alias("s"), F.coalesce(F.sum("size").over(outer), F.lit(0)).alias("before"))
    placed = seen.withColumn("within", F.coalesce(F.sum(F.length("rendered")).over(inner), F.lit(0)))
    placed = placed.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("span").eqNullSafe(F.col("s")))
    start = F.col("before") + F.col("within")
    learned = F.col("as_role") == "assistant"
    stop = start + F.length("rendered")
    return placed.select(
        "conv_id", "perspective", "turn", "as_role", "name", "rendered", start.cast("long").alias("start"),
        F.when(learned, start + F.length("head")).otherwise(stop).cast("long").alias("mask_start"), F.when(learned, stop - 1).otherwise(stop).cast("long").alias("mask_end"),
    )
