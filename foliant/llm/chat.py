"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as
the assistant and all others as named users. A dialogue is the concatenation of one segment
for each turn, in the order of the turns:

    <|assistant|>\\n<text><|end|>\\n          the perspective's own turns
    <|user name=NAME|>\\n<text><|end|>\\n     all other turns

The loss mask covers the text and the end mark of the assistant's segments. A row is one
segment of one perspective, with its character offset in the dialogue and the span of its
mask, so a conversation of any length is never held in one place; :func:`dialogues` joins
the segments for conversations known to be short. Offsets are running sums; conversations
above ``group_limit`` rows are summed in parts.

Marks inside a text are taken apart by a blank after the first bracket, so that a text can not
forge a turn, and line breaks and bars in names become underscores.

Cases: a null role speaks as ``unknown``; a null text is empty; turns without a conversation
id form one conversation; null turn numbers come first; equal turn numbers go by role and
text, and repeated rows are repeated turns. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.ordered import Run, running

END = "<|end|>\n"
UNKNOWN = "unknown"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    return F.regexp_replace(role, r"[\r\n|<>]", "_")


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    group_limit: int = 1_000_000,
) -> DataFrame:
    """One row per (conversation, perspective, turn).

    Columns: the conversation and turn columns, perspective, speaker, is_target, segment,
    start, end, mask_start, mask_end. Spans are half open, in characters of the dialogue;
    the mask is empty at the end of the segment where the turn is not the assistant's.
    """
    said = turns.select(
        F.concat(F.when(F.col(conv_col).isNull(), F.lit("-")).otherwise(F.lit("c")), F.coalesce(F.col(conv_col).cast("string"), F.lit(""))).alias("_key"),
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col), F.lit(UNKNOWN)).alias("speaker"), _safe(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    seats = said.select("_key", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), _name(F.col("speaker")), F.lit("|>\n")))
    shown = said.join(seats, "_key").select(
        "_key", "_conv", "_turn", "perspective", "speaker", own.alias("is_target"), F.length(head).cast("long").alias("_head"),
        F.concat(head, F.col("_text"), F.lit(END)).alias("segment"))
    shown = shown.withColumn("_n", F.length("segment").cast("long"))
    placed = running(shown, ["_key", "perspective"], ["_turn", "speaker", "segment"], [Run("start", "sum", F.col("_n"), exclusive=True)], group_limit)
    end = F.col("start") + F.col("_n")
    return placed.select(
        F.col("_conv").alias(conv_col), F.col("_turn").alias(turn_col), "perspective", "speaker", "is_target", "segment", "start",
        end.alias("end"), F.when(F.col("is_target"), F.col("start") + F.col("_head")).otherwise(end).alias("mask_start"), end.alias("mask_end"))


def dialogues(segments: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Whole dialogues with the list of their mask spans, for conversations known to be short."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "segment", "is_target", "mask_start", "mask_end")))
    return segments.groupBy(conv_col, "perspective").agg(ordered.alias("s")).select(
        conv_col, "perspective", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("dialogue"),
        F.transform(F.filter("s", lambda x: x["is_target"]), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("mask"))
