"""Preference formatting: a shared prompt, rendered once, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: before its role, between role and text, after the text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _text_of(turn: Column) -> Column:
    """A turn's text, in which the template's own marks are broken up."""
    return F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(MIDDLE), _text_of(turn), F.lit(CLOSE))


def _mask(turns: Column, learned: str) -> Column:
    """``start-end`` in characters of the learned turns' texts and end marks, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        begin = acc["at"] + F.length(F.coalesce(turn["role"], F.lit(""))) + len(OPEN) + len(MIDDLE)
        end = begin + F.length(_text_of(turn)) + len(CLOSE)
        span = F.when(turn["role"] == learned, F.array(F.concat_ws("-", begin.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], span).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def format_preferences(turns: DataFrame, pairs: DataFrame, learned: str = "assistant") -> DataFrame:
    """One row for each row of ``pairs (pair_id, chosen_id, rejected_id)`` whose conversations both exist.

    The longest prefix of turns equal in role and text is the ``prompt``; what
    follows on either side is its completion, with the spans that count for
    the loss: texts of ``learned`` turns.  Without a common turn the prompt is
    empty; a conversation that is all prefix has an empty completion.

    Turns are ordered by turn, role and text, so ties have one order; null
    texts are empty, and equal to null only.  Turns with null conv_id belong to
    nothing.  Other columns are ignored.  Everything is built-in functions; a
    conversation, which the output holds whole, is what a task gathers.
    """
    turns = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", "role", "text").alias("turn"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    chosen, rejected = (whole.select(F.col("conv_id").alias(f"{side}_id"), F.col("turns").alias(f"{side}_turns")) for side in ("chosen", "rejected"))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(chosen, "chosen_id").join(rejected, "rejected_id")
    same = F.zip_with("chosen_turns", "rejected_turns", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    shorter = F.least(F.size("chosen_turns"), F.size("rejected_turns"))
    differs = F.array_position(same, F.lit(False)).cast("int")
    both = both.withColumn("prompt_turns", F.when(differs == 0, shorter).otherwise(F.least(shorter, differs - 1)))
    rest = {side: F.slice(f"{side}_turns", F.col("prompt_turns") + 1, F.size(f"{side}_turns")) for side in ("chosen", "rejected")}
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "prompt_turns",
        F.array_join(F.transform(F.slice("chosen_turns", F.lit(1), F.col("prompt_turns")), _rendered), "").alias("prompt"),
        *(F.array_join(F.transform(rest[side], _rendered), "").alias(side) for side in rest),
        *(_mask(rest[side], learned).alias(f"{side}_mask") for side in rest),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Conversations 2k and 2k+1 as pair k, the first chosen: for tables that name no preference themselves."""
    even = turns.where("conv_id % 2 = 0").select((F.col("conv_id") / 2).cast("long").alias("pair_id")).distinct()
    return even.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
