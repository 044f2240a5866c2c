"""Preference formatting of conversations, in DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common turn prefix is rendered once, as
the prompt; what follows in either is rendered as a completion, with the spans of it that a trainer
masks: everything but the assistant's own turns. Turns of a conversation are gathered by its id; a
conversation must fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered, around its role and text.
TURN_START, ROLE_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _turn(x: Column) -> Column:
    return F.concat(F.lit(TURN_START), x["role"], F.lit(ROLE_END), x["text"], F.lit(TURN_END))


def _masks(turns: Column) -> Column:
    """For each turn: start and length in the rendered completion, and whether it is trained on (its
    header never is; its end mark is)."""
    head = lambda x: F.length(F.concat(F.lit(TURN_START), x["role"], F.lit(ROLE_END)))
    ends = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,trained:boolean>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(_turn(x))).alias("at"),
            F.concat(acc["out"], F.array(
                F.struct(acc["at"].alias("start"), head(x).alias("length"), F.lit(False).alias("trained")),
                F.struct((acc["at"] + head(x)).alias("start"), (F.length(_turn(x)) - head(x)).alias("length"), (x["role"] == TRAINED_ROLE).alias("trained")),
            )).alias("out"),
        ),
    )
    return ends["out"]


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and its turns in order, as an array of role and text.

    Null roles and texts are empty; turns that tie, or have no number (these come first), are ordered
    by role and text, and repeated turns stay. Rows without a conversation id are left out.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gathered = turns.filter(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def neighbours(convs: DataFrame) -> DataFrame:
    """Pairs by id: 2n is chosen and 2n + 1 rejected; a conversation without its partner is in a pair
    of its own. Every conversation is in one pair, and no group is larger than two."""
    pair = F.floor(F.col("conv_id").cast("long") / 2)
    of = lambda rest: F.max(F.when(F.pmod(F.col("conv_id").cast("long"), F.lit(2)) == rest, F.struct(F.col("conv_id").cast("long").alias("conv_id"), "turns")))
    return convs.groupBy(pair.alias("pair_id")).agg(of(0).alias("chosen"), of(1).alias("rejected"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """One row per pair: ids, prompt, completions and their masks.

    pairs: pair_id, chosen and rejected, each a struct of conv_id and turns. If one of them is null,
    the other one is all prompt up to its first trained turn, and its completion and mask stand alone.
    Equal conversations are all prompt, and both completions are empty.
    """
    a, b = F.col("chosen.turns"), F.col("rejected.turns")
    both = F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    only = F.coalesce(a, b)
    unequal = F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b)) + 1), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    first_trained = F.array_position(F.transform(only, lambda t: t["role"]), TRAINED_ROLE)
    shared = F.when(both, F.coalesce(F.get(unequal, F.lit(0)), F.least(F.size(a), F.size(b)) + 1) - 1).otherwise(F.when(first_trained > 0, first_trained - 1).otherwise(F.size(only))).cast("int")
    cut = pairs.withColumn("prompt_turns", shared)
    rest = lambda turns: F.when(turns.isNotNull(), F.slice(turns, F.col("prompt_turns") + 1, F.greatest(F.size(turns) - F.col("prompt_turns"), F.lit(0))))
    text = lambda turns: F.array_join(F.transform(turns, _turn), "")
    cut = cut.withColumn("chosen_rest", rest(a)).withColumn("rejected_rest", rest(b))
    return cut.select(
        "pair_id",
        F.col("chosen.conv_id").alias("chosen_id"),
        F.col("rejected.conv_id").alias("rejected_id"),
        "prompt_turns",
        text(F.slice(only, F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        text(F.col("chosen_rest")).alias("chosen"),
        text(F.col("rejected_rest")).alias("rejected"),
        _masks(F.col("chosen_rest")).alias("chosen_mask"),
        _masks(F.col("rejected_rest")).alias("rejected_mask"),
    )
