"""Preference formatting of chat conversations, with DataFrame functions alone.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as the prompt;
what follows in each becomes its completion. A completion's mask lists the character spans
``start-end`` that a model learns from: the text and end mark of the assistant's turns.

Turns are ordered by (turn, role, text); repeated turns stay. A null role counts as ``user``, a null text
as empty; rows without conversation id belong to no conversation and are left out. If one conversation
begins with the whole other, that one's completion is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the ChatML layout.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id_col, turns array<struct<turn, role, text>>``, one row a conversation."""
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return conversations.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def other_replies(convs: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Preference pairs of a table that has none: chosen and rejected conversations, both as ``turns`` gives them.

    A conversation up to its last assistant turn is chosen; rejected is the same with the last reply of the
    conversation with the next id in its place (an empty one if there is none). A conversation without an
    assistant's turn is on both sides as it is, so none is lost.
    """
    place = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    found = convs.select(F.col(id_col).cast("long").alias("c"), "turns", place.alias("k"))
    chosen = found.select("c", "k", F.when(F.col("k").isNull(), F.col("turns")).otherwise(F.slice("turns", F.lit(1), F.coalesce(F.col("k"), F.lit(0)) + 1)).alias("turns"))
    replies = found.where("k IS NOT NULL").select((F.col("c") - 1).alias("c"), F.get("turns", F.col("k"))["text"].alias("reply"))
    last = F.get("turns", F.col("k"))
    instead = F.array(F.struct(last["turn"].alias("turn"), last["role"].alias("role"), F.coalesce("reply", F.lit("")).alias("text")))
    rejected = chosen.join(replies, "c", "left").withColumn("turns", F.when(F.col("k").isNull(), F.col("turns")).otherwise(F.concat(F.slice("turns", F.lit(1), F.coalesce(F.col("k"), F.lit(0))), instead)))
    return tuple(x.select(F.col("c").alias(id_col), "turns") for x in (chosen, rejected))


def pair_neighbours(convs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``chosen_id, rejected_id``: conversations 2k and 2k+1, where a table stores the pairs one after the other.

    A conversation without its neighbour is in no pair. Other ways to pair give a table of the same form.
    """
    ids = convs.select(F.col(id_col).cast("long").alias("c"))
    pair = ids.groupBy(F.shiftright("c", 1).alias("p")).agg(F.min("c").alias("chosen_id"), F.max("c").alias("rejected_id"))
    return pair.where("chosen_id < rejected_id").drop("p")


def _render(xs: Column) -> Column:
    return F.array_join(F.transform(xs, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def _mask(xs: Column) -> Column:
    """Spans of the assistant's texts in what ``_render`` makes of the turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = acc["at"] + F.length(F.lit(BEGIN)) + F.length(t["role"]) + 1
        end = body + F.length(t["text"]) + len(END)
        own = F.when(t["role"] == "assistant", F.array(F.concat(body.cast("string"), F.lit("-"), (end - 1).cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(xs, start, step, lambda acc: F.array_join(acc["spans"], ","))


def preferences(convs: DataFrame, pairs: DataFrame, id_col: str = "conv_id", rejected: DataFrame | None = None) -> DataFrame:
    """``chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    ``convs`` is what ``turns`` returns, and so is ``rejected``, where the rejected conversations are in a table of their
    own; pairs that name no conversation are left out.
    """
    a = convs.select(F.col(id_col).cast("long").alias("chosen_id"), F.col("turns").alias("x"))
    b = (convs if rejected is None else rejected).select(F.col(id_col).cast("long").alias("rejected_id"), F.col("turns").alias("y"))
    both = pairs.join(a, "chosen_id").join(b, "rejected_id")
    same = F.zip_with("x", "y", lambda s, t: F.coalesce((s["role"] == t["role"]) & (s["text"] == t["text"]), F.lit(False)))
    n = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("long"))
    both = both.withColumn("n_common", n.cast("long"))
    rest = lambda c: F.slice(c, (F.col("n_common") + 1).cast("int"), F.size(c) + 1)
    return both.select(
        "chosen_id", "rejected_id", "n_common",
        _render(F.slice("x", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"),
        _render(rest("x")).alias("chosen"), _render(rest("y")).alias("rejected"),
        _mask(rest("x")).alias("chosen_mask"), _mask(rest("y")).alias("rejected_mask"),
    )
