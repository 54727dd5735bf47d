"""Preference formatting: one prompt for what two conversations share, and a masked completion of each.

A pair has two conversations, `chosen` and `rejected`, as arrays of (role, text). Their longest common
prefix of whole turns is rendered once, as the prompt. The turns after it are rendered as
the two completions, with the spans (code points of the completion, end exclusive) that a loss may
see: the texts of assistant turns with their end marks. Everything else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import let

END = "<|end|>"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns, in the order of (turn, role, text); rows without conv_id belong to none."""
    each = turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
    return each.select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def stale_replies(turns: Column) -> Column:
    """A rejected form of a conversation: from its middle on, each assistant turn repeats the one before it (empty: none).

    The assistant's turns are taken out, shifted by one, and sorted in again, so the work is that of a sort of the turns.
    """

    def swap(found: Column) -> Column:
        numbered = F.transform(found, lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text")))
        mine = lambda t: F.coalesce(t["role"] == "assistant", F.lit(False))
        middle = F.floor(F.size(found) / 2)

        def shifted(talk: Column) -> Column:
            before = lambda j: F.when(j > 0, F.get(talk, j - 1)["text"]).otherwise(F.lit(""))
            return F.transform(talk, lambda t, j: F.struct(t["i"].alias("i"), t["role"].alias("role"), F.when(t["i"] >= middle, before(j)).otherwise(t["text"]).alias("text")))

        both = F.concat(F.filter(numbered, lambda t: ~mine(t)), let(F.filter(numbered, mine), shifted))
        return F.transform(F.array_sort(both), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    return let(turns, swap)


def common_turns(chosen: Column, rejected: Column) -> Column:
    """The number of turns that both begin with."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    return let(F.array_position(same, False), lambda at: F.when(at > 0, at - 1).otherwise(F.size(chosen))).cast("int")


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def body(turn: Column) -> Column:
    """The text, in which nothing can pass for a mark."""
    return F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t), F.lit(END + "\n"))), "")


def seen_spans(turns: Column) -> Column:
    """array<struct<start,end>> of what a loss may see in render(turns)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(header(t))
        end = begin + F.length(body(t)) + F.lit(len(END))
        out = F.when(t["role"] == "assistant", F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(a["out"])
        return F.struct((end + 1).alias("at"), out.alias("out"))

    return F.aggregate(turns, start, step, lambda a: a["out"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs (chosen, rejected: arrays of role and text; any other columns stay) with prompt_turns, prompt,
    chosen_completion, rejected_completion, chosen_spans and rejected_spans.

    A conversation is one row, before and after, however many turns it has; texts are rendered whole. A null or empty conversation has no turns. Null roles and texts are rendered empty and are equal
    to each other, not to empty ones. Equal conversations have empty completions. Repeated rows
    stay; columns named like the new ones are replaced; an empty table gives an empty result.
    """
    none = F.array().cast(TURNS)
    made = pairs.withColumns({c: F.coalesce(F.col(c).cast(TURNS), none) for c in ("chosen", "rejected")})
    made = made.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c), F.lit(0)))
    return made.withColumns(
        {
            "prompt": render(F.slice("chosen", F.lit(1), F.col("prompt_turns"))),
            **{f"{c}_completion": render(rest(c)) for c in ("chosen", "rejected")},
            **{f"{c}_spans": seen_spans(rest(c)) for c in ("chosen", "rejected")},
        }
    )


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
