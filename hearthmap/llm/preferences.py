"""Preference pairs from a chosen and a rejected conversation.

The turns of both sides are compared one by one (role and text); the longest common prefix is rendered
once as the prompt, the rest of either side is its completion.  A completion's mask lists the character
spans to learn from: the contents of assistant turns.  The prompt is never learned from.

Turns are ordered by turn number, then role, then text; repeated turns are kept.  Turns without number
come first.  A null role is rendered as ``unknown``, a null text as empty; both compare equal to null
only.  Identical conversations give two empty completions and ``identical`` true; a pair with only one
side has an empty other side.  Turns without pair id or side are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEARNED_ROLE = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.coalesce(turn["text"], F.lit(""))


_TAIL = "\n<|end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit(_TAIL))), "")


def _mask(turns: Column) -> Column:
    """Spans (start, end) of learned contents in the rendering of ``turns``."""
    empty = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn))
        end = start + F.length(_body(turn))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        learned = F.coalesce(turn["role"] == LEARNED_ROLE, F.lit(False))
        return F.struct(
            (end + len(_TAIL)).alias("at"),
            F.when(learned, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(turns, empty, step, lambda state: state["spans"])


def format_pairs(turns: DataFrame) -> DataFrame:
    """From turns (pair_id, side 'chosen' or 'rejected', turn, role, text) to one row per pair:
    pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, identical.
    """
    sides = turns.where("pair_id is not null and side in ('chosen', 'rejected')")
    turn = F.struct("turn", "role", "text")
    # a group is one pair of conversations, which becomes one row
    pairs = sides.groupBy("pair_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("chosen", "rejected")]
    )
    shorter = F.least(F.size("chosen"), F.size("rejected"))

    def differs(i: Column) -> Column:
        a, b = F.get("chosen", i), F.get("rejected", i)
        return ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))

    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    common = F.coalesce(F.get(F.filter(places, differs), 0), shorter)
    rows = pairs.withColumn("n_prompt_turns", common.cast("long"))
    n = F.col("n_prompt_turns").cast("int")
    rest = {s: F.slice(s, n + 1, F.size(s)) for s in ("chosen", "rejected")}
    rows = rows.withColumns({"prefix": F.slice("chosen", F.lit(1), n), **{f"{s}_rest": r for s, r in rest.items()}})
    return rows.select(
        "pair_id",
        "n_prompt_turns",
        _render(F.col("prefix")).alias("prompt"),
        _render(F.col("chosen_rest")).alias("chosen"),
        _mask(F.col("chosen_rest")).alias("chosen_mask"),
        _render(F.col("rejected_rest")).alias("rejected"),
        _mask(F.col("rejected_rest")).alias("rejected_mask"),
        ((F.size("chosen_rest") == 0) & (F.size("rejected_rest") == 0)).alias("identical"),
    )


def swapped_endings(conversations: DataFrame) -> DataFrame:
    """Turns of preference pairs made from plain conversations (conv_id, turn, role, text).

    Chosen is every conversation.  Rejected is the same conversation up to its last answer, with the
    last answer of its neighbour (ids 2k and 2k + 1 are neighbours) in its place; a conversation whose
    neighbour has no answer is rejected without an answer.  Turns after the last answer belong to the
    chosen side only.  A conversation without an answer (an assistant turn with a number) is all prompt:
    both sides hold all its turns, so that its completions are empty.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    answers = turns.where((F.col("role") == LEARNED_ROLE) & F.col("turn").isNotNull())
    last = answers.groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.max_by("text", F.struct("turn", "text")).alias("answer")
    )
    neighbour = last.select(
        F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("answer").alias("other"), F.lit(True).alias("answered")
    )
    ended = last.join(neighbour, "conv_id", "left")
    held = turns.join(ended.select("conv_id", "last_turn"), "conv_id", "left")
    chosen = held.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    kept = held.where("turn is null or last_turn is null or turn < last_turn")
    kept = kept.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    swapped = ended.where("answered").select(
        F.col("conv_id").alias("pair_id"),
        F.lit("rejected").alias("side"),
        F.col("last_turn").alias("turn"),
        F.lit(LEARNED_ROLE).alias("role"),
        F.col("other").alias("text"),
    )
    return chosen.unionAll(kept).unionAll(swapped)
