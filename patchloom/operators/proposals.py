"""The boundary to a language model: prompts, replies, and attempts until one passes. Replies are replayed from a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .edits import EDIT, filled, in_region

REPLY = f"struct<edits:{EDIT},rationale:string>"


def reply(raw: Column) -> Column:
    """The proposal in a reply: the JSON in its first fence or else all of it; null where that isn't valid."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(raw), REPLY)


def chat(messages: DataFrame, conversation: str, turn: str) -> DataFrame:
    """conversation, prompt: system texts first, then turns as blocks, and an open last turn. messages has role and content."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", F.coalesce("content", F.lit("")).alias("content"))))
    system = F.array_join(F.transform(F.filter("m", lambda x: x["role"] == "system"), lambda x: x["content"]), "\n")
    blocks = F.array_join(F.transform(F.filter("m", lambda x: x["role"] != "system"), lambda x: F.concat(F.upper(x["role"]), F.lit(":\n"), x["content"])), "\n")
    prompt = F.array_join(F.filter(F.array(system, blocks), lambda x: x != ""), "\n")
    return messages.groupBy(conversation).agg(ordered.alias("m")).select(conversation, F.concat(prompt, F.lit("\nASSISTANT:")).alias("prompt"))


def accepted(attempts: DataFrame, case: str, most: int = 3, guard: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """case, attempt, edits, rationale, no_op: the first attempt up to `most` whose reply is valid and passes the guard.

    attempts: case, attempt (from 1), raw, allowed (ranges). Edits outside the
    ranges are dropped; an attempt without edits passes, and is marked no_op. The
    guard adds a boolean column passed.
    """
    read = attempts.where(F.col("attempt") <= most).withColumn("proposal", reply(F.col("raw"))).where("proposal.edits is not null")
    kept = read.withColumn("edits", in_region(F.col("proposal.edits"), F.col("allowed")))
    judged = guard(kept) if guard else kept.withColumn("passed", F.lit(True))
    first = F.row_number().over(Window.partitionBy(case).orderBy("attempt"))
    best = judged.where("passed").withColumn("_n", first).where("_n = 1")
    return best.select(case, "attempt", filled(F.col("edits")).alias("edits"), F.coalesce("proposal.rationale", F.lit("")).alias("rationale"), (F.size("edits") == 0).alias("no_op"))
