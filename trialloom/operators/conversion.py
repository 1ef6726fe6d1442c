"""Preference entries to prompts and pairs; trials to input messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.operators.messages import build_query_block, strip_last_agent
from trialloom.operators.preference import merge_pairs, rank_prompt


def convert_entries(messages: DataFrame, knowledge: DataFrame, comparison: DataFrame, extras: DataFrame | None = None, more_pairs: bool = False, agent_roles=("agent",)) -> tuple[DataFrame, DataFrame]:
    """(prompts, pairs) of entries: the history without its last agent message as query, each knowledge row as key.

    ``knowledge``: (run_id, pos from 0, text, tags, score); ``extras``: (run_id, place from 1, text), which
    follow with score 0.0; ``comparison``: (run_id, winner, loser) positions, those out of range go.
    With ``more_pairs`` all pairs of unequal scores join the given ones. Prompts are (run_id, pos,
    prompt, score), pairs (run_id, winner, loser, given); entries without knowledge have neither."""
    query = build_query_block(strip_last_agent(messages, agent_roles), agent_roles=agent_roles, training=True)
    rows = knowledge.select("run_id", F.col("pos").cast("int").alias("pos"), "text", "tags", F.col("score").cast("double").alias("score"))
    if extras is not None:
        counts = knowledge.groupBy("run_id").agg(F.count("*").alias("_n"))
        more = extras.join(counts, "run_id", "left").select("run_id", (F.coalesce("_n", F.lit(0)) + F.col("place") - 1).cast("int").alias("pos"), "text", F.lit(None).cast("array<string>").alias("tags"), F.lit(0.0).alias("score"))
        rows = rows.unionByName(more)
    prompts = rows.join(query, "run_id").select("run_id", "pos", rank_prompt(F.col("query"), F.col("text"), F.col("tags")).alias("prompt"), "score")
    scores = rows.select(F.col("run_id").alias("group"), F.col("pos").alias("idx"), "score")
    pairs = merge_pairs(comparison.select(F.col("run_id").alias("group"), "winner", "loser"), scores)
    pairs = pairs if more_pairs else pairs.where("given")
    return prompts, pairs.withColumnRenamed("group", "run_id")


def with_system_prompt(messages: DataFrame, prompts: DataFrame) -> DataFrame:
    """Messages (run_id, seq, role, content) of trials whose system prompt (run_id, system_prompt) replaces a leading system message or goes in front.

    Only the first message of a run decides; a message put in front has seq one below the first."""
    first = messages.groupBy("run_id").agg(F.min("seq").alias("_first"))
    out = messages.join(first, "run_id").join(prompts, "run_id", "left")
    leads = (F.col("seq") == F.col("_first")) & F.coalesce(F.lower("role") == "system", F.lit(False)) & F.col("system_prompt").isNotNull()
    changed = out.select("run_id", "seq", "role", F.when(leads, F.col("system_prompt")).otherwise(F.col("content")).alias("content"))
    front = out.where((F.col("seq") == F.col("_first")) & F.coalesce(F.lower("role") != "system", F.lit(True)) & F.col("system_prompt").isNotNull())
    return changed.unionByName(front.select("run_id", (F.col("seq") - 1).alias("seq"), F.lit("system").alias("role"), F.col("system_prompt").alias("content")))
