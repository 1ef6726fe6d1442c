"""Runs' usage, budgets and metadata."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of keys whose values are hidden.
SENSITIVE_KEYS = ("api_key", "apikey", "api_token", "access_token", "refresh_token", "auth_token", "authorization", "bearer_token", "secret", "password")
REDACTED = "<redacted>"


def run_summary(runs: DataFrame, messages: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows (run_id, duration, agents, n_steps, role_counts, stop_reason).

    ``runs``: (run_id, started, ended, stop_reason, limit_hit); ``steps``: (run_id, step, agent)."""
    role = F.lower(F.coalesce(F.nullif("role", F.lit("")), F.lit("user")))
    counts = messages.groupBy("run_id", role.alias("r")).agg(F.count("*").alias("n"))
    roles = counts.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "n")))).alias("role_counts"))
    done = steps.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "agent"))), lambda s: s.agent).alias("agents"))
    out = runs.join(done, "run_id", "left").join(roles, "run_id", "left")
    reason = F.coalesce(F.nullif("stop_reason", F.lit("")), F.when(F.col("limit_hit"), "token_limit_hit").otherwise("completed"))
    return out.select(
        "run_id", F.greatest(F.col("ended") - F.col("started"), F.lit(0)).alias("duration"), F.coalesce("agents", F.array().cast("array<string>")).alias("agents"),
        F.coalesce(F.size("agents"), F.lit(0)).alias("n_steps"), "role_counts", reason.alias("stop_reason"),
    )


def call_tokens(total: Column, prompt: Column, completion: Column) -> Column:
    """Tokens of a call: the total, else prompt and completion; not below 0."""
    return F.greatest(F.coalesce(total, F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))), F.lit(0))


def usage_totals(usage: DataFrame, by: str) -> DataFrame:
    """Calls and token counts by run or model."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return usage.groupBy(by).agg(F.count("*").alias("calls"), total("prompt_tokens"), total("completion_tokens"), total("total_tokens"))


def token_budget(calls: DataFrame, limit: int, run: str = "run_id", order: str = "seq", tokens: str = "tokens") -> DataFrame:
    """Add consumed, accepted and hit: calls are accepted until the first that would exceed the limit, which is not counted; 0 is no limit."""
    if limit <= 0:
        return calls.withColumns({"consumed": F.lit(0).cast("long"), "accepted": F.lit(True), "hit": F.lit(False)})
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(tokens).over(w)
    out = calls.withColumn("_s", running).withColumn("accepted", F.col("_s") <= limit)
    # tokens are not negative, so what is refused once stays above the limit
    whole = Window.partitionBy(run)
    return out.withColumn("consumed", F.coalesce(F.max(F.when(F.col("accepted"), F.col("_s"))).over(w), F.lit(0))).withColumn("hit", F.max(~F.col("accepted")).over(whole)).drop("_s")


def redact_map(m: Column) -> Column:
    """A flat map with the values of sensitive keys hidden."""
    return F.transform_values(m, lambda k, v: F.when(F.replace(F.lower(F.trim(k)), F.lit("-"), F.lit("_")).isin(*SENSITIVE_KEYS), F.lit(REDACTED)).otherwise(v))


def redact_json(c: Column) -> Column:
    """JSON text with the values of sensitive keys hidden at every depth; null for text that is no JSON."""
    def hide(x):
        if isinstance(x, dict):
            return {k: REDACTED if k.strip().lower().replace("-", "_") in SENSITIVE_KEYS else hide(v) for k, v in x.items()}
        return [hide(v) for v in x] if isinstance(x, list) else x

    def one(text: str) -> str | None:
        try:
            return json.dumps(hide(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return run(c)
