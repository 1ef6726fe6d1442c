"""Exact numbers of rows in an order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.folders import scratch


def number_rows(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Add ``name``: 1, 2, ... in the given order, a long.

    Rows are sorted by range and written with their place in their range; the
    counts of the ranges before it, one row a range, give a row its number."""
    spark = df.sparkSession
    path = scratch(spark, "numbered")
    df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_range", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_at", "_in", "_range", "_before")


def same_keys(left: DataFrame, right: str, keys: list[str]) -> Column:
    """Condition of an equi-join on equal or both null keys; the right side's keys are named ``right`` and their place."""
    out = F.lit(True)
    for k, name in enumerate(keys):
        out = out & left[name].eqNullSafe(F.col(f"{right}{k}"))
    return out


def number_within(df: DataFrame, name: str, group: list[str], *order: str | Column, total: str | None = None) -> DataFrame:
    """Add ``name``: 1, 2, ... in the given order within each group, a long, and ``total``, the rows of the group.

    Rows are numbered over all groups (``number_rows``) and the number before the
    group's first is taken off, so a group of any size is numbered by many tasks."""
    numbered = number_rows(df, "_all", *group, *order)
    firsts = numbered.groupBy(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]).agg(F.min("_all").alias("_first"), F.count("*").alias("_count"))
    out = numbered.join(firsts, same_keys(numbered, "_g", group)).withColumn(name, F.col("_all") - F.col("_first") + 1)
    if total is not None:
        out = out.withColumn(total, F.col("_count"))
    return out.drop("_all", "_first", "_count", *[f"_g{k}" for k in range(len(group))])


def number_within_small(df: DataFrame, name: str, group: list[str], *order: str | Column, most: int = 1_000_000) -> DataFrame:
    """The numbers of ``number_within`` where most groups are small: groups of at most ``most`` rows are numbered by a
    window, with one exchange by their key; larger ones by ranges of sorted rows."""
    path = scratch(df.sparkSession, "large")
    df.groupBy(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]).agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n").write.parquet(path)
    large = df.sparkSession.read.parquet(path)
    windowed = lambda rows: rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    if large.isEmpty():
        return windowed(df)
    pick = lambda how: df.join(large, same_keys(df, "_g", group), how)
    return windowed(pick("left_anti")).unionByName(number_within(pick("left_semi"), name, group, *order))
