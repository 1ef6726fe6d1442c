"""Sums over the rows before a row, and digests of ordered rows, without a group in one task's memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.llm.common import Scratch


def sums_before(df: DataFrame, scratch: Scratch, group: str, order: list[str | Column], sums: dict[str, str | int], mapped: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Add long columns: each name of ``sums`` is the sum of its column (or of a
    number) over the rows of the same group that come earlier in ``order``.

    Rows are sorted by range of (group, order), so a large group lies in many
    tasks; each task writes its rows with the sums inside the task. A group that
    crosses tasks gets the totals of the tasks before, at most two rows a task
    in all. ``mapped`` is a map of sorted rows, in their order, that may make the
    summed columns. Nulls sort first; a null group is a group. Rows equal in group and
    order should be equal in all columns, or either may come first.
    """
    names = list(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros(len(names), np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.concat_arrays([last, batch.column(batch.schema.get_field_index(group))]) if last is not None else batch.column(batch.schema.get_field_index(group))
            codes = keys.dictionary_encode("encode").indices.to_numpy()
            n = batch.num_rows
            fresh = np.ones(n, bool)
            fresh[len(fresh) - (len(codes) - 1) :] = codes[1:] != codes[:-1]
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            first = np.cumsum(fresh) == 0  # rows of the group that the batch before ended with
            out = []
            for k, name in enumerate(names):
                w = sums[name]
                w = np.full(n, w, np.int64) if isinstance(w, int) else batch.column(batch.schema.get_field_index(w)).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(w) - w
                before = upto - upto[start] + np.where(first, carried[k], 0)
                carried[k] = before[-1] + w[-1]
                out.append(pa.array(before))
            last = keys.slice(len(keys) - 1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), *out], names=[*batch.schema.names, "_range", *names])

    df = mapped(df.orderBy(group, *order))
    placed = scratch.table(df.mapInArrow(run, _ddl(df, {"_range": "int"} | {n: "bigint" for n in names})), "ordered")
    ends = placed.groupBy("_range", F.col(group).alias("_group")).agg(*[(F.count("*") * w if isinstance(w, int) else F.sum(w)).alias(f"_{n}") for n, w in sums.items()])
    ends = scratch.table(ends, "ends")
    crossing = ends.groupBy("_group").agg(F.count("*").alias("_tasks")).where("_tasks > 1").select(F.col("_group").alias("_crossing"))
    ends = ends.join(F.broadcast(crossing), F.col("_group").eqNullSafe(F.col("_crossing")), "left_semi")  # at most two rows a task
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = scratch.table(ends.select("_group", F.col("_range").alias("_task"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in names]), "shift")
    joined = placed.join(F.broadcast(shift), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_task")), "left")
    return joined.select(*df.columns, *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names])


def _ddl(df: DataFrame, more: dict[str, str]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, *more.items()])


def fold_groups(df: DataFrame, group: str, order: list[str], schema: str, start: Callable, step: Callable, end: Callable) -> DataFrame:
    """One row a group from a pass over its rows in order.

    ``start()`` gives a state, ``step(state, row)`` takes a dict of the row's
    columns, ``end(group, state)`` gives the result's dict. A task streams over
    its sorted rows and holds one state, so a group may be larger than memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, held, key, state = None, [], None, None
        for batch in batches:
            shape = shape or _arrow(schema, batch.schema.field(group).type)
            for row in batch.to_pylist():
                if state is None or row[group] != key:
                    if state is not None:
                        held.append(end(key, state))
                    key, state = row[group], start()
                step(state, row)
            if len(held) > 1000:
                yield pa.RecordBatch.from_pylist(held, shape)
                held = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([*held, end(key, state)], shape)

    kind = dict(df.dtypes)[group]
    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, f"`{group}` {kind}, {schema}")


_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _arrow(schema: str, kind: pa.DataType) -> pa.Schema:
    fields = [f.split() for f in schema.split(", ")]
    return pa.schema([(n, _KINDS[t]) for n, t in fields]).insert(0, pa.field("conv_id", kind))
