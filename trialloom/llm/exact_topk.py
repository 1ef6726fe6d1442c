"""Exact top-k by integer inner product through histogram selection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialloom.llm.common import Scratch

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 1024
BIN_BITS = 8


def usable(embedding: str):
    """True for vectors that are not null and hold finite numbers only."""
    x = F.col(embedding)
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def quantised(embedding: str, scale: int):
    return F.transform(F.col(embedding), lambda v: F.floor(v.cast("double") * scale).cast("long"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column; shorter rows are padded with zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _scores(queries: pa.Table, rows: pa.Table, width: int, exact: bool) -> np.ndarray:
    q, c = _matrix(queries["vector"], width), _matrix(rows["vector"], width)
    return (q.astype(float) @ c.T.astype(float)).astype(np.int64) if exact else q @ c.T


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of ``vectors`` with the highest inner product for each query.

    Components x count as floor(scale * x), taken as doubles. Result: query_id,
    rank (from 1), vec_id, score; ties go to the smaller id, queries with fewer
    candidates return all of them. A query is never its own candidate.

    Candidates and queries are cut into blocks of bounded size and every pair of
    blocks is one group, so memory does not grow with either side. Each round
    scores all pairs and counts all scores in bins of one global histogram per
    query. The bin with the kth score is split 2**8-fold in the next round
    until bins are single scores. A last round keeps scores at or above the kth
    value; of those equal to it the smallest ids.

    Null ids, null vectors and vectors with null or non-finite components take
    no part. Shorter vectors count as padded with zeros; empty ones score 0.
    Of rows with one id in ``queries`` that with the smallest vector is taken; in
    ``vectors`` repeated rows are candidates each. Other columns are ignored.
    Vectors so long that a score need not fit a 64-bit integer are an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")

    def clean(df: DataFrame) -> DataFrame:
        return df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col, scale).alias("vector"))

    rows = scratch.table(clean(vectors), "rows")
    asked = scratch.table(clean(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")), "queries")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    n, width, most = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    m, qwidth, qmost = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    width, most = max(width, qwidth), max(most, qmost)
    if most >= 2.0**62:  # no score is beyond the greatest squared length
        raise ValueError("scores may not fit a 64-bit integer")
    exact = most < 2.0**52
    parts, blocks = max(1, math.ceil(n / CANDIDATE_BLOCK)), max(1, math.ceil(m / QUERY_BLOCK))
    spread = lambda df, key, own, n_own, other, n_other: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    candidates = spread(rows, "vec_id", "part", parts, "block", blocks)

    bits = max(1, math.ceil(math.log2(most + 1)) + 1)
    shifts = list(range(max(0, bits - BIN_BITS), 0, -BIN_BITS)) + [0]
    state = asked.select("query_id", F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("above"))

    def rounds(shift: int, before: int | None):
        def count(group: pa.Table, side: pa.Table) -> pa.Table:
            if not (len(group) and len(side)):
                return pa.table({"query_id": pa.array([], pa.int64()), "bin": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
            s = _scores(side, group, width, exact)
            ok = side["query_id"].to_numpy()[:, None] != group["vec_id"].to_numpy()[None, :]
            if before is None:
                low, bins = np.full(len(side), -(1 << bits >> shift)), 2 << bits >> shift
            else:
                ok &= (s >> before) == side["bin"].to_numpy()[:, None]
                low, bins = side["bin"].to_numpy() << (before - shift), 1 << (before - shift)
            place = (s >> shift) - low[:, None] + bins * np.arange(len(side))[:, None]
            n = np.bincount(place[ok], minlength=bins * len(side)).reshape(len(side), bins)
            r, c = np.nonzero(n)
            return pa.table({"query_id": side["query_id"].to_numpy()[r], "bin": c + low[r], "n": n[r, c]})

        return count

    before = None
    for shift in shifts:
        side = spread(asked.join(state, "query_id"), "query_id", "block", blocks, "part", parts)
        counts = candidates.groupBy("part", "block").cogroup(side.groupBy("part", "block")).applyInArrow(rounds(shift, before), "query_id long, bin long, n long")
        by_bin = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n")).join(state.select("query_id", "above"), "query_id")
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        run = by_bin.withColumn("upto", F.col("above") + F.sum("n").over(down))
        found = run.where((F.col("upto") - F.col("n") < k)).groupBy("query_id").agg(F.min_by("bin", "bin").alias("bin"), F.min_by(F.col("upto") - F.col("n"), "bin").alias("above"))
        state = scratch.table(found, "bins")
        before = shift

    def keep(group: pa.Table, side: pa.Table) -> pa.Table:
        if not (len(group) and len(side)):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        s = _scores(side, group, width, exact)
        ids, asking = group["vec_id"].to_numpy(), side["query_id"].to_numpy()
        kth, room = side["bin"].to_numpy(), k - side["above"].to_numpy()
        order = np.argsort(ids, kind="stable")
        s, ids = s[:, order], ids[order]
        other = asking[:, None] != ids[None, :]
        tied = (s == kth[:, None]) & other
        take = ((s > kth[:, None]) & other) | (tied & (np.cumsum(tied, axis=1) <= room[:, None]))
        r, c = np.nonzero(take)
        return pa.table({"query_id": asking[r], "vec_id": ids[c], "score": s[r, c]})

    side = spread(asked.join(state, "query_id"), "query_id", "block", blocks, "part", parts)
    kept = candidates.groupBy("part", "block").cogroup(side.groupBy("part", "block")).applyInArrow(keep, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
