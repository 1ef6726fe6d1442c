"""Every row of one table with every row of another, within a bound of bytes a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of a pair join is broadcast up to so many bytes; beyond, both sides are dealt to a grid of blocks.
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS, BLOCK_BYTES = 4096, 32 << 20
#: The larger side is dealt to a task for so many bytes of pairs.
PAIR_BYTES = 64 << 20


def _measure(df: DataFrame) -> tuple[int, int]:
    """Rows, and bytes in texts and 16 more for each other column."""
    texts = [c for c, t in df.dtypes if t == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(16 * (len(df.columns) - len(texts)) + 16))
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first())


def all_pairs(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Every query with every key. The smaller side is broadcast if it has few bytes; otherwise rows of both are
    dealt to blocks, and each two blocks meet through an equi-join. Both sides are measured first."""
    (nq, sq), (nk, sk) = _measure(queries), _measure(keys)
    if min(sq, sk) <= BROADCAST_BYTES:
        tasks = -(-max(nq * sk, nk * sq) // PAIR_BYTES)
        spread = lambda df, n: df.repartition(min(tasks, n)) if min(tasks, n) > 1 else df
        return spread(queries, nq).crossJoin(F.broadcast(keys)) if sk <= sq else F.broadcast(queries).crossJoin(spread(keys, nk))
    bq, bk = (max(-(-n // BLOCK_ROWS), -(-s // BLOCK_BYTES)) for n, s in ((nq, sq), (nk, sk)))
    deal = lambda df, own, n: df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(n)))
    q = deal(queries, "_bq", bq).withColumn("_bk", F.explode(F.sequence(F.lit(0), F.lit(bk - 1))))
    k = deal(keys, "_bk", bk).withColumn("_bq", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
    return q.join(k, ["_bq", "_bk"]).drop("_bq", "_bk")
