"""Near-duplicate vectors: random hyperplanes, exact cosine, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import Scratch, local_components
from trialloom.llm.components import connected_components
from trialloom.llm.exact_topk import usable

BUCKET_ROWS = 512
TILE = 2048


def table_plan(rows: int, threshold: float, recall: float, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """Bits of a signature and number of tables.

    Bits grow with the logarithm of the rows, so that buckets of unrelated
    vectors keep their size; tables follow so that a pair exactly at the
    threshold shares a bucket with probability ``recall``.
    """
    same = 1 - math.acos(threshold) / math.pi
    bits = min(30, max(4, int(math.log2(max(rows, 1) / bucket_rows + 1))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(v: np.ndarray) -> np.ndarray:
    """Rows as unit vectors of doubles."""
    v = v.astype(float)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Two vectors link if their cosine, in double precision, is at least
    ``threshold``. Equal vectors are first grouped, so copies cost nothing more.
    Signs of projections on random hyperplanes give a signature in each table;
    pairs that share a bucket of some table are verified exactly. ``recall`` is
    the chance of finding a pair right at the threshold; closer pairs are surer.
    A pair counts in the first table where it meets. Buckets of any size are
    compared whole: large ones are cut into tiles and every two tiles are a
    group of their own. Groups send on counts and a spanning set of links only.

    Null vectors, zero vectors and those with null or non-finite components or
    without components link with nothing: no links, component is the row's own
    id, kept. Rows with a null id do so too (component null, kept). Vectors of
    different lengths never link. Repeated rows are copies of each other. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "near-vectors")
    x = F.col(vector_col)
    live = usable(vector_col) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False)) & F.col(id_col).isNotNull()
    keyed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector"), live.alias("live"))
    keyed = keyed.withColumn("k1", F.when(F.col("live"), F.xxhash64("vector"))).withColumn("k2", F.when(F.col("live"), F.xxhash64(F.lit(1), "vector")))
    ids = scratch.table(keyed.select("vec_id", "live", "k1", "k2"), "ids")
    groups = keyed.where("live").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    groups = scratch.table(groups, "groups")
    n_groups = groups.count()
    bits, tables = table_plan(n_groups, threshold, recall)

    def sign(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            column = batch.column("vector")
            dims = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                v = _units(flat[starts[rows][:, None] + np.arange(d)])
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((d, tables * bits))
                sigs = ((v @ planes[d]) > 0).reshape(len(rows), tables, bits) @ weights
                sub = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [sub.column("rep"), sub.column("copies"), sub.column("vector"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * tables + 1, tables, dtype=np.int32)), pa.array(sigs.ravel().astype(np.int32)))],
                    names=["rep", "copies", "vector", "sigs"],
                )

    # vectors are exchanged as they are, not as doubles
    kind = groups.schema["vector"].dataType.simpleString()
    signed = scratch.table(groups.select("rep", "copies", "vector").mapInArrow(sign, f"rep long, copies long, vector {kind}, sigs array<int>"), "signed")
    placed = signed.select("rep", "copies", "vector", "sigs", F.size("vector").alias("d"), F.posexplode("sigs").alias("t", "sig"))
    sizes = signed.select(F.size("vector").alias("d"), F.posexplode("sigs").alias("t", "sig")).groupBy("d", "t", "sig").count()
    large = scratch.table(sizes.where(F.col("count") > TILE).select("d", "t", "sig", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "large")
    placed = placed.join(large, ["d", "t", "sig"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))

    def verify(group: pa.Table) -> pa.Table:
        rep, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
        n = len(rep)
        links, label = np.zeros(n, np.int64), np.arange(n)
        if n > 1:
            order = np.argsort(rep, kind="stable")
            rep, copies = rep[order], copies[order]
            unit, sigs = _units(_vectors(group["vector"]))[order], _vectors(group["sigs"])[order]
            tile, t = group["tile"].to_numpy()[order], group["t"][0].as_py()
            within = group["lo"][0].as_py() == group["hi"][0].as_py()
            for s in range(0, n, 512):
                close = unit[s : s + 512] @ unit.T >= threshold
                i, j = np.nonzero(close)
                i += s
                ok = (i < j) & (within | (tile[i] != tile[j]))
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                new = np.ones(len(i), bool)
                for earlier in range(t):
                    new &= sigs[i, earlier] != sigs[j, earlier]
                links += np.bincount(i[new], copies[j[new]], n).astype(np.int64) + np.bincount(j[new], copies[i[new]], n).astype(np.int64)
                label = local_components(n, i, j, label)
        use = (links > 0) | (label != np.arange(n))
        return pa.table({"rep": rep[use], "links": links[use], "root": rep[label[use]]})

    met = placed.groupBy("d", "t", "sig", "lo", "hi").applyInArrow(verify, "rep long, links long, root long")
    met = scratch.table(met, "met")
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(met, "rep", "root", scratch)
    known = scratch.table(
        groups.select("k1", "k2", "rep", "copies").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "known",
    )
    linked = ids.where("live").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = ids.where("not live").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
