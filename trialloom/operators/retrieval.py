"""Query and key retrieval: scoring pairs, top-k, sampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.folders import scratch
from trialloom.functions.numbering import number_within
from trialloom.functions.pairing import BLOCK_ROWS, all_pairs
from trialloom.functions.text import filled, seeded_uniform, strip
from trialloom.operators.knowledge import matches_step, step_conditions
from trialloom.operators.preference import key_block, prompt_of_blocks, query_block

def score_pairs(queries: DataFrame, keys: DataFrame, scorer: Callable[..., Column], part: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows (query_id, key_id, relevance) for every query (query_id, query) and key (key_id, key, tags).

    ``scorer`` maps the prompt column to a score: built-in functions or a pandas UDF. Either side is
    put into its tags once; a pair's prompt is joined in the scoring step and does not leave it.

    A scorer that needs but something of either side, say its length or a vector, is given as ``part``, which
    takes this from a side's block, and ``scorer`` of the two parts. Parts are taken once a row, so a pair
    costs what its parts do, however long the texts are."""
    tags = F.col("tags") if "tags" in keys.columns else None
    take = part or (lambda block: block)
    pairs = all_pairs(queries.select("query_id", take(query_block(F.col("query"))).alias("_q")), keys.select("key_id", take(key_block(F.col("key"), tags)).alias("_k")))
    score = scorer(F.col("_q"), F.col("_k")) if part else scorer(prompt_of_blocks(F.col("_q"), F.col("_k")))
    return pairs.select("query_id", "key_id", score.alias("relevance"))


def prompt_chars(query_chars: Column, key_chars: Column) -> Column:
    """Characters of a prompt from those of its blocks."""
    return query_chars + key_chars + F.char_length(prompt_of_blocks(F.lit(""), F.lit("")))


def linear_head_score(df: DataFrame, embedding: str, weight: list[float], bias: float = 0.0, output: str = "score") -> DataFrame:
    """Add dot(embedding, weight) + bias in double precision; null for a null embedding or another length."""
    w = np.asarray(weight, float).ravel()

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(embedding))
            sizes = np.diff(x.offsets.to_numpy()) if len(x) else np.zeros(0, int)
            ok = (sizes == len(w)) & ~np.asarray(x.is_null())
            flat = x.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(w))
            scores = np.full(len(x), np.nan)
            scores[ok] = flat @ w + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, mask=~ok)], names=[*batch.schema.names, output])

    return df.mapInArrow(run, df.withColumn(output, F.lit(None).cast("double")).schema)


#: Keys whose vectors are centres of blocks, and by how much a bound is widened for rounding.
CENTRES, BOUND_SLACK = 256, 1e-9


def usable_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v, n): vectors of doubles and their lengths; null and empty ones and those with null, infinite or undefined components go."""
    v = F.transform(vector, lambda x: x.cast("double"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.coalesce(whole, F.lit(False)) & (F.size("v") > 0)).withColumn("n", F.size("v"))


def _matrix(t: pa.Table, column: str = "v") -> np.ndarray:
    x = t[column].combine_chunks()
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)


_SCORED = {"query_id": pa.int64(), "key_id": pa.int64(), "relevance": pa.float64()}


def _best_of_blocks(k: int):
    """The k best keys of each query among two blocks' vectors of one length; of ties the smaller ids."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return pa.table({n: pa.array([], t) for n, t in _SCORED.items()})
        right = right.sort_by("id")
        s = _matrix(left) @ _matrix(right).T
        ids = right["id"].to_numpy()
        if s.shape[1] > k:
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
            tied = s == kth
            room = k - (s > kth).sum(axis=1, keepdims=True)
            r, i = np.nonzero((s > kth) | (tied & (np.cumsum(tied, axis=1) <= room)))
        else:
            r, i = np.nonzero(np.ones_like(s, bool))
        return pa.table({"query_id": left["id"].to_numpy()[r], "key_id": ids[i], "relevance": s[r, i]})

    return best


def block_scores(queries: DataFrame, keys: DataFrame, k: int, query_id: str = "query_id", key_id: str = "key_id", vector: str = "vector") -> DataFrame:
    """The k keys of the greatest inner product for each query: (query_id, key_id, relevance, rank), ties by key id.

    Keys and queries meet block by block in numpy; each block sends on its k best only, and these are
    ranked again. Both sides may grow: groups are pairs of blocks of bounded size. Vectors that are null or
    empty or hold null or non-finite components take no part, and vectors meet those of their own length only."""
    queries, keys = usable_vectors(queries, query_id, vector), usable_vectors(keys, key_id, vector)
    nq, nk = queries.count(), keys.count()
    bq, bk = max(1, -(-nq // 1024)), max(1, -(-nk // BLOCK_ROWS))
    q = queries.withColumn("bq", F.pmod(F.xxhash64("id"), F.lit(bq)).cast("int")).withColumn("bk", F.explode(F.sequence(F.lit(0), F.lit(bk - 1))))
    c = keys.withColumn("bk", F.pmod(F.xxhash64("id"), F.lit(bk)).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
    out = q.groupBy("n", "bq", "bk").cogroup(c.groupBy("n", "bq", "bk")).applyInArrow(_best_of_blocks(k), "query_id long, key_id long, relevance double")
    return top_k_keys(out, k)


def bounded_scores(queries: DataFrame, keys: DataFrame, k: int, query_id: str = "query_id", key_id: str = "key_id", vector: str = "vector", block_rows: int = 256) -> tuple[DataFrame, DataFrame]:
    """(result of ``block_scores``, one row of what was skipped: queries, blocks, pairs, met, skipped_share).

    Keys are put into blocks around at most CENTRES of them, chosen by hash, and
    dealt on to blocks of some ``block_rows``. A block has a centre c, a radius r and a greatest norm m, so no
    key in it scores more than q.c + |q| r, nor than |q| m (Cauchy and Schwarz).
    Each query first meets the blocks of the highest bounds that hold k keys
    together; then only those whose bound reaches the kth score that it has. What
    is skipped depends on the data, the result does not."""
    spark = queries.sparkSession
    path = scratch(spark, "bounded")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    queries, keys = written(usable_vectors(queries, query_id, vector), "queries"), usable_vectors(keys, key_id, vector)
    picked = [(r.id, r.n, r.v) for r in keys.orderBy(F.xxhash64("id"), "id").limit(CENTRES).collect()]
    sizes = sorted({n for _, n, _ in picked})
    centres = {n: np.array([v for _, m, v in picked if m == n], float) for n in sizes}
    kind = "id long, v array<double>, n int, centre int, distance double, norm double"

    def place(batches):
        for b in batches:
            v, n = b.column("v"), b.column("n").to_numpy()
            centre, distance, norm = np.full(len(n), -1, np.int32), np.zeros(len(n)), np.zeros(len(n))
            for size in np.unique(n):
                at = np.flatnonzero(n == size)
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                norm[at] = np.sqrt((x * x).sum(axis=1))
                c = centres.get(int(size))
                if c is None:  # no centre of this length: the origin
                    distance[at] = norm[at]
                    continue
                nearest = np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)
                centre[at], distance[at] = nearest, np.sqrt(((x - c[nearest]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("id"), v, b.column("n"), pa.array(centre), pa.array(distance), pa.array(norm)], names=[c.split()[0] for c in kind.split(", ")])

    placed = written(keys.select("id", "v", "n").mapInArrow(place, kind), "placed")
    # parts of a centre are rings of distance, so that inner ones have a small radius
    ranked = number_within(placed, "at", ["n", "centre"], "distance", "id").withColumn("part", F.floor((F.col("at") - 1) / block_rows)).drop("at")
    members = written(ranked.withColumn("block", F.xxhash64("n", "centre", "part")), "members")
    blocks = members.groupBy("n", "centre", "block").agg(F.count("*").alias("rows"), F.max("distance").alias("radius"), F.max("norm").alias("most"))

    def bounds(left: pa.Table, right: pa.Table) -> pa.Table:
        shape = pa.schema([("id", pa.int64()), ("block", pa.int64()), ("rows", pa.int64()), ("bound", pa.float64())])
        if not (len(left) and len(right)):
            return shape.empty_table()
        q, size = _matrix(left), left["n"][0].as_py()
        c = centres.get(size, np.zeros((1, size)))
        norm = np.sqrt((q * q).sum(axis=1))[:, None]
        near = (q @ c.T)[:, np.maximum(right["centre"].to_numpy(), 0)]
        near = np.where(right["centre"].to_numpy() < 0, 0.0, near)
        bound = np.minimum(near + norm * right["radius"].to_numpy(), norm * right["most"].to_numpy())
        bound += BOUND_SLACK * (1 + np.abs(bound) + norm * right["most"].to_numpy())
        m, n = bound.shape
        return pa.table([np.repeat(left["id"].to_numpy(), n), np.tile(right["block"].to_numpy(), m), np.tile(right["rows"].to_numpy(), m), bound.ravel()], schema=shape)

    blocks = written(blocks, "blocks")
    bq, bk = max(1, -(-queries.count() // 1024)), max(1, -(-blocks.count() // BLOCK_ROWS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = queries.withColumn("bq", F.pmod(F.xxhash64("id"), F.lit(bq)).cast("int")).withColumn("bk", spread(bk))
    held = blocks.withColumn("bk", F.pmod("block", F.lit(bk)).cast("int")).withColumn("bq", spread(bq))
    pairs = written(dealt.groupBy("n", "bq", "bk").cogroup(held.groupBy("n", "bq", "bk")).applyInArrow(bounds, "id long, block long, rows long, bound double"), "bounds")
    before = Window.partitionBy("id").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = written(pairs.withColumn("_before", F.coalesce(F.sum("rows").over(before), F.lit(0))).where(F.col("_before") < k).select("id", "block"), "first")

    def met(chosen: DataFrame) -> DataFrame:
        """Scores of the chosen (query, block) pairs: a block meets its queries in groups of a bounded number."""
        asked = chosen.join(queries, "id").withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(bq)).cast("int"))
        wanted = asked.select(F.col("block").alias("_block"), F.col("deal").alias("_deal")).distinct()
        held = members.join(wanted, F.col("block") == F.col("_block")).select(F.col("id"), F.col("v"), "_block", "_deal")
        return asked.groupBy("block", "deal").cogroup(held.groupBy("_block", "_deal")).applyInArrow(_best_of_blocks(k), "query_id long, key_id long, relevance double")

    near = written(top_k_keys(met(first), k), "near")
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("relevance").alias("kth"))
    further = written(pairs.join(first, ["id", "block"], "left_anti").join(kth, "id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).select("id", "block"), "further")
    out = top_k_keys(near.drop("rank").unionByName(met(further)), k)
    n_first, n_more = first.count(), further.count()
    stats = pairs.agg(F.countDistinct("id").alias("queries"), F.countDistinct("block").alias("blocks"), F.count("*").alias("pairs")).withColumn("met", F.lit(n_first + n_more).cast("long"))
    return out, stats.withColumn("skipped_share", F.coalesce(F.try_divide(F.col("pairs") - F.col("met"), F.col("pairs")), F.lit(0.0)))


def top_k_keys(scored: DataFrame, k: int, query: str = "query_id", key: str = "key_id") -> DataFrame:
    """The k best keys of each query with their rank; ties go to the smaller key."""
    w = Window.partitionBy(query).orderBy(F.desc("relevance"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_weighted_sample(ranked: DataFrame, k: int, topk: int, weights: list[float] | None = None, decay: float | None = None, seed: int = 0, query: str = "query_id", key: str = "key_id") -> DataFrame:
    """k keys of the ``topk`` best of each query, drawn without replacement by weight of rank: adds ``pick``.

    Weights are the list's, which also cuts the pool to its length, or powers of ``decay``; without
    either, and with no more than k keys, the best are taken. Ranks of weight 0 only fill up, in order.
    Keys are drawn by the largest ln(u) / weight (Efraimidis and Spirakis), u hashed from query, key and seed."""
    pool = ranked.where(F.col("rank") <= (min(topk, len(weights)) if weights else topk))
    if weights:
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank").cast("int"))
    elif decay is not None:
        weight = F.pow(F.lit(float(decay)), F.col("rank") - 1)
    else:
        weight = F.lit(0.0)
    n = F.count("*").over(Window.partitionBy(query))
    u = F.greatest(seeded_uniform(seed, query, key), F.lit(1e-300))
    pool = pool.withColumn("_n", n).withColumn("_w", F.when(F.col("_n") > k, weight).otherwise(F.lit(0.0)))
    pool = pool.withColumn("_p", F.when(F.col("_w") > 0, F.log(u) / F.col("_w")))
    w = Window.partitionBy(query).orderBy(F.col("_p").desc_nulls_last(), "rank")
    return pool.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k).drop("_n", "_w", "_p")


def random_bypass(picked: DataFrame, candidates: DataFrame, rate: float, k: int, seed: int = 0, query: str = "query_id", key: str = "key_id") -> DataFrame:
    """For a hashed share ``rate`` of the queries, k uniform picks of all candidates with null relevance replace the picks: (query_id, key_id, relevance, pick, source)."""
    coin = seeded_uniform(seed, query) < rate
    w = Window.partitionBy(query).orderBy(seeded_uniform(seed + 1, query, key), key)
    drawn = candidates.where(coin).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k).select(query, key, F.lit(None).cast("double").alias("relevance"), "pick", F.lit("random").alias("source"))
    return picked.where(~coin).select(query, key, "relevance", "pick", F.lit("ranked").alias("source")).unionByName(drawn)


def nearest_unseen(scored: DataFrame, disposed: DataFrame, kept: DataFrame, query: str = "query_id", key: str = "key_id") -> DataFrame:
    """The best key of each query that is neither disposed of nor kept (both by query and key)."""
    seen = disposed.select(query, key).unionByName(kept.select(query, key))
    fresh = scored.join(seen, [query, key], "left_anti")
    return top_k_keys(fresh, 1, query, key).drop("rank")


def parse_rankings(responses: DataFrame, candidates: DataFrame, k: int, query: str = "query_id", key: str = "key_id") -> DataFrame:
    """Rows (query_id, key_id, place, score, reason): a model's ranking of candidates by 1-based index.

    ``responses``: (query_id, response), text around the JSON array is tolerated; an index out of
    range is dropped; without any left the first k candidates stand. ``candidates``: (query_id, index, key_id)."""
    inner = F.nullif(F.regexp_extract("response", r"(?s)\[.*\]", 0), F.lit(""))
    schema = "array<struct<index:string, score:string, reason:string>>"
    # a list of bare numbers counts as indices
    numbers = F.transform(F.from_json(inner, "array<string>"), lambda e: F.struct(e.alias("index"), F.lit(None).cast("string").alias("score"), F.lit(None).cast("string").alias("reason")))
    items = F.when(inner.contains("{"), F.from_json(inner, schema)).otherwise(numbers)
    named = responses.select(query, F.posexplode(items).alias("pos", "e")).select(query, "pos", F.col("e.index").try_cast("int").alias("index"), F.col("e.score").try_cast("double").alias("score"), F.col("e.reason").alias("reason"))
    found = named.join(candidates.select(query, "index", key), [query, "index"])
    found = found.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("pos"))).where(F.col("place") <= k)
    without = responses.select(query).distinct().join(found.select(query).distinct(), query, "left_anti")
    first = candidates.where(F.col("index") <= k).join(without, query).select(query, key, F.col("index").alias("place"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("reason"))
    return found.select(query, key, F.col("place").cast("int").alias("place"), "score", "reason").unionByName(first)


def attach_ranked_payload(ranked: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """Ranker rows (query_id, place, key_id, key) with payload: by key id, else by key text (the first key of that text)."""
    by_id = keys.select("key_id", F.col("payload").alias("_a"))
    by_text = keys.groupBy("key").agg(F.min_by("payload", "key_id").alias("_b"))
    out = ranked.join(by_id, "key_id", "left").join(by_text, "key", "left").withColumn("payload", F.coalesce("_a", "_b"))
    w = Window.partitionBy("query_id").orderBy("place")
    return out.where("payload is not null").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("query_id", F.col("_n").alias("place"), "payload")


def route_agents(candidates: DataFrame, selected: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows (query_id, agents): agents of the selected entries, distinct, in order, without "*"; without any, of the first candidate.

    ``candidates``: (query_id, pos, id, agents); those without an allowed agent do not count. ``selected``: (query_id, id, place)."""
    named = F.filter("agents", lambda a: a.isin(*allowed) & (a != "*"))
    ok = candidates.withColumn("agents", named).where(F.size("agents") > 0)
    chosen = ok.join(selected.select("query_id", "id", "place"), ["query_id", "id"])
    first = ok.groupBy("query_id").agg(F.min_by("agents", "pos").alias("_first"))
    each = chosen.select("query_id", "place", F.posexplode("agents").alias("p", "a")).groupBy("query_id", "a").agg(F.min(F.struct("place", "p")).alias("at"))
    lists = each.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "a"))), lambda s: s.a).alias("_list"))
    return first.join(lists, "query_id", "left").select("query_id", F.coalesce("_list", "_first").alias("agents"))


def resolve_search_settings(configs: DataFrame, max_steps: int, keys: list[str]) -> DataFrame:
    """One row a step: the last non-null value, in config order, of each setting among the configs that match the step.

    topk settings below 1 and rates outside 0..1 count as not given."""
    def valid(c: str) -> Column:
        x = F.col(c)
        if "rate" in c:
            return F.when((x >= 0) & (x <= 1), x)
        return F.when(x >= 1, x) if "topk" in c else x

    # a handful of configs: the steps are the larger side
    parsed = configs.withColumn("_c", step_conditions(F.col("step").cast("string"))).withColumn("at_step", F.explode(F.sequence(F.lit(1), F.lit(max_steps)))).where(matches_step(F.col("_c"), F.col("at_step")))
    return parsed.groupBy("at_step").agg(*[F.max_by(valid(c), F.when(valid(c).isNotNull(), F.col("ord"))).alias(c) for c in keys])


def retrieval_usage(scored: DataFrame, tokens_per_pair: Column | None = None) -> DataFrame:
    """One row: pairs, distinct queries and keys, and tokens if given."""
    return scored.agg(F.count("*").alias("pairs"), F.countDistinct("query_id").alias("queries"), F.countDistinct("key_id").alias("keys"), *([F.coalesce(F.sum(tokens_per_pair), F.lit(0)).alias("tokens")] if tokens_per_pair is not None else []))


def chunk_context(chunks: DataFrame, definitions: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows (chunk_id, kind, place, name, text): definitions of the functions that a chunk calls, in order of first call, and summaries of its path's folders, outermost first.

    ``chunks``: (chunk_id, path, calls); ``definitions``: (name, text); ``folders``: (path, summary)."""
    calls = chunks.select("chunk_id", F.posexplode("calls").alias("pos", "name")).groupBy("chunk_id", "name").agg(F.min("pos").alias("place"))
    called = calls.join(definitions.select("name", "text"), "name").select("chunk_id", F.lit("call").alias("kind"), "place", "name", "text")
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = chunks.where(F.size(parts) > 1).select("chunk_id", F.posexplode(up).alias("place", "path"))
    inside = above.join(folders.select("path", "summary"), "path").select("chunk_id", F.lit("folder").alias("kind"), "place", F.col("path").alias("name"), F.col("summary").alias("text"))
    return called.unionByName(inside)
