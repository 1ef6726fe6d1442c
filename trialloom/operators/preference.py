"""Preference and ranking sets from scored groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.folders import scratch
from trialloom.functions.numbering import number_within, number_within_small
from trialloom.functions.text import filled, seeded_order, strip

SCORE_SUFFIX = "Query-Key Relevance Score:"


#: Members of a group that are paired within one task's tile; larger groups are cut.
TILE = 1024


def comparison_pairs(scores: DataFrame, group: str = "group", idx: str = "idx", score: str = "score", threshold: float = 0.5, tile: int = TILE) -> DataFrame:
    """Rows (group, i, j, winner, loser) for all i < j of a group whose scores differ by more than the threshold.

    The join carries only index and score; null scores and null groups make no
    pair. A group of more than ``tile`` members is cut by rank of score into
    tiles of as many members; pairs of tiles are joined, each by a key of its
    own, and tiles whose scores all lie within the threshold are left out. So a
    group of any size is paired by many tasks, and members of equal score cost
    nothing."""
    known = scores.where(F.col(score).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(idx).alias("_i"), F.col(score).alias("_s"))
    large = known.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") > tile).select("_g")
    if large.isEmpty():
        return _pairs(known.withColumn("_t", F.lit(0)), known.withColumn("_t", F.lit(0)), group, threshold)
    path = scratch(scores.sparkSession, "tiles")
    large.write.parquet(f"{path}/large")
    large = scores.sparkSession.read.parquet(f"{path}/large")
    small = known.join(large, "_g", "left_anti").withColumn("_t", F.lit(0))
    ranked = number_within(known.join(large, "_g", "left_semi"), "_r", ["_g"], "_s", "_i")
    ranked.withColumn("_k", F.floor((F.col("_r") - 1) / tile)).select("_g", "_i", "_s", "_k").write.parquet(f"{path}/members")
    members = scores.sparkSession.read.parquet(f"{path}/members")
    tiles = members.groupBy("_g", "_k").agg(F.min("_s").alias("_low"), F.max("_s").alias("_high"))
    low, high = tiles.select("_g", F.col("_k").alias("_a"), "_low"), tiles.select("_g", F.col("_k").alias("_b"), "_high")
    # tiles are in order of score: the greatest difference is from the lower tile's least to the upper one's greatest
    met = low.join(high, "_g").where((F.col("_a") <= F.col("_b")) & (F.col("_high") - F.col("_low") > threshold)).select("_g", "_a", "_b")
    named = F.concat_ws(":", "_a", "_b").alias("_t")
    left = members.join(met.withColumnRenamed("_a", "_k").withColumn("_a", F.col("_k")), ["_g", "_k"]).select("_g", "_i", "_s", named, (F.col("_a") == F.col("_b")).alias("_same"))
    right = members.join(met.withColumnRenamed("_b", "_k").withColumn("_b", F.col("_k")), ["_g", "_k"]).select("_g", "_i", "_s", named)
    return _pairs(small, small, group, threshold).unionByName(_tile_pairs(left, right, group, threshold))


def _pairs(a: DataFrame, b: DataFrame, group: str, threshold: float) -> DataFrame:
    b = b.select("_g", "_t", F.col("_i").alias("_j"), F.col("_s").alias("_sj"))
    pairs = a.join(b, ["_g", "_t"]).where((F.col("_i") < F.col("_j")) & (F.abs(F.col("_s") - F.col("_sj")) > threshold))
    return _winners(pairs, group)


def _tile_pairs(a: DataFrame, b: DataFrame, group: str, threshold: float) -> DataFrame:
    """Pairs of a lower and an upper tile's members in either order of index; within one tile by index."""
    b = b.select("_g", "_t", F.col("_i").alias("_j"), F.col("_s").alias("_sj"))
    pairs = a.join(b, ["_g", "_t"]).where(F.when(F.col("_same"), F.col("_i") < F.col("_j")).otherwise(F.col("_i") != F.col("_j")) & (F.abs(F.col("_s") - F.col("_sj")) > threshold))
    turned = F.col("_i") > F.col("_j")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return _winners(pairs.select("_g", pick("_i", "_j").alias("_i"), pick("_j", "_i").alias("_j"), pick("_s", "_sj").alias("_s"), pick("_sj", "_s").alias("_sj")), group)


def _winners(pairs: DataFrame, group: str) -> DataFrame:
    first = F.col("_s") > F.col("_sj")
    return pairs.select(F.col("_g").alias(group), F.col("_i").alias("i"), F.col("_j").alias("j"), F.when(first, F.col("_i")).otherwise(F.col("_j")).alias("winner"), F.when(first, F.col("_j")).otherwise(F.col("_i")).alias("loser"))


def merge_pairs(given: DataFrame, scores: DataFrame, group: str = "group", idx: str = "idx", score: str = "score") -> DataFrame:
    """Given (group, winner, loser) pairs with both indices in range, repeats too, then all pairs of unequal scores not among them."""
    known = scores.select(group, F.col(idx).alias("_i")).distinct()
    kept = given.select(group, "winner", "loser")
    for side in ("winner", "loser"):
        kept = kept.join(known.withColumnRenamed("_i", side), [group, side], "left_semi").select(group, "winner", "loser")
    made = comparison_pairs(scores, group, idx, score, 0.0).select(group, "winner", "loser")
    fresh = made.join(kept.distinct(), [group, "winner", "loser"], "left_anti")
    return kept.withColumn("given", F.lit(True)).unionByName(fresh.withColumn("given", F.lit(False)))


def running_best_pairs(scores: DataFrame, problem: str, order: str, score: str) -> DataFrame:
    """In order, each score against the best so far: higher gives (new, best), lower (best, new), equal nothing."""
    w = Window.partitionBy(problem).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(F.col(score).isNotNull(), F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o")))).over(w)
    out = scores.withColumn("_b", best).where(F.col("_b").isNotNull() & F.col(score).isNotNull() & (F.col(score) != F.col("_b.s")))
    up, new, old = F.col(score) > F.col("_b.s"), F.col(order), -F.col("_b.o")
    return out.select(problem, F.when(up, new).otherwise(old).alias("winner"), F.when(up, old).otherwise(new).alias("loser"))


def prepare_scores(entries: DataFrame, scores: DataFrame, key: str, pos: str, extra: str) -> DataFrame:
    """Scores aligned to entries by position: null where none is known, 0.0 for extra entries."""
    out = entries.join(scores.select(key, pos, "score"), [key, pos], "left")
    return out.withColumn("score", F.when(F.col(extra), F.lit(0.0)).otherwise(F.col("score").cast("double")))


def group_trials(trials: DataFrame, index_map: DataFrame, cache: DataFrame, files: DataFrame) -> DataFrame:
    """Trials of known problems with a history: (problem_id, idx, run_id, score, n_steps, source).

    ``cache`` and ``files`` are (run_id, n_steps); the cache wins. Trials without a history go
    and the others are numbered anew in each problem, in trial order."""
    known = trials.join(index_map.select("entry_id", F.col("idx").alias("problem_id")), "entry_id")
    c = cache.select("run_id", F.col("n_steps").alias("_c"))
    f = files.select("run_id", F.col("n_steps").alias("_f"))
    out = known.join(c, "run_id", "left").join(f, "run_id", "left").where("_c is not null or _f is not null")
    w = Window.partitionBy("problem_id").orderBy("trial")
    return out.select("problem_id", (F.row_number().over(w) - 1).alias("idx"), "run_id", "score", F.coalesce("_c", "_f").alias("n_steps"), F.when(F.col("_c").isNotNull(), "cache").otherwise("files").alias("source"))


def nested_groups(grouped: DataFrame, pairs: DataFrame, pairs_a_row: int = 100_000) -> DataFrame:
    """The sink's shape: (problem_id, part, first, messages, comparison, scores), in order.

    A problem is one row (part 0) unless that could hold more than
    ``pairs_a_row`` pairs; then its members are dealt to parts by index, each
    with the pairs whose lesser index is its own, and ``first`` is the index of a
    part's first member. Indices of pairs count in the whole problem."""
    sizes = grouped.groupBy("problem_id").agg(F.count("*").alias("_n"))
    members = F.greatest(F.lit(1), F.floor(F.lit(pairs_a_row) / F.col("_n")))
    part = lambda c: F.when(F.col("_n") * (F.col("_n") - 1) / 2 <= pairs_a_row, F.lit(0)).otherwise(F.floor(F.col(c) / members)).cast("long").alias("part")
    m = grouped.join(sizes, "problem_id").groupBy("problem_id", part("idx")).agg(F.min("idx").alias("first"), F.array_sort(F.collect_list(F.struct("idx", "run_id", "score", "n_steps"))).alias("m"))
    p = pairs.join(sizes, "problem_id").groupBy("problem_id", part("i")).agg(F.array_sort(F.collect_list(F.struct("i", "j", "winner", "loser"))).alias("p"))
    return m.join(p, ["problem_id", "part"], "left").select(
        "problem_id", "part", "first", F.transform("m", lambda x: F.struct(x.run_id.alias("run_id"), x.score.alias("score"), x.n_steps.alias("n_steps"))).alias("messages"),
        F.coalesce(F.transform("p", lambda x: F.array(x.winner, x.loser)), F.array().cast("array<array<int>>")).alias("comparison"), F.transform("m", lambda x: x.score).alias("scores"),
    )


def query_block(query: Column) -> Column:
    """A query in its tags, a placeholder for missing text; wrapped text is kept."""
    q = F.coalesce(filled(query), F.lit("[missing query context]"))
    return F.when(q.startswith("<query>") & q.contains("</query>"), q).otherwise(F.concat(F.lit("<query>\n"), q, F.lit("\n</query>")))


def key_block(key: Column, tags: Column | None = None) -> Column:
    """A key in its tags, with a line of its tags if it has some; wrapped text is kept as it is."""
    k = filled(key)
    wrapped = k.startswith("<key>") & k.contains("</key>")
    body = F.coalesce(k, F.lit("[missing knowledge text]"))
    if tags is not None:
        listed = F.array_join(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), strip), lambda t: t != ""), ", ")
        body = F.concat(F.when(k.isNull() & (listed != ""), F.lit("[missing key text]")).otherwise(body), F.when(listed != "", F.concat(F.lit("\nTags: "), listed)).otherwise(F.lit("")))
    return F.when(wrapped, k).otherwise(F.concat(F.lit("<key>\n"), body, F.lit("\n</key>")))


def prompt_of_blocks(query: Column, key: Column) -> Column:
    return F.concat(query, F.lit("\n\n\n"), key, F.lit(f"\n\n\n{SCORE_SUFFIX}"))


def rank_prompt(query: Column, key: Column, tags: Column | None = None) -> Column:
    """Query and key in tags, placeholders for missing text, text that is wrapped already kept."""
    return prompt_of_blocks(query_block(query), key_block(key, tags))


def deal_order(seed: int, *keys: str) -> Column:
    """A draw of keys that any engine with MD5 can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def balanced_batches(items: DataFrame, problem: str, msg: str, step: str, n: int, seed: int = 0) -> DataFrame:
    """Rows (problem, batch, slot, msg, step, repeat): batches of exactly n (msg, step) pairs that use every pair.

    Pairs are dealt round by round: a round takes one unused pair of each
    message that still has some, messages and their steps in drawn order
    (``deal_order``). So the messages of a batch that are not used up differ by
    one pair at most. The last batch is filled with the problem's first pairs,
    which it does not hold, and with repeats if there are no others.

    A pair's place within its problem comes from ranges of sorted rows, and so does its round within a large message, so
    a problem or a message of any size is dealt by many tasks; small messages need one exchange (``number_within_small``)."""
    rounds = number_within_small(items.select(problem, msg, step), "_round", [problem, msg], deal_order(seed, problem, msg, step), step)
    placed = number_within(rounds, "_rn", [problem], "_round", deal_order(seed + 1, problem, msg), msg, step, total="_n").withColumn("_rn", F.col("_rn") - 1)
    short = F.pmod(-F.col("_n"), F.lit(n))
    # the pair at place r stands in for places n_pairs + r, + n_pairs ... of the last batch
    again = F.when(F.col("_rn") < short, F.sequence(F.lit(0), F.floor((short - 1 - F.col("_rn")) / F.col("_n")).cast("int"))).otherwise(F.array().cast("array<int>"))
    places = F.concat(F.array(F.col("_rn")), F.transform(again, lambda k: F.col("_n") + F.col("_rn") + k * F.col("_n")))
    out = placed.select(problem, msg, step, "_n", F.explode(places).alias("_p"))
    return out.select(problem, F.floor(F.col("_p") / n).alias("batch"), (F.col("_p") % n).alias("slot"), msg, step, (F.col("_p") >= F.col("_n")).alias("repeat"))


def batch_groups(batches: DataFrame, problem: str, msg: str) -> DataFrame:
    """Positions of each batch grouped by message: (problem, batch, msg, slots)."""
    return batches.groupBy(problem, "batch", msg).agg(F.array_sort(F.collect_list("slot")).alias("slots"))


def train_test_split(df: DataFrame, ratio: float, seed: int, *keys: str) -> DataFrame:
    """Add ``split``: in hashed order exactly int(total * (1 - ratio)) rows are train, ratio clamped to 0..1.

    Ranks come from the counts of hash ranges before a row's own and its place in that range, so no
    task sees all rows. Keys must tell rows apart."""
    ratio = min(1.0, max(0.0, ratio))
    cut = F.floor(F.round(F.col("_total") * (1 - ratio), 9))
    return _hash_ranks(df, seed, *keys).withColumn("split", F.when(F.col("_r") <= cut, "train").otherwise("test")).drop("_r", "_total")


def _hash_ranks(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Add ``_r``, the row's place in hashed order, and ``_total``, the number of rows."""
    h = seeded_order(seed, *keys)
    marked = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 54).cast("int"))
    counts = marked.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 1024 rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    return marked.join(F.broadcast(before.drop("_n")), "_b").withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", *keys)) + F.col("_before")).drop("_h", "_b", "_before")


def subsample(df: DataFrame, ratio: float, seed: int, *keys: str, multiple: int = 1) -> DataFrame:
    """max(1, floor(n * ratio)) rows, or the next lower multiple, in hashed order; the choice does not depend on partitions. Ranks are those of ``train_test_split``."""
    take = F.greatest(F.lit(1), F.floor(F.col("_total") * ratio))
    if multiple > 1:
        take = F.greatest(F.lit(multiple), F.floor(take / multiple) * multiple)
    return _hash_ranks(df, seed, *keys).where(F.col("_r") <= take).drop("_r", "_total")


def average_prompt_chars(batches: DataFrame, content: str) -> DataFrame:
    return batches.agg(F.coalesce(F.avg(F.char_length(content)), F.lit(0.0)).alias("average_chars"))


def preference_from_judge(results: DataFrame, sentences: DataFrame, output: str = "output") -> DataFrame:
    """Chosen and rejected sentence of each result: (result_id, question, chosen_id, rejected_id, chosen, rejected).

    The choice is the number in <ID> tags, else the first integer of the last 10 characters; only
    1 and 2 count, and both sentences must exist. ``sentences``: (sentence_id, sentence)."""
    tagged = F.nullif(strip(F.regexp_extract(output, r"(?s)<ID>(.*?)</ID>", 1)), F.lit(""))
    tail = F.nullif(F.regexp_extract(F.right(F.col(output), F.lit(10)), r"(\d+)", 1), F.lit(""))
    choice = F.when(F.col(output).rlike(r"(?s)<ID>.*?</ID>"), tagged).otherwise(tail).try_cast("int")
    picked = results.withColumn("_c", choice).where(F.col("_c").isin(1, 2) & (F.size("sentence_ids") >= 2))
    one, two = F.col("sentence_ids")[0], F.col("sentence_ids")[1]
    picked = picked.withColumn("chosen_id", F.when(F.col("_c") == 1, one).otherwise(two)).withColumn("rejected_id", F.when(F.col("_c") == 1, two).otherwise(one))
    a = sentences.select(F.col("sentence_id").alias("chosen_id"), F.col("sentence").alias("chosen"))
    b = sentences.select(F.col("sentence_id").alias("rejected_id"), F.col("sentence").alias("rejected"))
    return picked.join(a, "chosen_id").join(b, "rejected_id").select("result_id", "question", "chosen_id", "rejected_id", "chosen", "rejected")


def split_prompt(df: DataFrame, prompt: str) -> DataFrame:
    """Add query, key and tags of a prompt; without a query block the whole prompt is the query."""
    block = lambda tag: strip(F.regexp_extract(F.col(prompt), rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    key = block("key")
    last = strip(F.regexp_extract(key, r"([^\n]*)\z", 1))
    has_tags = F.lower(last).startswith("tags:")
    tags = F.filter(F.transform(F.split(F.substring(last, 6, 1 << 30), ","), strip), lambda t: t != "")
    return df.withColumns({
        "query": F.coalesce(F.nullif(block("query"), F.lit("")), strip(prompt)),
        "key": F.when(has_tags & key.contains("\n"), strip(F.regexp_replace(key, r"\n[^\n]*\z", ""))).when(has_tags, key).otherwise(key),
        "tags": F.when(has_tags, tags).otherwise(F.array().cast("array<string>")),
    })


def reward_score(c: Column) -> Column:
    """Score clamped to 0..10 and rounded half-even to a whole number; null stays null."""
    x = c.try_cast("double")
    return F.when(x.isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(10.0), x)), 0))


def group_advantage(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Add ``advantage``: (r - mean) / sqrt(popvar + 1e-8) over a group's non-null rewards; 0 for null or fewer than two."""
    s = df.groupBy(group).agg(F.avg(reward).alias("_m"), F.var_pop(reward).alias("_v"), F.count(reward).alias("_n"))
    ok = F.col(reward).isNotNull() & (F.col("_n") >= 2)
    return df.join(s, group, "left").withColumn("advantage", F.when(ok, (F.col(reward) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)).otherwise(0.0)).drop("_m", "_v", "_n")


def pair_loss_accuracy(groups: DataFrame, pairs: DataFrame, rewards: DataFrame, group: str = "group", idx: str = "idx", reward: str = "reward") -> DataFrame:
    """One row: mean over all groups of the mean of -log sigmoid(r_c - r_r) over a group's pairs (0 without pairs), and the share of pairs with r_c > r_r."""
    r = rewards.select(group, idx, reward)
    joined = pairs.join(r.select(group, F.col(idx).alias("winner"), F.col(reward).alias("_c")), [group, "winner"]).join(r.select(group, F.col(idx).alias("loser"), F.col(reward).alias("_r")), [group, "loser"])
    d = F.col("_c") - F.col("_r")
    loss = F.log1p(F.exp(-F.abs(d))) + F.greatest(-d, F.lit(0.0))
    per = joined.groupBy(group).agg(F.avg(loss).alias("_l"), F.count_if(d > 0).alias("_ok"), F.count("*").alias("_n"))
    return groups.select(group).distinct().join(per, group, "left").agg(
        F.avg(F.coalesce("_l", F.lit(0.0))).alias("loss"), F.coalesce(F.try_divide(F.sum("_ok"), F.sum("_n")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.sum("_n"), F.lit(0)).alias("pairs")
    )


#: Scores are summed as exp(s - STEP * bin), bin being the whole steps of s, so sums of bins never overflow and can be merged.
STEP = 256


def _bin(c: str) -> Column:
    return F.coalesce(F.floor(F.col(c) / STEP), F.lit(0))


def _log_sum(bins: Column, part: str) -> Column:
    """Log of the sum over bins of part * exp(STEP * bin); bins far below the greatest vanish, as they do in the sum itself."""
    top = F.array_max(F.transform(F.filter(bins, lambda x: x[part] > 0), lambda x: x["bin"]))
    total = F.aggregate(bins, F.lit(0.0), lambda a, x: a + x[part] * F.exp((x["bin"] - top).cast("double") * STEP))
    return F.log(total) + top * STEP


def group_log_softmax(df: DataFrame, group: str, score: str, output: str = "log_p") -> DataFrame:
    """Add the log-softmax of a group's scores; a group with a null score gets 0.0 throughout.

    Sums are merged from partial ones of each group and step of score, then
    joined once; a group is never in one task, and scores of any size are safe."""
    part = df.groupBy(F.col(group).alias("_g"), _bin(score).alias("bin")).agg(F.sum(F.exp(F.col(score) - _bin(score) * STEP)).alias("sum"), F.count_if(F.col(score).isNull()).alias("_none"))
    sums = part.groupBy("_g").agg(F.collect_list(F.struct("bin", F.coalesce("sum", F.lit(0.0)).alias("sum"))).alias("_bins"), F.sum("_none").alias("_none"))
    sums = sums.select("_g", F.when(F.col("_none") == 0, _log_sum(F.col("_bins"), "sum")).alias("_z"))
    out = df.join(sums, F.col(group).eqNullSafe(F.col("_g")), "left")
    return out.withColumn(output, F.coalesce(F.col(score) - F.col("_z"), F.lit(0.0))).drop("_g", "_z")


def group_kl(df: DataFrame, group: str, score: str, reference: str) -> DataFrame:
    """One row: sum of p (log p - log ref) per group, averaged over the groups with a reference.

    p and ref are softmaxes of scores and references. Per group the sum is the
    mean under p of score - reference, less the log of the scores' sum of
    exponentials, plus that of the references', so partial sums of each group
    and step suffice: no row is joined. A group with a null score has log p = 0
    for all rows, as in ``group_log_softmax``."""
    s, q = F.col(score), F.col(reference)
    weight = F.exp(s - _bin(score) * STEP)
    part = df.groupBy(F.col(group).alias("_g"), _bin(score).alias("bin"), _bin(reference).alias("_q")).agg(
        F.sum(weight).alias("p"), F.sum(weight * s).alias("ps"), F.sum(weight * q).alias("pq"), F.sum(F.exp(q - _bin(reference) * STEP)).alias("r"),
        F.sum(q).alias("total"), F.count("*").alias("n"), F.count_if(s.isNull()).alias("no_p"), F.count_if(q.isNull()).alias("no_q"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    per = part.groupBy("_g").agg(
        F.collect_list(F.struct("bin", zero("p"), zero("ps"), zero("pq"))).alias("_p"), F.collect_list(F.struct(F.col("_q").alias("bin"), zero("r"))).alias("_r"),
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("no_p").alias("no_p"), F.sum("no_q").alias("no_q"),
    )
    top = F.array_max(F.transform(F.filter("_p", lambda x: x.p > 0), lambda x: x.bin))
    mean = lambda c: F.aggregate("_p", F.lit(0.0), lambda a, x: a + x[c] * F.exp((x.bin - top).cast("double") * STEP)) / F.aggregate("_p", F.lit(0.0), lambda a, x: a + x.p * F.exp((x.bin - top).cast("double") * STEP))
    soft = mean("ps") - mean("pq") - _log_sum(F.col("_p"), "p") + _log_sum(F.col("_r"), "r")
    flat = F.col("n") * _log_sum(F.col("_r"), "r") - F.col("total")  # p = 1 for every row
    kl = per.where("no_q = 0").select(F.when(F.col("no_p") == 0, soft).otherwise(flat).alias("kl"))
    return kl.agg(F.coalesce(F.avg("kl"), F.lit(0.0)).alias("kl"), F.count("*").alias("groups"))
