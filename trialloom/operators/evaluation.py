"""Scored trials to evaluations. Trials are rows (problem_id, arm, trial, score, feedback, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.folders import scratch
from trialloom.functions.text import filled, first_filled, json_candidates, round2, seeded_order, strip

ARMS = ("no_klg", "klg")
ID_COLUMNS = ("id", "ID", "question_id", "QuestionID", "problem_id", "ProblemID")


def _has(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def _id_part(c: Column, limit: int = 48) -> Column:
    cleaned = F.regexp_replace(c, r"[^\p{L}\p{N}_\- ]", " ")
    return F.substring(F.regexp_replace(strip(cleaned), r"\s+", "_"), 1, limit)


def entry_id(df: DataFrame, index: str, output: str = "entry_id") -> DataFrame:
    """Add the id of each problem: the first id column that is neither empty nor 0, else the patch
    file, else the CSV path, else a text made of index, topic or problem, and indices. Columns
    that ``df`` lacks count as null."""
    explicit = [F.when(~_has(df, c).isin("", "0", "0.0", "false"), _has(df, c)) for c in ID_COLUMNS]
    # columns that differ from another only in case are one column in Spark
    topic, problem = filled(_has(df, "Topic")), first_filled(_has(df, "Question"), _has(df, "problem"))
    hyper, sample = F.nullif(_has(df, "HyperParamIndex"), F.lit("")), F.nullif(_has(df, "SampleIndex"), F.lit(""))
    parts = F.concat_ws(
        "|",
        F.format_string("idx_%05d", F.col(index)),
        F.coalesce(_id_part(topic), _id_part(problem)),
        F.concat(F.lit("hp_"), hyper),
        F.concat(F.lit("sample_"), sample),
    )
    return df.withColumn(output, F.coalesce(*explicit, filled(_has(df, "patch_file")), filled(_has(df, "CSVPath")), parts))


def dataset_index_map(df: DataFrame, index: str = "idx", key: str = "entry_id") -> DataFrame:
    """First index of each entry id."""
    return df.groupBy(key).agg(F.min(index).alias(index))


def pending(dataset: DataFrame, done: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """Dataset rows whose key is not done yet, the first ``limit`` in order."""
    rest = dataset.join(done.select(key).distinct(), key, "left_anti")
    return rest if limit is None else rest.orderBy(order).limit(limit)


def first_records(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first record of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def run_cache_key(entry: str, run: str) -> Column:
    return F.concat(F.col(entry).cast("string"), F.lit("::"), F.col(run).cast("string"))


def epoch_run_key(index: str, epoch: str, sample: str, rerun: str = "") -> Column:
    """Cache key of an optimiser's run: index, epoch and sample, and the mark of a rerun if there is one."""
    parts = F.concat_ws("::", *[F.col(c).cast("string") for c in (index, epoch, sample)])
    return F.concat(parts, F.lit(f"::{rerun}" if rerun else ""))


def plan_epoch(problems: DataFrame, epoch: int, samples: int, cache: DataFrame, rerun: str = "", index: str = "idx") -> DataFrame:
    """The grid problem x sample of an epoch: all columns of ``problems`` plus epoch, sample, key, run_name, cached and
    the cache's output, score and feedback; without a cached run these are null. ``cache``: (key, output, score, feedback)."""
    grid = problems.withColumn("epoch", F.lit(epoch)).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))) if samples > 0 else problems.limit(0).withColumns({"epoch": F.lit(epoch), "sample": F.lit(0)})
    name = F.format_string("klg_optim_e%d_i%d_s%d" + (f"_{rerun}" if rerun else ""), "epoch", index, "sample")
    grid = grid.withColumn("key", epoch_run_key(index, "epoch", "sample", rerun)).withColumn("run_name", name)
    held = cache.select("key", F.lit(True).alias("cached"), "output", F.coalesce("score", F.lit(0.0)).alias("score"), "feedback")
    return grid.join(held, "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def run_cache_merge(old: DataFrame, new: DataFrame, keys: list[str], payload: list[str], saved_at: str = "saved_at") -> DataFrame:
    """The latest record of each key; if its payload equals the old one's, the old saved_at stays."""
    both = old.select(*keys, *payload, saved_at, F.lit(0).alias("_new")).unionByName(new.select(*keys, *payload, saved_at, F.lit(1).alias("_new")))
    value = F.struct(*payload)
    at = F.struct(saved_at, "_new", value.alias("value"))
    best = both.groupBy(*keys).agg(
        F.max(at).alias("last"),
        F.max(F.when(F.col("_new") == 0, at)).alias("before"),
    )
    same = F.col("before.value").eqNullSafe(F.col("last.value"))
    return best.select(*keys, *[F.col(f"last.value.{p}").alias(p) for p in payload], F.when(same, F.col(f"before.{saved_at}")).otherwise(F.col(f"last.{saved_at}")).alias(saved_at))


def resolve_run_dir(wanted: DataFrame, dirs: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Add ``run_dir``: the directory of that name, else the last whose name ends with the id's first 8
    characters, else the one whose ``meta_run_id`` equals, else the id itself. ``dirs``: (name, meta_run_id)."""
    exact = dirs.select(F.col("name").alias(run_id), F.col("name").alias("_exact")).distinct()
    tail = dirs.where(F.col("name").rlike("-[^-]{8}$")).groupBy(F.substring_index("name", "-", -1).alias("_tail")).agg(F.max("name").alias("_ending"))
    meta = dirs.where("meta_run_id is not null").groupBy(F.col("meta_run_id").alias(run_id)).agg(F.max("name").alias("_meta"))
    out = wanted.join(exact, run_id, "left").withColumn("_tail", F.substring(run_id, 1, 8)).join(tail, "_tail", "left").join(meta, run_id, "left")
    return out.select(*wanted.columns, F.coalesce("_exact", "_ending", "_meta", run_id).alias("run_dir"))


def judge_prompt(question: Column, reference: Column, answer: Column, patch: Column | None = None, history: Column | None = None) -> Column:
    """The judge's input: each given part in tags, empty parts left out."""
    parts = [("QUESTION", question), ("PATCH", patch), ("REFERENCE ANSWER", reference), ("MODEL ANSWER", answer), ("HISTORY", history)]
    tagged = [F.concat(F.lit(f"<{t}>\n"), filled(c), F.lit(f"\n</{t}>")) for t, c in parts if c is not None]
    return F.concat_ws("\n\n", *tagged)


def coerce_score(c: Column) -> Column:
    """Number in 0..10 with two places; 0 if it is not a number."""
    x = c.try_cast("double")
    return F.coalesce(F.when(x.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), x)), 2)), F.lit(0.0))


def parse_judgement(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``score`` and ``feedback`` from the judge's JSON, with or without fences and prose around it."""
    schema = "struct<score:string, feedback:string, rationale:string>"
    whole, inner = json_candidates(response, "{", "}")
    usable = lambda t: F.when(F.get_json_object(t, "$").isNotNull(), F.from_json(t, schema))
    parsed = F.coalesce(usable(whole), usable(inner))
    out = df.withColumn("_j", parsed)
    return out.withColumn("score", coerce_score(F.col("_j.score"))).withColumn("feedback", strip(F.coalesce(F.nullif("_j.feedback", F.lit("")), "_j.rationale", F.lit("")))).drop("_j")


def valid_trials(trials: DataFrame) -> DataFrame:
    """Trials without those that score 0 and carry no feedback."""
    return trials.where(~((F.col("score") == 0) & filled("feedback").isNull()) | F.col("score").isNull())


def arm_stats(trials: DataFrame, *keys: str) -> DataFrame:
    """Mergeable statistics of each arm's scores: count, sum, least and greatest, by map-side partial results."""
    aggs = []
    for a in ARMS:
        score = F.when(F.col("arm") == a, F.col("score"))
        aggs += [F.count(score).alias(f"{a}_n"), F.sum(score).alias(f"{a}_sum"), F.min(score).alias(f"{a}_least"), F.max(score).alias(f"{a}_most")]
    return trials.groupBy(*keys).agg(*aggs)


def merge_stats(stats: DataFrame, *keys: str) -> DataFrame:
    """Statistics of the union of what the rows of ``arm_stats`` stand for."""
    aggs = []
    for a in ARMS:
        aggs += [F.sum(f"{a}_n").alias(f"{a}_n"), F.sum(f"{a}_sum").alias(f"{a}_sum"), F.min(f"{a}_least").alias(f"{a}_least"), F.max(f"{a}_most").alias(f"{a}_most")]
    return stats.groupBy(*keys).agg(*aggs)


def scores_of_stats(stats: DataFrame, *keys: str) -> DataFrame:
    """Mean, max and min of each arm's scores, rounded, 0 for an empty arm, and the improvement of the mean."""
    value = {"mean": lambda a: F.try_divide(F.col(f"{a}_sum"), F.col(f"{a}_n")), "max": lambda a: F.col(f"{a}_most"), "min": lambda a: F.col(f"{a}_least")}
    cols = [F.coalesce(round2(f(a)), F.lit(0.0)).alias(f"{a}_{s}") for s, f in value.items() for a in ARMS]
    return stats.select(*keys, *cols).withColumn("improvement", round2(F.col("klg_mean") - F.col("no_klg_mean")))


def problem_scores(trials: DataFrame, key: str = "problem_id") -> DataFrame:
    """Mean, max and min of each arm's scores, rounded, 0 for an empty arm, and the improvement of the mean.

    One aggregation with map-side partial results; arms are columns, not rows."""
    return scores_of_stats(arm_stats(trials, key), key)


def summary_sums(scores: DataFrame) -> DataFrame:
    """One row of whole numbers that add up over disjoint sets of problems: problems, hundredths of scores, wins, ties, losses."""
    cols = [F.count("*").alias("total_problems")]
    for s in ("mean", "max", "min"):
        a, b = round2(f"no_klg_{s}"), round2(f"klg_{s}")
        total = lambda c: F.coalesce(F.sum(F.round(c * 100).cast("long")), F.lit(0))
        cols += [
            total(a).alias(f"no_klg_{s}_sum"), total(b).alias(f"klg_{s}_sum"), total(b - a).alias(f"{s}_improvement_sum"),
            F.count_if(b > a).alias(f"{s}_win"), F.count_if(b == a).alias(f"{s}_tie"), F.count_if(b < a).alias(f"{s}_loss"),
        ]
    return scores.agg(*cols)


def summary_of_sums(sums: DataFrame) -> DataFrame:
    """The summary that ``summary_sums`` stands for."""
    cols = [F.col("total_problems")]
    for s in ("mean", "max", "min"):
        mean = lambda c: F.coalesce(round2(F.try_divide(F.col(c) / F.lit(100.0), F.col("total_problems"))), F.lit(0.0))
        cols += [
            mean(f"no_klg_{s}_sum").alias(f"no_klg_{s}_mean"), mean(f"klg_{s}_sum").alias(f"klg_{s}_mean"), mean(f"{s}_improvement_sum").alias(f"{s}_improvement"),
            F.col(f"{s}_win"), F.col(f"{s}_tie"), F.col(f"{s}_loss"),
        ]
    return sums.select(*cols)


def evaluation_summary(scores: DataFrame) -> DataFrame:
    """One row over all problems: means of the rounded pairs, mean improvements, wins, ties and losses."""
    return summary_of_sums(summary_sums(scores))


def score_pairs_of(scores: DataFrame, key: str = "problem_id") -> DataFrame:
    """Rows (statistic, problem, no_klg, klg): the summary's pair lists, one pair a row."""
    return scores.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(f"no_klg_{s}").alias("no_klg"), F.col(f"klg_{s}").alias("klg")) for s in ("mean", "max", "min")])).alias("p")).select(key, "p.*")


def compare_summaries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metric by metric: value in either summary and the difference."""
    long = lambda df, name: df.select(*[F.col(c).cast("double") for c in df.columns]).unpivot([], df.columns, "metric", name)
    return long(a, "baseline").join(long(b, "rerun"), "metric").withColumn("change", F.col("rerun") - F.col("baseline"))


def extract_boxed_answer(c: Column) -> Column:
    """The first integer in a box, as long; null without one."""
    return F.nullif(F.regexp_extract(c, r"\\boxed\{(\d+)\}", 1), F.lit("")).try_cast("long")


def majority_vote(answers: DataFrame, key: str, answer: str, order: str) -> DataFrame:
    """The most frequent non-null answer of each key; of equally frequent ones that seen first."""
    counts = answers.where(F.col(answer).isNotNull()).groupBy(key, answer).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(key).agg(F.max_by(answer, F.struct("n", -F.col("seen"))).alias("vote"), F.max("n").alias("votes"))


def pass_at_1(samples: DataFrame, key: str, code: str, passed: str) -> DataFrame:
    """Per problem: samples, correct ones, share; code without text counts as wrong."""
    ok = F.coalesce(F.col(passed), F.lit(False)) & filled(code).isNotNull()
    return samples.groupBy(key).agg(F.count("*").alias("samples"), F.count_if(ok).alias("correct")).withColumn("pass_at_1", F.col("correct") / F.col("samples"))


def iteration_report(samples: DataFrame, key: str, iteration: str, passed: str, total_problems: Column | int) -> DataFrame:
    """Per iteration: pass@1 over samples, share of tried problems solved once, problems not tried any more."""
    per = samples.groupBy(iteration, key).agg(F.count("*").alias("n"), F.count_if(passed).alias("ok"))
    out = per.groupBy(iteration).agg(
        F.sum("n").alias("samples"), F.sum("ok").alias("correct"), F.count("*").alias("tried"), F.count_if(F.col("ok") > 0).alias("solved")
    )
    total = F.lit(total_problems) if isinstance(total_problems, int) else total_problems
    return out.withColumns({"pass_at_1": F.col("correct") / F.col("samples"), "pass_all": F.col("solved") / F.col("tried"), "already_solved": total - F.col("tried")})


def flatten_attempts(nodes: DataFrame, levels: int | None = None, node: str = "node", parent: str = "parent") -> DataFrame:
    """Leaves of a forest given as rows (node, parent): (root, leaf, path). Roots have a null parent.

    Pointers are doubled: round k joins each node's ancestor 2^k steps up with
    its own, and gives each leaf the ancestors twice as far up, so rounds grow
    with the logarithm of the depth, and each reads only the tables that the
    round before has written. Rows are at most those of all paths. Trees may be
    of any depth, unless ``levels`` is given: then one deeper than so many steps
    is an error, as a circle and a node with two parents always are; leaves
    whose line ends at a parent that is no node are left out."""
    spark = nodes.sparkSession
    path = scratch(spark, "attempts")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    every = written(nodes.select(F.col(node).alias("node"), F.col(parent).alias("up")), "nodes")
    if not every.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a node has several rows")
    jump = every.where("up is not null")
    at = every.join(jump.select(F.col("up").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("leaf"), F.lit(0).cast("long").alias("d"), "node")
    step, k, far = 1, 0, jump.count()
    while far:
        if levels is not None and step > levels:
            raise ValueError(f"the tree is deeper than {levels} levels, or has a circle")
        above = at.join(jump, "node").select("leaf", (F.col("d") + step).alias("d"), F.col("up").alias("node"))
        at = written(at.unionByName(above), f"lines-{k}")
        over = jump.select(F.col("node").alias("up"), F.col("up").alias("_over"))
        jump = written(jump.join(over, "up").select("node", F.col("_over").alias("up")), f"jump-{k}")
        before, far = far, jump.count()
        # the deepest line has nodes whose jump leaves the tree this time; only lines into circles have none
        if far == before:
            raise ValueError("the tree has a circle")
        step, k = step * 2, k + 1
    depth = at.agg(F.max("d")).first()[0]
    if levels is not None and depth is not None and depth > levels:
        raise ValueError(f"the tree is deeper than {levels} levels")
    lines = at.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "node"))), lambda x: x.node).alias("path"))
    return lines.join(every.where("up is null").select(F.col("node").alias("root")), F.col("path")[0] == F.col("root")).select("root", "leaf", "path")


def all_wrong_nodes(samples: DataFrame, node: str, correct: str) -> DataFrame:
    """Nodes with samples of which none is correct."""
    return samples.groupBy(node).agg(F.max(F.coalesce(F.col(correct), F.lit(False))).alias("any"), F.count("*").alias("samples")).where(~F.col("any")).select(node, "samples")


def judge_records(records: DataFrame, force: bool = False) -> DataFrame:
    """Fill correctness (0 or 1), verdict and explanation from ``judgement``, keeping records judged before."""
    fresh = F.lit(force) | F.col("correctness").isNull()
    score = F.when(F.col("judgement.score").try_cast("double") >= 1, 1).otherwise(0)
    return records.withColumns({
        "correctness": F.when(fresh, score).otherwise(F.col("correctness")),
        "verdict": F.when(fresh, F.coalesce(filled("judgement.verdict"), F.lit("uncertain"))).otherwise(F.col("verdict")),
        "explanation": F.when(fresh, F.coalesce(filled("judgement.explanation"), F.lit(""))).otherwise(F.col("explanation")),
    })


def accuracy(records: DataFrame, score: str = "correctness") -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.coalesce(F.avg(score), F.lit(0.0)).alias("accuracy"))


def plan_trials(problems: DataFrame, arms: dict[str, int], prompts: dict[str, list[str]], seed: int = 0, key: str = "problem_id") -> DataFrame:
    """The grid problem x arm x trial with run names and a system prompt drawn from the arm's list."""
    grids = []
    for arm, trials in arms.items():
        grid = problems.select(key, F.lit(arm).alias("arm"), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial")) if trials > 0 else None
        if grid is not None:
            pool = F.array(*[F.lit(p) for p in prompts[arm]])
            pick = F.pmod(seeded_order(seed, key, "arm", "trial"), F.lit(len(prompts[arm]))).cast("int") + 1
            grids.append(grid.withColumn("run_name", F.format_string("%s_" + arm + "_trial_%02d", F.col(key).cast("string"), F.col("trial"))).withColumn("system_prompt", F.element_at(pool, pick)))
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out
