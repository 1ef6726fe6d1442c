"""Evaluation queries on events (trials), lineitem (answers), orders (run cache), labels (judgements)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.functions.folders import scratch
from trialloom.operators import evaluation as ev
from trialloom.plans.base import query, read
from trialloom.sources import runs as src


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored trials; scores are multiples of 0.5."""
    e = read(spark, sf_dir, "events")
    score = F.round(F.least(F.greatest(F.col("value"), F.lit(0.0)) / 10, F.lit(10.0)) * 2) / 2
    return e.select(
        F.col("user_id").alias("problem_id"), F.when(F.col("event_type").isin("click", "view"), "no_klg").otherwise("klg").alias("arm"), F.col("event_id").alias("trial"),
        score.alias("score"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("feedback"),
    )


TRIALS = """trials AS (SELECT user_id AS problem_id, CASE WHEN event_type IN ('click','view') THEN 'no_klg' ELSE 'klg' END AS arm,
  event_id AS trial, round(least(greatest(value, 0.0) / 10, 10.0) * 2) / 2 AS score,
  CASE WHEN event_type <> 'error' THEN event_type END AS feedback FROM events)"""
VALID = f"{TRIALS}, valid AS (SELECT * FROM trials WHERE score IS NULL OR NOT (score = 0 AND coalesce(trim(feedback), '') = ''))"
_STATS = ", ".join(f"coalesce(round({f}(score) FILTER (arm = '{a}'), 2), 0) AS {a}_{s}" for s, f in (("mean", "avg"), ("max", "max"), ("min", "min")) for a in ("no_klg", "klg"))
SCORES = f"{VALID}, scores AS (SELECT problem_id, {_STATS} FROM valid GROUP BY problem_id)"


@query(f"WITH {VALID} SELECT problem_id, arm, count(*) AS n, count(*) FILTER (score = 0) AS zeros FROM valid GROUP BY ALL")
def valid_trials(spark, sf_dir):
    return ev.valid_trials(trials(spark, sf_dir)).groupBy("problem_id", "arm").agg(F.count("*").alias("n"), F.count_if(F.col("score") == 0).alias("zeros"))


@query(f"WITH {SCORES} SELECT *, round(klg_mean - no_klg_mean, 2) AS improvement FROM scores")
def problem_scores(spark, sf_dir):
    return ev.problem_scores(ev.valid_trials(trials(spark, sf_dir)))


_SUMMARY = ", ".join(
    f"""coalesce(round(sum(round(no_klg_{s} * 100)::BIGINT) / 100.0::DOUBLE / count(*), 2), 0) AS no_klg_{s}_mean,
    coalesce(round(sum(round(klg_{s} * 100)::BIGINT) / 100.0::DOUBLE / count(*), 2), 0) AS klg_{s}_mean,
    coalesce(round(sum(round((klg_{s} - no_klg_{s}) * 100)::BIGINT) / 100.0::DOUBLE / count(*), 2), 0) AS {s}_improvement,
    count(*) FILTER (klg_{s} > no_klg_{s}) AS {s}_win, count(*) FILTER (klg_{s} = no_klg_{s}) AS {s}_tie, count(*) FILTER (klg_{s} < no_klg_{s}) AS {s}_loss"""
    for s in ("mean", "max", "min")
)


@query(f"WITH {SCORES} SELECT count(*) AS total_problems, {_SUMMARY} FROM scores")
def evaluation_summary(spark, sf_dir):
    return ev.evaluation_summary(ev.problem_scores(ev.valid_trials(trials(spark, sf_dir))))


@query(f"WITH {SCORES} " + " UNION ALL ".join(f"SELECT problem_id, '{s}' AS statistic, no_klg_{s} AS no_klg, klg_{s} AS klg FROM scores" for s in ("mean", "max", "min")))
def summary_pairs(spark, sf_dir):
    return ev.score_pairs_of(ev.problem_scores(ev.valid_trials(trials(spark, sf_dir))))


@query("""WITH t AS (SELECT user_id, event_id % 2 AS half, CASE WHEN event_type IN ('click','view') THEN 'no_klg' ELSE 'klg' END AS arm,
  round(least(greatest(value, 0.0) / 10, 10.0) * 2) / 2 AS score FROM events),
  s AS (SELECT half, user_id, max(score) FILTER (arm='klg') AS k, max(score) FILTER (arm='no_klg') AS n FROM t GROUP BY ALL),
  m AS (SELECT half, count(*) AS total_problems, count(*) FILTER (coalesce(k,0) > coalesce(n,0)) AS max_win FROM s GROUP BY half),
  u AS (UNPIVOT m ON total_problems, max_win INTO NAME metric VALUE v)
  SELECT a.metric, a.v::DOUBLE AS baseline, b.v::DOUBLE AS rerun, (b.v - a.v)::DOUBLE AS change FROM u a JOIN u b ON a.metric = b.metric AND a.half = 0 AND b.half = 1""")
def compare_summaries(spark, sf_dir):
    half = lambda h: ev.evaluation_summary(ev.problem_scores(trials(spark, sf_dir).where(F.col("trial") % 2 == h))).select("total_problems", "max_win")
    return ev.compare_summaries(half(0), half(1))


@query("""SELECT event_id AS idx, CASE WHEN event_id % 5 = 0 AND event_id <> 0 THEN event_id::VARCHAR
  WHEN event_id % 5 = 1 THEN 'p/' || event_type || '.csv'
  ELSE 'idx_' || lpad(event_id::VARCHAR, 5, '0') || '|' || event_type || '|hp_' || (event_id % 3)::VARCHAR || CASE WHEN event_id % 4 = 0 THEN '' ELSE '|sample_' || (event_id % 4)::VARCHAR END END AS entry_id
  FROM events""")
def entry_ids(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), F.when(F.col("event_id") % 5 == 0, F.col("event_id")).alias("id"), F.when(F.col("event_id") % 5 == 1, F.concat(F.lit("p/"), "event_type", F.lit(".csv"))).alias("CSVPath"),
        F.concat(F.lit(" "), "event_type", F.lit("!? ")).alias("Topic"), (F.col("event_id") % 3).alias("HyperParamIndex"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4).alias("SampleIndex"),
    )
    return ev.entry_id(e, "idx").select("idx", "entry_id")


@query("SELECT user_id::VARCHAR AS entry_id, min(event_id) AS idx FROM events GROUP BY user_id")
def dataset_index_map(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entry_id"), F.col("event_id").alias("idx"))
    return ev.dataset_index_map(e)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) ORDER BY o_orderkey LIMIT 500")
def pending_entries(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return ev.pending(read(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey", "o_orderkey", 500)


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_records(spark, sf_dir):
    return ev.first_records(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


_MERGED = """WITH a AS (SELECT o_custkey, o_orderpriority, max((o_orderdate, o_orderkey)) FILTER (o_orderkey % 2 = 0) AS old, max((o_orderdate, o_orderkey)) FILTER (o_orderkey % 2 = 1) AS new FROM orders GROUP BY ALL)
  SELECT o_custkey, o_orderpriority, CASE WHEN old IS NULL OR new[1] >= old[1] THEN new[1] ELSE old[1] END AS saved_at FROM a""".replace("new[1]", "new.o_orderdate").replace("old[1]", "old.o_orderdate").replace("max((o_orderdate, o_orderkey))", "max({'o_orderdate': o_orderdate, 'o_orderkey': o_orderkey})")


@query(_MERGED)
def run_cache_merge(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderdate").alias("saved_at"), "o_totalprice", "o_orderkey")
    keys = ["o_custkey", "o_orderpriority"]
    merged = ev.run_cache_merge(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), keys, ["o_totalprice", "o_orderkey"])
    return merged.select(*keys, "saved_at")


@query(_MERGED)
def run_cache_store(spark, sf_dir):
    """The same through a stored cache that is merged into."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderdate").alias("saved_at"), "o_totalprice", "o_orderkey")
    keys, payload = ["o_custkey", "o_orderpriority"], ["o_totalprice", "o_orderkey"]
    schema = ", ".join(f"{c} {dict(o.dtypes)[c]}" for c in (*keys, *payload, "saved_at"))
    store = src.run_cache_store(spark, scratch(spark, "cache"), keys, schema, 8)
    for half in (0, 1):
        src.merge_run_cache(store, o.where(F.col("o_orderkey") % 2 == half), payload)
    return store.read().select(*keys, "saved_at")


@query("""WITH d AS (SELECT 'run-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad(o_orderkey::VARCHAR, 8, '0') AS name, o_orderkey AS k FROM orders)
  SELECT k AS o_orderkey, CASE WHEN k % 5 < 3 THEN name ELSE lpad(k::VARCHAR, 8, 'x') || '-unknown' END AS run_dir FROM d""")
def resolve_run_dir(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("name"))
    o = o.withColumn("meta_run_id", F.when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("meta_"), "o_orderkey")))
    case = F.col("o_orderkey") % 5
    wanted = o.select(
        "o_orderkey",
        F.when(case == 0, F.col("name")).when(case == 1, F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("-rest-of-id"))).when(case == 2, F.col("meta_run_id"))
        .otherwise(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "x"), F.lit("-unknown"))).alias("run_id"),
    )
    return ev.resolve_run_dir(wanted, o.select("name", "meta_run_id")).select("o_orderkey", "run_dir")


@query("""SELECT item_id, '<QUESTION>' || chr(10) || trim(text, ' '||chr(10)||chr(9)) || chr(10) || '</QUESTION>' || chr(10) || chr(10) || '<REFERENCE ANSWER>' || chr(10) || item_id::VARCHAR || chr(10) || '</REFERENCE ANSWER>'
  || CASE WHEN item_id % 2 = 0 THEN chr(10) || chr(10) || '<MODEL ANSWER>' || chr(10) || 'a' || item_id::VARCHAR || chr(10) || '</MODEL ANSWER>' ELSE '' END AS prompt FROM benchmark""")
def judge_prompts(spark, sf_dir):
    answer = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("a"), "item_id")).otherwise(F.lit("  "))
    return read(spark, sf_dir, "benchmark").select("item_id", ev.judge_prompt(F.col("text"), F.col("item_id").cast("string"), answer).alias("prompt"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0.0 ELSE least(greatest(round(value - 5), 0), 10) + 0.0 END::DOUBLE AS score,
  CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'why ' || event_type WHEN 2 THEN event_type ELSE '' END AS feedback FROM events""")
def parse_judgement(spark, sf_dir):
    score = F.round(F.col("value") - 5).cast("long")
    case, kind = F.col("event_id") % 4, F.col("event_type")
    response = (
        F.when(case == 0, F.format_string('{"score": %d, "feedback": " %s "}', score, kind))
        .when(case == 1, F.format_string('```json\n{"score": "%d", "rationale": "why %s"}\n```', score, kind))
        .when(case == 2, F.format_string('I think: {"score": %d, "feedback": "%s", "x": {"y": 1}} is fair.', score, kind))
        .otherwise(F.concat(F.lit("no json "), kind))
    )
    return ev.parse_judgement(read(spark, sf_dir, "events").select("event_id", response.alias("response"))).select("event_id", "score", "feedback")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey END AS answer, coalesce(l_linenumber % 3 <> 0 AND l_partkey % 2 = 0, false) AS even FROM lineitem")
def extract_boxed_answer(spark, sf_dir):
    text = F.when(F.col("l_linenumber") % 3 == 0, F.lit(r"so \boxed{x} it is")).otherwise(F.concat(F.lit(r"so \boxed{"), "l_partkey", F.lit(r"} not \boxed{7}")))
    answer = ev.extract_boxed_answer(text)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", answer.alias("answer"), F.coalesce(answer % 2 == 0, F.lit(False)).alias("even"))


@query("""WITH c AS (SELECT l_partkey, l_linenumber AS a, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS seen FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL),
  v AS (SELECT l_partkey, a AS vote, n AS votes, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, seen) AS r FROM c)
  SELECT l_partkey, vote, votes, vote = p_size % 7 + 1 AS is_right FROM v JOIN part ON l_partkey = p_partkey WHERE r = 1""")
def majority_vote(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("a"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"))  # noqa: E741
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return ev.majority_vote(l, "l_partkey", "a", "seen").join(part, "l_partkey").select("l_partkey", "vote", "votes", (F.col("vote") == F.col("p_size") % 7 + 1).alias("is_right"))


@query("""SELECT l_orderkey, count(*) AS samples, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') AS correct, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') / count(*)::DOUBLE AS pass_at_1 FROM lineitem GROUP BY l_orderkey""")
def pass_at_1(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("code"), (F.col("l_linestatus") == "F").alias("ok"))  # noqa: E741
    return ev.pass_at_1(l, "l_orderkey", "code", "ok")


@query("""WITH p AS (SELECT l_linenumber AS iteration, l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS ok FROM lineitem GROUP BY ALL)
  SELECT iteration, sum(n)::BIGINT AS samples, sum(ok)::BIGINT AS correct, count(*) AS tried, count(*) FILTER (ok > 0) AS solved, sum(ok) / sum(n)::DOUBLE AS pass_at_1,
  count(*) FILTER (ok > 0) / count(*)::DOUBLE AS pass_all, (SELECT count(*) FROM part) - count(*) AS already_solved FROM p GROUP BY iteration""")
def iteration_report(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("iteration"), "l_partkey", (F.col("l_returnflag") == "R").alias("ok"))  # noqa: E741
    return ev.iteration_report(l, "l_partkey", "iteration", "ok", read(spark, sf_dir, "part").count())


_TREE = "n AS (SELECT event_id AS node, CASE WHEN event_id > 20 THEN event_id // 8 END AS parent FROM events)"


@query(f"""WITH RECURSIVE {_TREE}, t AS (SELECT node AS root, node AS leaf, 1 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT root, n.node, depth + 1 FROM t JOIN n ON n.parent = t.leaf)
  SELECT root, leaf, depth FROM t WHERE leaf NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL)""")
def flatten_attempts(spark, sf_dir):
    n = read(spark, sf_dir, "events").select(F.col("event_id").alias("node"), F.when(F.col("event_id") > 20, F.floor(F.col("event_id") / 8)).alias("parent"))
    return ev.flatten_attempts(n).select("root", "leaf", F.size("path").alias("depth"))


@query("SELECT l_partkey, count(*) AS samples FROM lineitem GROUP BY l_partkey HAVING NOT bool_or(l_quantity > 45)")
def all_wrong_nodes(spark, sf_dir):
    return ev.all_wrong_nodes(read(spark, sf_dir, "lineitem").withColumn("ok", F.col("l_quantity") > 45), "l_partkey", "ok")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 WHEN quality = 1 THEN 1 ELSE 0 END AS correctness, CASE WHEN doc_id % 3 = 0 THEN 'old' WHEN toxic = 1 THEN 'hard' ELSE 'uncertain' END AS verdict FROM labels""")
def judge_records(spark, sf_dir):
    r = read(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, 1).alias("correctness"), F.when(F.col("doc_id") % 3 == 0, "old").alias("verdict"), F.lit(None).cast("string").alias("explanation"),
        F.struct(F.col("quality").cast("string").alias("score"), F.when(F.col("toxic") == 1, "hard").otherwise(" ").alias("verdict"), F.lit(None).cast("string").alias("explanation")).alias("judgement"),
    )
    return ev.judge_records(r).select("doc_id", "correctness", "verdict")


@query("SELECT count(*) AS records, avg(quality) AS accuracy FROM labels")
def judged_accuracy(spark, sf_dir):
    return ev.accuracy(read(spark, sf_dir, "labels"), "quality")


@query("""SELECT item_id AS problem_id, arm, t.trial::INTEGER AS trial, item_id::VARCHAR || '_' || arm || '_trial_' || lpad(t.trial::VARCHAR, 2, '0') AS run_name
  FROM benchmark, (VALUES ('no_klg', 3), ('klg', 7)) a(arm, n), generate_series(1, 7) t(trial) WHERE t.trial <= n""")
def plan_trials(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("problem_id"))
    return ev.plan_trials(b, {"no_klg": 3, "klg": 7}, {"no_klg": ["Solve it.", "Think first."], "klg": ["Use what you know."]}).drop("system_prompt")


@query("""WITH g AS (SELECT item_id, s::INTEGER AS sample, item_id || '::2::' || s || '::rerun' AS key FROM benchmark, generate_series(0, 2) t(s)),
  c AS (SELECT event_id % 50 || '::2::' || event_id % 4 || '::rerun' AS key, max(event_id) AS e FROM events WHERE event_id % 3 = 0 GROUP BY 1)
  SELECT item_id, sample, key, 'klg_optim_e2_i' || item_id || '_s' || sample || '_rerun' AS run_name, e IS NOT NULL AS cached, 'o' || e AS output, CASE WHEN e % 2 = 0 THEN 1.5 WHEN e IS NOT NULL THEN 0 END::DOUBLE AS score FROM g LEFT JOIN c USING (key)""")
def plan_epoch(spark, sf_dir):
    c = read(spark, sf_dir, "events").where("event_id % 3 = 0").select("event_id", (F.col("event_id") % 50).alias("i"), F.lit(2).alias("e"), (F.col("event_id") % 4).alias("s"))
    c = c.groupBy(ev.epoch_run_key("i", "e", "s", "rerun").alias("key")).agg(F.max("event_id").alias("n"))
    cache = c.select("key", F.concat(F.lit("o"), "n").alias("output"), F.when(F.col("n") % 2 == 0, 1.5).alias("score"), F.lit("f").alias("feedback"))
    out = ev.plan_epoch(read(spark, sf_dir, "benchmark").select("item_id"), 2, 3, cache, "rerun", "item_id")
    return out.select("item_id", "sample", "key", "run_name", "cached", "output", "score")
