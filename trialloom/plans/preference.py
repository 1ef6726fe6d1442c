"""Preference queries: lineitem gives score groups, conversations messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialloom.operators import preference as pr
from trialloom.operators.retrieval import top_k_keys
from trialloom.plans.base import query, read
from trialloom.plans.knowledge import _TOP, _scored


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as scored group members; scores are quantities over 5."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), (F.row_number().over(w) - 1).alias("idx"), (F.col("l_quantity") / 5).alias("score"))


GROUPS = """g AS (SELECT l_orderkey AS "group", (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INTEGER AS idx, l_quantity / 5 AS score FROM lineitem)"""
PAIRS = f"""{GROUPS}, p AS (SELECT a."group", a.idx AS i, b.idx AS j, CASE WHEN a.score > b.score THEN a.idx ELSE b.idx END AS winner, CASE WHEN a.score > b.score THEN b.idx ELSE a.idx END AS loser
  FROM g a JOIN g b ON a."group" = b."group" AND a.idx < b.idx AND abs(a.score - b.score) > 0.5)"""


@query(f"WITH {PAIRS} SELECT * FROM p")
def comparison_pairs(spark, sf_dir):
    return pr.comparison_pairs(groups(spark, sf_dir))


@query(f"""WITH {GROUPS}, given AS (SELECT "group", idx AS winner, idx + 1 AS loser FROM g WHERE idx % 2 = 0),
  kept AS (SELECT * FROM given WHERE ("group", loser) IN (SELECT "group", idx FROM g)),
  made AS (SELECT a."group", CASE WHEN a.score > b.score THEN a.idx ELSE b.idx END AS winner, CASE WHEN a.score > b.score THEN b.idx ELSE a.idx END AS loser FROM g a JOIN g b ON a."group" = b."group" AND a.idx < b.idx AND a.score <> b.score)
  SELECT *, true AS given FROM kept UNION ALL SELECT *, false FROM made WHERE ("group", winner, loser) NOT IN (SELECT * FROM kept)""")
def merge_pairs(spark, sf_dir):
    g = groups(spark, sf_dir)
    return pr.merge_pairs(g.where("idx % 2 = 0").select("group", F.col("idx").alias("winner"), (F.col("idx") + 1).alias("loser")), g)


@query(f"""WITH {GROUPS}, b AS (SELECT "group", idx, score, max({{'s': score, 'o': -idx}}) OVER (PARTITION BY "group" ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM g)
  SELECT "group", CASE WHEN score > best.s THEN idx ELSE -best.o END AS winner, CASE WHEN score > best.s THEN -best.o ELSE idx END AS loser FROM b WHERE best IS NOT NULL AND score <> best.s""")
def running_best_pairs(spark, sf_dir):
    return pr.running_best_pairs(groups(spark, sf_dir), "group", "idx", "score")


@query(f"""WITH {GROUPS} SELECT e."group", e.idx, e.idx >= 4 AS extra, CASE WHEN e.idx >= 4 THEN 0.0 WHEN s.idx % 3 = 0 THEN s.score END AS score FROM g e LEFT JOIN g s USING ("group", idx)""")
def prepare_scores(spark, sf_dir):
    g = groups(spark, sf_dir)
    return pr.prepare_scores(g.select("group", "idx", (F.col("idx") >= 4).alias("extra")), g.where("idx % 3 = 0"), "group", "idx", "extra")


_GROUPED = """t AS (SELECT user_id, event_id, value AS score FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
  m AS (SELECT DISTINCT user_id AS problem_id, user_id FROM events WHERE user_id % 7 <> 0),
  h AS (SELECT m.problem_id, t.event_id, 'r' || t.event_id AS run_id, score, CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE event_id % 4 END AS n_steps, CASE WHEN event_id % 3 = 0 THEN 'cache' ELSE 'files' END AS source
    FROM t JOIN m USING (user_id) WHERE event_id % 3 = 0 OR event_id % 2 = 0),
  gt AS (SELECT problem_id, (row_number() OVER (PARTITION BY problem_id ORDER BY event_id) - 1)::INTEGER AS idx, run_id, score, n_steps, source FROM h)"""


def _grouped(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    run = F.concat(F.lit("r"), "event_id").alias("run_id")
    t = e.where(F.col("event_type").isin("purchase", "signup", "error")).select(F.col("user_id").cast("string").alias("entry_id"), F.col("event_id").alias("trial"), run, F.col("value").alias("score"))
    index = e.where("user_id % 7 <> 0").select(F.col("user_id").cast("string").alias("entry_id"), F.col("user_id").alias("idx")).distinct()
    cache = e.where("event_id % 3 = 0").select(run, (F.col("event_id") % 5).alias("n_steps"))
    files = e.where("event_id % 2 = 0").select(run, (F.col("event_id") % 4).alias("n_steps"))
    return pr.group_trials(t, index, cache, files)


@query(f"WITH {_GROUPED} SELECT * FROM gt")
def group_trials(spark, sf_dir):
    return _grouped(spark, sf_dir)


@query(f"""WITH {_GROUPED}, p AS (SELECT a.problem_id, list([CASE WHEN a.score > b.score THEN a.idx ELSE b.idx END, CASE WHEN a.score > b.score THEN b.idx ELSE a.idx END] ORDER BY a.idx, b.idx) AS c
    FROM gt a JOIN gt b ON a.problem_id = b.problem_id AND a.idx < b.idx AND abs(a.score - b.score) > 0.5 GROUP BY 1),
  ms AS (SELECT problem_id, list(run_id ORDER BY idx) AS runs, list(score ORDER BY idx) AS scores FROM gt GROUP BY 1)
  SELECT problem_id, runs, scores, coalesce(c, []) AS comparison FROM ms LEFT JOIN p USING (problem_id)""")
def converted_groups(spark, sf_dir):
    g = _grouped(spark, sf_dir)
    nested = pr.nested_groups(g, pr.comparison_pairs(g, "problem_id"))
    return nested.select("problem_id", F.transform("messages", lambda m: m.run_id).alias("runs"), "scores", "comparison")


#: Half of the table is one problem.
_BATCH = """i AS (SELECT CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE l_partkey % 50 END AS problem, l_orderkey AS msg, l_linenumber AS step FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY problem, msg ORDER BY md5(concat_ws(':', 1, problem, msg, step)), step) AS round FROM i),
  o AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY round, md5(concat_ws(':', 2, problem, msg)), msg, step) - 1 AS rn, count(*) OVER (PARTITION BY problem) AS n FROM r),
  b AS (SELECT problem, rn // 10 AS batch, rn % 10 AS slot, msg, step, false AS "repeat" FROM o
    UNION ALL SELECT problem, (n + rn + k * n) // 10, (n + rn + k * n) % 10, msg, step, true FROM o, range(10) x(k) WHERE rn + k * n < (10 - n % 10) % 10)"""


def _batches(spark, sf_dir):
    problem = F.when(F.col("l_partkey") % 2 == 0, 0).otherwise(F.col("l_partkey") % 50).alias("problem")
    items = read(spark, sf_dir, "lineitem").select(problem, F.col("l_orderkey").alias("msg"), F.col("l_linenumber").alias("step"))
    return pr.balanced_batches(items, "problem", "msg", "step", 10, seed=1)


@query(f"WITH {_BATCH} SELECT * FROM b")
def balanced_batches(spark, sf_dir):
    return _batches(spark, sf_dir)


@query(f"WITH {_BATCH} SELECT problem, batch, msg, list(slot ORDER BY slot) AS slots FROM b GROUP BY 1, 2, 3")
def batch_groups(spark, sf_dir):
    return pr.batch_groups(_batches(spark, sf_dir), "problem", "msg")


@query("SELECT split, n FROM (SELECT 'train' AS split, floor(count(*) * 0.9)::BIGINT AS n FROM orders UNION ALL SELECT 'test', count(*) - floor(count(*) * 0.9)::BIGINT FROM orders)")
def train_test_split(spark, sf_dir):
    return pr.train_test_split(read(spark, sf_dir, "orders").select("o_orderkey"), 0.1, 42, "o_orderkey").groupBy("split").agg(F.countDistinct("o_orderkey").alias("n"))


@query("SELECT (greatest(8, (greatest(1, floor(count(*) * 0.05))::BIGINT // 8) * 8))::BIGINT AS n FROM orders")
def subsample(spark, sf_dir):
    return pr.subsample(read(spark, sf_dir, "orders").select("o_orderkey"), 0.05, 3, "o_orderkey", multiple=8).agg(F.countDistinct("o_orderkey").alias("n"))


@query("SELECT avg(length(text)) AS average_chars FROM conversations")
def average_prompt_chars(spark, sf_dir):
    return pr.average_prompt_chars(read(spark, sf_dir, "conversations"), "text")


@query("""WITH r AS (SELECT event_id, event_id % 40 AS a, (event_id + 1) % 45 AS b, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS c FROM events)
  SELECT event_id AS result_id, CASE WHEN c = 1 THEN a ELSE b END AS chosen_id, CASE WHEN c = 1 THEN b ELSE a END AS rejected_id FROM r WHERE c IN (1, 2) AND a IN (SELECT item_id FROM benchmark) AND b IN (SELECT item_id FROM benchmark)""")
def preference_from_judge(spark, sf_dir):
    case = F.col("event_id") % 5
    output = F.when(case == 0, "better: <ID> 1 </ID> 9").when(case == 1, "I take 2").when(case == 2, "1 or so I guess, no: 2.").when(case == 3, "<ID>3</ID>").otherwise("none at all, see?")
    r = read(spark, sf_dir, "events").select(F.col("event_id").alias("result_id"), F.lit("q").alias("question"), F.array(F.col("event_id") % 40, (F.col("event_id") + 1) % 45).alias("sentence_ids"), output.alias("output"))
    s = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sentence_id"), F.col("text").alias("sentence"))
    return pr.preference_from_judge(r, s).select("result_id", "chosen_id", "rejected_id")


@query(f"""WITH {_TOP} SELECT b.item_id, d.doc_id, '<query>' || chr(10) || trim(b.text, ' '||chr(10)||chr(9)) || chr(10) || '</query>' || chr(10)||chr(10)||chr(10) || '<key>' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '[missing knowledge text]' ELSE 'doc ' || doc_id END || chr(10)
  || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Tags: ' || source || chr(10) END || '</key>' || chr(10)||chr(10)||chr(10) || 'Query-Key Relevance Score:' AS prompt FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.key_id WHERE rank <= 20""")
def rank_prompts(spark, sf_dir):
    """Prompts of each query with its 20 best keys over all documents."""
    best = top_k_keys(_scored(spark, sf_dir), 20).select(F.col("query_id").alias("item_id"), F.col("key_id").alias("doc_id"))
    pairs = best.join(read(spark, sf_dir, "benchmark"), "item_id").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    key = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" doc "), "doc_id"))
    tags = F.when(F.col("doc_id") % 5 != 0, F.array(F.lit(" "), F.col("source")))
    return pairs.select("item_id", "doc_id", pr.rank_prompt(F.col("text"), key, tags).alias("prompt"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'plain ' || doc_id ELSE 'q' || doc_id END AS query, CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'k ' || source END AS key, CASE WHEN doc_id % 4 = 1 THEN ['a', lang] ELSE [] END AS tags FROM documents""")
def split_prompt(spark, sf_dir):
    case = F.col("doc_id") % 4
    prompt = F.when(case == 3, F.concat(F.lit(" plain "), "doc_id")).otherwise(
        F.concat(F.lit("<query>\nq"), "doc_id", F.lit("\n</query>\n\n<key>\nk "), "source", F.when(case == 1, F.concat(F.lit("\ntags: a,, "), "lang")).otherwise(F.lit("")), F.lit("\n</key>\nscore"))
    )
    return pr.split_prompt(read(spark, sf_dir, "documents").select("doc_id", prompt.alias("p")), "p").drop("p")


@query("SELECT event_id, round_even(least(greatest(value / 7, 0), 10), 0) AS reward FROM events")
def reward_score(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", pr.reward_score(F.col("value") / 7).alias("reward"))


@query(f"""WITH {GROUPS}, r AS (SELECT *, CASE WHEN idx % 4 <> 3 THEN score END AS reward FROM g), s AS (SELECT "group", avg(reward) AS m, var_pop(reward) AS v, count(reward) AS n FROM r GROUP BY 1)
  SELECT "group", idx, round(CASE WHEN reward IS NULL OR n < 2 THEN 0 ELSE (reward - m) / sqrt(v + 1e-8) END, 5) + 0.0 AS advantage FROM r JOIN s USING ("group")""")
def group_advantage(spark, sf_dir):
    g = groups(spark, sf_dir).withColumn("reward", F.when(F.col("idx") % 4 != 3, F.col("score")))
    return pr.group_advantage(g, "group", "reward").select("group", "idx", (F.round("advantage", 5) + 0.0).alias("advantage"))


@query(f"""WITH {PAIRS}, d AS (SELECT p."group", (c.score - r.score) * (CASE WHEN p."group" % 3 = 0 THEN -1 ELSE 1 END) AS d FROM p JOIN g c ON c."group" = p."group" AND c.idx = winner JOIN g r ON r."group" = p."group" AND r.idx = loser),
  l AS (SELECT "group", avg(ln(1 + exp(-abs(d))) + greatest(-d, 0)) AS l, count(*) FILTER (d > 0) AS ok, count(*) AS n FROM d GROUP BY 1)
  SELECT round(avg(coalesce(l, 0)), 6) AS loss, sum(ok) / sum(n)::DOUBLE AS accuracy, sum(n)::BIGINT AS pairs FROM (SELECT DISTINCT "group" FROM g) LEFT JOIN l USING ("group")""")
def pair_loss_accuracy(spark, sf_dir):
    g = groups(spark, sf_dir)
    reward = g.select("group", "idx", (F.col("score") * F.when(F.col("group") % 3 == 0, -1).otherwise(1)).alias("reward"))
    return pr.pair_loss_accuracy(g, pr.comparison_pairs(g), reward).withColumn("loss", F.round("loss", 6))


@query(f"""WITH {GROUPS}, r AS (SELECT *, CASE WHEN "group" % 5 <> 0 OR idx <> 1 THEN score END AS s FROM g), m AS (SELECT "group", max(s) AS x, count(s) = count(*) AS ok FROM r GROUP BY 1), z AS (SELECT "group", sum(exp(s - x)) AS z FROM r JOIN m USING ("group") GROUP BY 1)
  SELECT "group", idx, round(CASE WHEN ok THEN s - x - ln(z) ELSE 0 END, 6) + 0.0 AS log_p FROM r JOIN m USING ("group") JOIN z USING ("group")""")
def group_log_softmax(spark, sf_dir):
    g = groups(spark, sf_dir).withColumn("score", F.when((F.col("group") % 5 != 0) | (F.col("idx") != 1), F.col("score")))
    return pr.group_log_softmax(g, "group", "score").select("group", "idx", (F.round("log_p", 6) + 0.0).alias("log_p"))


@query(f"""WITH {GROUPS}, r AS (SELECT "group", score AS s, CASE WHEN "group" % 4 <> 0 THEN idx / 2.0 END AS q FROM g), m AS (SELECT "group", max(s) AS x, max(q) AS y FROM r GROUP BY 1), z AS (SELECT "group", sum(exp(s - x)) AS a, sum(exp(q - y)) AS b FROM r JOIN m USING ("group") GROUP BY 1),
  k AS (SELECT "group", sum(exp(s - x - ln(a)) * ((s - x - ln(a)) - (q - y - ln(b)))) AS kl FROM r JOIN m USING ("group") JOIN z USING ("group") WHERE "group" % 4 <> 0 GROUP BY 1) SELECT round(avg(kl), 6) AS kl, count(*) AS groups FROM k""")
def group_kl(spark, sf_dir):
    g = groups(spark, sf_dir).withColumn("q", F.when(F.col("group") % 4 != 0, F.col("idx") / 2.0))
    return pr.group_kl(g, "group", "score", "q").withColumn("kl", F.round("kl", 6))
