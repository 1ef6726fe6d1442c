"""Message queries on conversations, in which the assistant stands for the agent where steps are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.functions import text as tx
from trialloom.operators import conversion as cv
from trialloom.operators import messages as ms
from trialloom.plans.base import query, read

AGENT = ("assistant",)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


M = "m AS (SELECT conv_id AS run_id, turn AS seq, role, text AS content FROM conversations)"
STEPS = f"""{M}, s AS (SELECT *, role = 'assistant' AS is_agent, count(*) FILTER (role = 'assistant') OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto,
  count(*) FILTER (role = 'assistant') OVER (PARTITION BY run_id) AS n_steps FROM m)"""
_WS = "' ' || chr(10) || chr(9) || chr(13)"


@query(f"WITH {M} SELECT run_id, seq, role FROM m WHERE role <> 'assistant'")
def normalize_messages(spark, sf_dir):
    return ms.normalize_messages(messages(spark, sf_dir)).select("run_id", "seq", "role")


@query(f"WITH {STEPS} SELECT run_id, seq, is_agent, CASE WHEN is_agent THEN upto END AS agent_step, n_steps FROM s")
def with_agent_step(spark, sf_dir):
    return ms.with_agent_step(messages(spark, sf_dir), AGENT).select("run_id", "seq", "is_agent", "agent_step", "n_steps")


@query(f"WITH {STEPS} SELECT run_id, seq FROM s WHERE upto - is_agent::INTEGER < 2")
def prefix_through_step(spark, sf_dir):
    return ms.prefix_through_step(messages(spark, sf_dir), 2, AGENT).select("run_id", "seq")


@query(f"WITH {STEPS} SELECT run_id, seq FROM s WHERE upto <= 1")
def prefix_before_step(spark, sf_dir):
    return ms.prefix_before_step(messages(spark, sf_dir), 2, AGENT).select("run_id", "seq")


@query(f"WITH {STEPS} SELECT run_id, seq FROM s WHERE NOT (is_agent AND upto = n_steps)")
def strip_last_agent(spark, sf_dir):
    return ms.strip_last_agent(messages(spark, sf_dir), AGENT).select("run_id", "seq")


@query(f"WITH {M} SELECT run_id, seq, role, CASE WHEN seq % 3 = 0 THEN '' ELSE content END AS content, CASE WHEN seq % 2 = 0 THEN 'n' || seq END AS name, NULL::VARCHAR AS knowledge FROM m WHERE seq % 5 <> 4")
def strip_fields(spark, sf_dir):
    m = messages(spark, sf_dir).withColumns({
        "role": F.when(F.col("seq") % 5 != 4, F.col("role")), "content": F.when(F.col("seq") % 3 != 0, F.col("content")),
        "name": F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" n"), "seq")).otherwise(" "),
    })
    return ms.strip_fields(m)


@query(f"WITH {M} SELECT run_id, CASE WHEN seq % 4 = 3 THEN 'user' ELSE role END AS role, count(*) AS n FROM m GROUP BY ALL")
def role_counts(spark, sf_dir):
    return ms.role_counts(messages(spark, sf_dir).withColumn("role", F.when(F.col("seq") % 4 != 3, F.upper("role"))))


def _mixed(spark, sf_dir):
    """Every fourth message comes from an agent."""
    return messages(spark, sf_dir).withColumn("role", F.when(F.col("seq") % 4 == 3, "agent").otherwise(F.col("role")))


@query(f"""WITH {M}, x AS (SELECT run_id, seq, CASE WHEN seq % 4 = 3 THEN 'agent' ELSE role END AS role, content FROM m),
  b AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS block, max(seq) FILTER (role = 'user') OVER (PARTITION BY run_id) AS last_user FROM x),
  a AS (SELECT run_id, string_agg('<AGENT OUTPUT STEP ' || i || '>' || content || '</AGENT OUTPUT STEP ' || i || '>', chr(10)||chr(10) ORDER BY seq) AS late FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM b WHERE role = 'agent' AND seq > last_user) GROUP BY run_id),
  u AS (SELECT run_id, block, string_agg('<' || CASE WHEN role = 'system' THEN 'USER_SYSTEM' ELSE 'USER' END || '>' || content || '</' || CASE WHEN role = 'system' THEN 'USER_SYSTEM' ELSE 'USER' END || '>', chr(10)||chr(10) ORDER BY seq) AS content FROM b WHERE role NOT IN ('agent', 'assistant') GROUP BY ALL),
  t AS (SELECT u.run_id, u.block * 2 + 1 AS k, 'user' AS role, CASE WHEN u.block = max(u.block) OVER (PARTITION BY u.run_id) AND late IS NOT NULL THEN u.content || chr(10)||chr(10) || late ELSE u.content END AS content FROM u LEFT JOIN a USING (run_id)
    UNION ALL SELECT run_id, block * 2, 'assistant', content FROM b WHERE role = 'assistant'
    UNION ALL SELECT a.run_id, 1000000, 'user', late FROM a WHERE run_id NOT IN (SELECT run_id FROM u))
  SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY k) - 1)::INTEGER AS pos, role, content FROM t""")
def flatten_conversation(spark, sf_dir):
    return ms.flatten_conversation(_mixed(spark, sf_dir)).drop("name")


@query(f"""WITH {STEPS}, p AS (SELECT run_id, upto AS step, content, CASE WHEN upto % 2 = 1 THEN upto || ': note ' || upto || chr(10) || 'rule' ELSE '' END AS used FROM s WHERE is_agent),
  b AS (SELECT run_id, string_agg('<STEP ' || step || '>' || chr(10) || '<AGENT OUTPUT>' || chr(10) || content || chr(10) || '</AGENT OUTPUT>' || chr(10) || '<USED KNOWLEDGE>' || chr(10) || used || chr(10) || '</USED KNOWLEDGE>' || chr(10) || '</STEP ' || step || '>', chr(10) ORDER BY step) AS body FROM p GROUP BY 1)
  SELECT r.run_id, '<REASONING HISTORY>' || chr(10) || coalesce(body || chr(10), '') || '</REASONING HISTORY>' AS history FROM (SELECT DISTINCT run_id FROM m) r LEFT JOIN b USING (run_id)""")
def format_reasoning_history(spark, sf_dir):
    m = messages(spark, sf_dir)
    step = ms.with_agent_step(m, AGENT).where("is_agent and agent_step % 2 = 1").select("run_id", F.col("agent_step").alias("step"))
    notes = step.select("run_id", "step", F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.col("step").cast("string").alias("id"), F.concat(F.lit("note "), "step").alias("text")), F.struct(F.lit(2).alias("ord"), F.lit("").alias("id"), F.lit(" rule ").alias("text")))).alias("k")).select("run_id", "step", "k.*")
    return ms.format_reasoning_history(m, notes, AGENT)


@query(f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r, trim(content, {_WS}) AS c FROM m),
  l AS (SELECT run_id, seq, upper(role[1]) || role[2:] || ': ' || CASE WHEN length(c) > 400 THEN rtrim(c[:400], {_WS}) || '...' ELSE c END AS line FROM r WHERE r <= 8 AND role <> 'system'),
  c AS (SELECT run_id, string_agg(line, chr(10) ORDER BY seq) AS conversation FROM l GROUP BY 1), f AS (SELECT run_id, arg_max(content, seq) AS focus FROM m WHERE role = 'user' AND content <> '' GROUP BY 1)
  SELECT run_id, coalesce(conversation, '') AS conversation, coalesce(focus, conversation, '') AS focus FROM (SELECT DISTINCT run_id FROM m) LEFT JOIN c USING (run_id) LEFT JOIN f USING (run_id)""")
def recent_conversation(spark, sf_dir):
    return ms.recent_conversation(messages(spark, sf_dir))


@query(f"""WITH {STEPS}, f AS (SELECT run_id, arg_max(content, seq) AS focus FROM m WHERE role = 'user' GROUP BY 1),
  t AS (SELECT run_id, upto, trim(content, {_WS}) AS c FROM s WHERE is_agent AND upto > n_steps - 4),
  a AS (SELECT run_id, string_agg('step' || upto || chr(10) || CASE WHEN length(c) > 800 THEN rtrim(c[:800], {_WS}) || '...' ELSE c END, chr(10)||chr(10) ORDER BY upto) FILTER (c <> '') AS findings,
    string_agg('step' || upto || chr(10) || '- cue ' || upto, chr(10)||chr(10) ORDER BY upto) AS cues FROM t GROUP BY 1)
  SELECT r.run_id, '<query>' || chr(10) || 'User query:' || chr(10) || trim(focus, {_WS}) || coalesce(chr(10)||chr(10) || 'Recent agent findings:' || chr(10) || findings, '') || coalesce(chr(10)||chr(10) || 'Selected knowledge cues:' || chr(10) || cues, '') || chr(10) || '</query>' AS query
  FROM (SELECT DISTINCT run_id FROM m) r JOIN f USING (run_id) LEFT JOIN a USING (run_id)""")
def build_query_block(spark, sf_dir):
    m = messages(spark, sf_dir)
    runs = m.where("role = 'user'").select("run_id").distinct()
    cues = ms.with_agent_step(m, AGENT).where("is_agent").select("run_id", F.col("agent_step").alias("step"), F.lit(1).alias("ord"), F.concat(F.lit("cue "), "agent_step").alias("text"))
    return ms.build_query_block(m.join(runs, "run_id", "left_semi"), cues, AGENT, training=True)


@query(f"""WITH {M}, x AS (SELECT *, (SELECT arg_min(b.content, b.seq) FROM m b WHERE b.run_id = a.run_id AND b.seq > a.seq AND b.role = 'assistant' AND trim(b.content, {_WS}) <> '') AS reply FROM m a WHERE role = 'user' AND trim(content, {_WS}) <> ''),
  y AS (SELECT run_id, trim(arg_max(content, seq), {_WS}) AS u, trim(arg_max(reply, seq), {_WS}) AS reply FROM x WHERE reply IS NOT NULL GROUP BY 1), z AS (SELECT *, regexp_replace(u, '\\s+', ' ', 'g') AS p FROM y)
  SELECT run_id, u AS user, reply, CASE WHEN length(p) > 100 THEN rtrim(p[:100]) || '...' ELSE p END AS preview FROM z""")
def last_exchange(spark, sf_dir):
    return ms.last_exchange(messages(spark, sf_dir))


@query("""WITH r AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'odd-' || conv_id ELSE 'run-2024010' || (conv_id % 9 + 1) || '-12' || lpad((conv_id % 60)::VARCHAR, 2, '0') || '00-x' || conv_id END AS name, conv_id % 11 AS mtime FROM (SELECT DISTINCT conv_id FROM conversations)),
  t AS (SELECT * FROM r ORDER BY name LIKE 'run-%' DESC, CASE WHEN name LIKE 'run-%' THEN name[5:19] END DESC, mtime DESC, name DESC LIMIT 20)
  SELECT conv_id AS run_id, name FROM t WHERE conv_id IN (SELECT a.conv_id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant' AND b.turn > a.turn)""")
def recent_runs(spark, sf_dir):
    m = messages(spark, sf_dir)
    name = F.when(F.col("run_id") % 3 == 0, F.concat(F.lit("odd-"), "run_id")).otherwise(F.concat(F.lit("run-2024010"), F.col("run_id") % 9 + 1, F.lit("-12"), F.lpad((F.col("run_id") % 60).cast("string"), 2, "0"), F.lit("00-x"), "run_id"))
    runs = m.select("run_id").distinct().select("run_id", name.alias("name"), (F.col("run_id") % 11).alias("mtime"))
    return ms.recent_runs(runs, ms.last_exchange(m), 20).select("run_id", "name")


@query(f"WITH {M} SELECT run_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) <= 6")
def compact_history(spark, sf_dir):
    return ms.compact_history(messages(spark, sf_dir), 6, 250_000).groupBy("run_id").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, CASE WHEN length(t) > 90 THEN rtrim(t[:90], {_WS}) || '...' ELSE t END AS a, CASE WHEN length(t) > 90 THEN rtrim(t[:87], {_WS}) || '...' ELSE t END AS b,
  CASE WHEN length(t) > 90 THEN rtrim(t[:73], {_WS}) || '[CONTENT OMITTED]' ELSE t END AS c, CASE WHEN length(t) > 90 THEN t[:90] || '...' ELSE t END AS d FROM (SELECT doc_id, text AS t FROM documents)""")
def truncate_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", tx.clip("text", 90).alias("a"), tx.clip_within("text", 90).alias("b"), tx.clip_marked("text", 90).alias("c"), tx.clip_plain("text", 90).alias("d"))


@query(f"WITH {M} SELECT run_id, greatest(ceil(sum(length(content) + length(role)) / 4)::BIGINT, count(*)) AS tokens FROM m GROUP BY 1")
def estimate_tokens(spark, sf_dir):
    return ms.estimate_tokens(messages(spark, sf_dir))


@query(f"""WITH {STEPS}, t AS (SELECT run_id, seq, trim(content, {_WS}) AS c FROM s WHERE is_agent AND trim(content, {_WS}) <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM t),
  i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM k WHERE r <= 2) SELECT run_id, string_agg('[' || i || '] ' || c, chr(10) ORDER BY seq) AS findings FROM i GROUP BY 1""")
def agent_findings(spark, sf_dir):
    return ms.agent_findings(messages(spark, sf_dir), last=2, agent_roles=AGENT)


@query(f"""WITH {STEPS}, c AS (SELECT *, trim(content, {_WS}) AS t FROM s), d AS (SELECT *, CASE WHEN length(t) > 420 THEN rtrim(t[:417], {_WS}) || '...' ELSE t END AS v FROM c),
  r AS (SELECT run_id, string_agg('- ' || role || ': ' || v, chr(10) ORDER BY seq) AS talk, string_agg('- step ' || upto || ' a: ' || v, chr(10) ORDER BY upto) FILTER (is_agent) AS steps, coalesce(arg_max(v, seq) FILTER (is_agent), 'none') AS final FROM d GROUP BY 1)
  SELECT run_id, '## Run ' || run_id || chr(10) || 'Duration: ' || run_id % 7 || ' s' || chr(10) || 'Tokens: 5' || chr(10) || 'Conversation:' || chr(10) || talk || coalesce(chr(10) || 'Steps:' || chr(10) || steps, '') || coalesce(chr(10) || 'Final output: ' || nullif(final, ''), '') AS report FROM r""")
def run_context_report(spark, sf_dir):
    m = messages(spark, sf_dir)
    runs = m.select("run_id").distinct().select("run_id", (F.col("run_id") % 7).alias("seconds"), F.lit(5).alias("total_tokens"), F.lit("none").alias("output"))
    steps = ms.with_agent_step(m, AGENT).where("is_agent").select("run_id", F.col("agent_step").alias("step"), F.lit("a").alias("agent"), F.col("content").alias("result"))
    return ms.run_context_report(runs, m, steps)


@query(f"WITH {STEPS} SELECT r.run_id, coalesce(content, '') AS text FROM (SELECT DISTINCT run_id FROM m) r LEFT JOIN s ON s.run_id = r.run_id AND is_agent AND upto = 2")
def step_text(spark, sf_dir):
    return ms.step_text(messages(spark, sf_dir), 2, AGENT).select("run_id", "text")


@query(f"""WITH {M}, x AS (SELECT run_id, seq, CASE WHEN seq % 4 = 3 THEN 'agent' ELSE role END AS role, content FROM m),
  b AS (SELECT *, count(*) FILTER (role = 'agent') OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto FROM x),
  st AS (SELECT run_id, upto AS step FROM b WHERE role = 'agent'),
  p AS (SELECT st.step, b.* FROM st JOIN b ON b.run_id = st.run_id AND b.upto < st.step),
  q AS (SELECT *, max(seq) FILTER (role = 'user') OVER w AS lu, max(seq) FILTER (role NOT IN ('agent', 'assistant')) OVER w AS lb FROM p WINDOW w AS (PARTITION BY run_id, step)),
  i AS (SELECT *, CASE WHEN role = 'agent' THEN 1 WHEN seq <= coalesce(lb, -1) THEN 0 ELSE 2 END AS part, CASE WHEN role = 'agent' THEN row_number() OVER (PARTITION BY run_id, step, role = 'agent' ORDER BY seq) END AS ai FROM q WHERE role <> 'agent' OR seq > lu),
  t AS (SELECT run_id, step, string_agg(CASE WHEN role = 'agent' THEN '<AGENT OUTPUT STEP ' || ai || '>' || content || '</AGENT OUTPUT STEP ' || ai || '>' WHEN role = 'assistant' THEN trim(content, {_WS}) WHEN role = 'system' THEN '<USER_SYSTEM>' || content || '</USER_SYSTEM>' ELSE '<USER>' || content || '</USER>' END, chr(10)||chr(10) ORDER BY part, seq) AS query FROM i GROUP BY ALL)
  SELECT st.run_id, st.step, '<query>' || chr(10) || coalesce(trim(query, {_WS}), '[missing query context]') || chr(10) || '</query>' || chr(10)||chr(10)||chr(10) || '<key>' || chr(10) || CASE WHEN st.step = 1 THEN 'know 1' ELSE '[missing knowledge text]' END || chr(10) || '</key>' || chr(10)||chr(10)||chr(10) || 'Query-Key Relevance Score:' AS prompt
  FROM st LEFT JOIN t USING (run_id, step)""")
def step_prompts(spark, sf_dir):
    m = _mixed(spark, sf_dir)
    keys = m.select("run_id").distinct().select("run_id", F.lit(1).alias("step"), F.lit(" know 1").alias("text"))
    return ms.step_prompts(m, keys)


def _entries(spark, sf_dir):
    m = messages(spark, sf_dir)
    runs = m.where("role = 'user'").select("run_id").distinct()
    k = runs.select("run_id", F.explode(F.sequence(F.lit(0), F.col("run_id") % 3)).alias("pos"))
    k = k.select("run_id", "pos", F.concat(F.lit(" know "), "pos").alias("text"), F.when(F.col("pos") == 1, F.array(F.lit("t"))).alias("tags"), ((F.col("run_id") + F.col("pos")) % 4).alias("score"))
    extras = runs.where("run_id % 5 = 0").select("run_id", F.lit(1).alias("place"), F.lit("other").alias("text"))
    given = runs.select("run_id", F.lit(0).alias("winner"), F.lit(1).alias("loser"))
    return cv.convert_entries(m, k, given, extras, more_pairs=True, agent_roles=AGENT)


_ENTRIES = f"""{STEPS}, r AS (SELECT DISTINCT run_id FROM m WHERE role = 'user'), k AS (SELECT run_id, p::INTEGER AS pos, 'know ' || p AS text, CASE WHEN p = 1 THEN chr(10) || 'Tags: t' ELSE '' END AS tags, ((run_id + p) % 4)::DOUBLE AS score FROM r, generate_series(0, 2) g(p) WHERE p <= run_id % 3
  UNION ALL SELECT run_id, (run_id % 3 + 1)::INTEGER, 'other', '', 0.0 FROM r WHERE run_id % 5 = 0)"""


@query(f"""WITH {_ENTRIES}, b AS (SELECT run_id, seq, role, content, is_agent, upto, n_steps - 1 AS n FROM s WHERE NOT (is_agent AND upto = n_steps)), f AS (SELECT run_id, arg_max(content, seq) AS focus FROM m WHERE role = 'user' GROUP BY 1),
  t AS (SELECT run_id, upto, trim(content, {_WS}) AS c FROM b WHERE is_agent AND upto > n - 4),
  a AS (SELECT run_id, string_agg('step' || upto || chr(10) || CASE WHEN length(c) > 800 THEN rtrim(c[:800], {_WS}) || '...' ELSE c END, chr(10)||chr(10) ORDER BY upto) FILTER (c <> '') AS findings FROM t GROUP BY 1)
  SELECT k.run_id, pos, score, '<query>' || chr(10) || 'User query:' || chr(10) || trim(focus, {_WS}) || coalesce(chr(10)||chr(10) || 'Recent agent findings:' || chr(10) || findings, '') || chr(10) || '</query>' || chr(10)||chr(10)||chr(10) || '<key>' || chr(10) || text || tags || chr(10) || '</key>' || chr(10)||chr(10)||chr(10) || 'Query-Key Relevance Score:' AS prompt
  FROM k JOIN f USING (run_id) LEFT JOIN a USING (run_id)""")
def convert_entries(spark, sf_dir):
    return _entries(spark, sf_dir)[0]


@query(f"""WITH {_ENTRIES}, given AS (SELECT run_id, 0 AS winner, 1 AS loser FROM r WHERE run_id IN (SELECT run_id FROM k WHERE pos = 1)),
  made AS (SELECT a.run_id, CASE WHEN a.score > b.score THEN a.pos ELSE b.pos END AS winner, CASE WHEN a.score > b.score THEN b.pos ELSE a.pos END AS loser FROM k a JOIN k b ON a.run_id = b.run_id AND a.pos < b.pos AND a.score <> b.score)
  SELECT *, true AS given FROM given UNION ALL SELECT *, false FROM made WHERE (run_id, winner, loser) NOT IN (SELECT * FROM given)""")
def convert_entry_pairs(spark, sf_dir):
    return _entries(spark, sf_dir)[1]


@query(f"""WITH {M}, f AS (SELECT run_id, min(seq) AS first, arg_min(role, seq) AS role FROM m GROUP BY 1)
  SELECT m.run_id, seq, m.role, CASE WHEN seq = first AND m.role = 'system' THEN 'be ' || m.run_id ELSE content END AS content FROM m JOIN f USING (run_id) UNION ALL SELECT run_id, first - 1, 'system', 'be ' || run_id FROM f WHERE role <> 'system'""")
def with_system_prompt(spark, sf_dir):
    m = messages(spark, sf_dir)
    return cv.with_system_prompt(m, m.select("run_id").distinct().withColumn("system_prompt", F.concat(F.lit("be "), "run_id")))
