"""Message histories. Messages are rows (run_id, seq, role, content, ...); seq gives the order within a run.

Agent messages have a role of ``agent_roles`` or, by the broad rule, role system with a filled
``agent`` column. A run is the unit of all windows and groups; ``compact_history`` drops runs that
are too long before heavier operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trialloom.functions.text import clip, clip_within, filled, strip
from trialloom.operators.preference import balanced_batches, comparison_pairs, merge_pairs, rank_prompt  # noqa: F401


def by_run() -> WindowSpec:
    return Window.partitionBy("run_id").orderBy("seq")


def so_far() -> WindowSpec:
    return by_run().rowsBetween(Window.unboundedPreceding, 0)


def earlier() -> WindowSpec:
    return by_run().rowsBetween(Window.unboundedPreceding, -1)


def whole() -> WindowSpec:
    return Window.partitionBy("run_id")


# Labels of roles in a conversation's text.
ROLE_LABELS = {"user": "User", "assistant": "Assistant", "agent": "Agent", "system": "System", "function": "Function", "developer": "Developer"}


def is_agent(df: DataFrame, agent_roles: tuple[str, ...] = ("agent",), broad: bool = True) -> Column:
    flag = F.coalesce(F.lower("role").isin(*agent_roles), F.lit(False))
    if broad and "agent" in df.columns:
        flag = flag | F.coalesce((F.lower("role") == "system") & (F.col("agent") != ""), F.lit(False))
    return flag


def normalize_messages(df: DataFrame) -> DataFrame:
    """Messages without those of role assistant."""
    return df.where(F.coalesce(F.lower("role") != "assistant", F.lit(True)))


def with_agent_step(df: DataFrame, agent_roles=("agent",), broad: bool = True) -> DataFrame:
    """Add is_agent, agent_step (1-based, null for others) and the run's n_steps."""
    out = df.withColumn("is_agent", is_agent(df, agent_roles, broad))
    n = F.col("is_agent").cast("int")
    return out.withColumn("agent_step", F.when(F.col("is_agent"), F.sum(n).over(so_far()))).withColumn("n_steps", F.sum(n).over(whole()))


def prefix_through_step(df: DataFrame, step: int | Column, agent_roles=("agent",), broad: bool = True) -> DataFrame:
    """Messages up to and including the step-th agent message; all if there are fewer."""
    if isinstance(step, int) and step < 1:
        raise ValueError("step must be at least 1")
    before = F.coalesce(F.sum(is_agent(df, agent_roles, broad).cast("int")).over(earlier()), F.lit(0))
    return df.withColumn("_a", before).where(F.col("_a") < step).drop("_a")


def prefix_before_step(df: DataFrame, step: int | Column, agent_roles=("agent",), broad: bool = True) -> DataFrame:
    """Messages before the step-th agent message."""
    upto = F.sum(is_agent(df, agent_roles, broad).cast("int")).over(so_far())
    last = F.greatest((F.lit(step) if isinstance(step, int) else step) - 1, F.lit(0))
    return df.withColumn("_a", upto).where(F.col("_a") <= last).drop("_a")


def strip_last_agent(df: DataFrame, agent_roles=("agent",)) -> DataFrame:
    """Messages without each run's last agent message."""
    last = F.max(F.when(is_agent(df, agent_roles, False), F.col("seq"))).over(whole())
    return df.withColumn("_l", last).where(F.col("_l").isNull() | (F.col("seq") != F.col("_l"))).drop("_l")


def strip_fields(df: DataFrame) -> DataFrame:
    """run_id, seq, role, content (default ""), stripped non-empty name, knowledge; messages without a role go."""
    name = filled("name") if "name" in df.columns else F.lit(None).cast("string")
    knowledge = F.col("knowledge") if "knowledge" in df.columns else F.lit(None).cast("string")
    return df.where(F.coalesce(F.col("role") != "", F.lit(False))).select("run_id", "seq", "role", F.coalesce("content", F.lit("")).alias("content"), name.alias("name"), knowledge.alias("knowledge"))


def role_counts(df: DataFrame) -> DataFrame:
    """Messages of each run by lower-case role; a missing role counts as user."""
    return df.groupBy("run_id", F.lower(F.coalesce(F.nullif("role", F.lit("")), F.lit("user"))).alias("role")).agg(F.count("*").alias("n"))


def flatten_conversation(df: DataFrame, system: str | None = None, drop_system: bool = False, agent_roles=("agent",), broad: bool = True) -> DataFrame:
    """Rows (run_id, pos, role, content, name): each stretch between assistant messages as one user message.

    System and developer messages are wrapped in <USER_SYSTEM>, others in <USER>. Agent messages
    after the last user message join the last user block, numbered; ``system`` goes in front of it."""
    role = F.lower("role")
    out = df.withColumn("is_agent", is_agent(df, agent_roles, broad)).withColumn("is_reply", F.coalesce(role == "assistant", F.lit(False)) & ~F.col("is_agent"))
    out = out.withColumn("block", F.sum(F.col("is_reply").cast("int")).over(so_far())).withColumn("last_user", F.max(F.when(role == "user", F.col("seq"))).over(whole()))
    after = F.col("is_agent") & F.coalesce(F.col("seq") > F.col("last_user"), F.lit(False))
    out = out.withColumn("late", F.when(after, F.sum(after.cast("int")).over(so_far())))
    content = F.coalesce("content", F.lit(""))
    official = role.isin("system", "developer")
    own = ~F.col("is_agent") & ~F.col("is_reply") & (F.lit(not drop_system) | ~F.coalesce(official, F.lit(False)))
    tag = F.when(official, "USER_SYSTEM").otherwise("USER")
    segment = F.when(own, F.concat(F.lit("<"), tag, F.lit(">"), content, F.lit("</"), tag, F.lit(">")))
    step = F.concat(F.lit("<AGENT OUTPUT STEP "), "late", F.lit(">"), "content", F.lit("</AGENT OUTPUT STEP "), "late", F.lit(">"))
    name = F.substring(filled("name"), 1, 64) if "name" in df.columns else F.lit(None).cast("string")
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("seq", c.alias("x"))))), lambda s: s.x), "\n\n")
    blocks = out.groupBy("run_id", "block").agg(
        F.nullif(ordered(segment), F.lit("")).alias("user"), F.nullif(ordered(F.when(F.col("late").isNotNull(), step)), F.lit("")).alias("late"),
        F.max(F.when(F.col("is_reply"), content)).alias("reply"), F.max(F.when(F.col("is_reply"), name)).alias("reply_name"),
    )
    # what the run's agents said late, and the last block with a user message
    blocks = blocks.withColumn("late", F.max("late").over(whole())).withColumn("target", F.max(F.when(F.col("user").isNotNull(), F.col("block"))).over(whole())).withColumn("end", F.max("block").over(whole()))
    extra = F.col("late").isNotNull() if not system else F.lit(True)
    here = (F.col("block") == F.coalesce("target", "end")) & extra
    body = F.when(here, F.concat_ws("\n\n", "user", "late")).otherwise(F.col("user"))
    if system:
        body = F.when(here, F.when(body == "", F.lit(system)).otherwise(F.concat(F.lit(f"{system}\n\n\n"), body))).otherwise(body)
    body = F.nullif(body, F.lit(""))
    rows = F.filter(F.array(
        F.struct((F.col("block") * 2).alias("pos"), F.lit("assistant").alias("role"), F.col("reply").alias("content"), F.col("reply_name").alias("name")),
        F.struct((F.col("block") * 2 + 1).alias("pos"), F.lit("user").alias("role"), body.alias("content"), F.lit(None).cast("string").alias("name")),
    ), lambda r: r.content.isNotNull())
    flat = blocks.select("run_id", F.explode(rows).alias("r")).select("run_id", "r.*")
    return flat.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy("pos")) - 1)


def _history(df: DataFrame, *fields: Column | str) -> DataFrame:
    """One row a run with its messages as an ordered array ``h``."""
    return df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("h"))


def format_reasoning_history(df: DataFrame, knowledge: DataFrame, agent_roles=("agent",)) -> DataFrame:
    """Rows (run_id, history): each agent step's output and the knowledge used in it, in tags.

    ``knowledge``: (run_id, step, ord, id, text)."""
    steps = with_agent_step(df, agent_roles, False).where("is_agent").select("run_id", F.col("agent_step").alias("step"), F.coalesce("content", F.lit("")).alias("content"))
    line = F.concat(F.coalesce(F.concat(filled(F.col("id").cast("string")), F.lit(": ")), F.lit("")), filled("text"))
    used = knowledge.where(filled("text").isNotNull()).groupBy("run_id", F.col("step").try_cast("long").alias("step")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("x")))), lambda s: s.x), "\n").alias("used"))
    s = F.col("step").cast("string")
    block = F.concat(F.lit("<STEP "), s, F.lit(">\n<AGENT OUTPUT>\n"), "content", F.lit("\n</AGENT OUTPUT>\n<USED KNOWLEDGE>\n"), F.coalesce("used", F.lit("")), F.lit("\n</USED KNOWLEDGE>\n</STEP "), s, F.lit(">"))
    body = steps.join(used, ["run_id", "step"], "left").groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", block.alias("x")))), lambda r: r.x), "\n").alias("body"))
    runs = df.select("run_id").distinct()
    return runs.join(body, "run_id", "left").select("run_id", F.concat_ws("\n", F.lit("<REASONING HISTORY>"), "body", F.lit("</REASONING HISTORY>")).alias("history"))


def recent_conversation(df: DataFrame, messages: int = 8, chars: int = 400) -> DataFrame:
    """Rows (run_id, conversation, focus): the last messages' text by role, and the latest non-empty user content."""
    role = F.lower(F.coalesce("role", F.lit("")))
    label = F.lit("Message")
    for k, v in ROLE_LABELS.items():
        label = F.when(role == k, v).otherwise(label)
    line = F.concat(label, F.lit(": "), clip(strip(F.coalesce("content", F.lit(""))), chars))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))).withColumn("_line", F.when((F.col("_r") <= messages) & (role != "system"), line))
    out = ranked.groupBy("run_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("seq", "_line")))), lambda s: s["_line"]), "\n").alias("conversation"),
        F.max_by(F.when((role == "user") & (F.col("content") != ""), F.col("content")), F.when((role == "user") & (F.col("content") != ""), F.col("seq"))).alias("focus"),
    )
    return out.withColumn("focus", F.coalesce("focus", "conversation"))


def build_query_block(df: DataFrame, cues: DataFrame | None = None, agent_roles=("agent",), training: bool = False, steps: int = 4, chars: int = 800, cues_a_step: int = 3, cue_chars: int = 200) -> DataFrame:
    """Rows (run_id, query): the focus, the last agent steps and the knowledge cues of those steps.

    ``cues``: (run_id, step, ord, text). The training form wraps the text and names the user's query."""
    focus = recent_conversation(df).select("run_id", strip("focus").alias("focus"))
    marked = with_agent_step(df, agent_roles, False).where(F.col("is_agent") & (F.col("agent_step") > F.col("n_steps") - steps))
    text = clip(strip(F.coalesce("content", F.lit(""))), chars)
    found = F.when(text != "", F.concat(F.lit("step"), F.col("agent_step").cast("string"), F.lit("\n"), text))
    ordered = lambda key, c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col(key).alias("k"), c.alias("x"))))), lambda s: s.x), sep)
    findings = marked.groupBy("run_id").agg(F.nullif(strip(ordered("agent_step", found, "\n\n")), F.lit("")).alias("findings"))
    out = focus.join(findings, "run_id", "left")
    if cues is not None:
        w = Window.partitionBy("run_id", "step").orderBy("ord")
        few = cues.where(filled("text").isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cues_a_step)
        few = few.join(marked.select("run_id", F.col("agent_step").alias("step")), ["run_id", "step"], "left_semi")
        by_step = few.groupBy("run_id", "step").agg(ordered("ord", F.concat(F.lit("- "), clip(strip("text"), cue_chars)), "\n").alias("lines"))
        lines = by_step.groupBy("run_id").agg(ordered("step", F.concat(F.lit("step"), F.col("step").cast("string"), F.lit("\n"), F.col("lines")), "\n\n").alias("cues"))
        out = out.join(lines, "run_id", "left")
    else:
        out = out.withColumn("cues", F.lit(None).cast("string"))
    head = F.coalesce(F.nullif("focus", F.lit("")), F.lit("[missing user query]"))
    body = F.concat_ws("\n\n", F.concat(F.lit("User query:\n"), head) if training else head, F.concat(F.lit("Recent agent findings:\n"), "findings"), F.concat(F.lit("Selected knowledge cues:\n"), "cues"))
    return out.select("run_id", (F.concat(F.lit("<query>\n"), strip(body), F.lit("\n</query>")) if training else strip(body)).alias("query"))


def last_exchange(df: DataFrame, chars: int = 100) -> DataFrame:
    """Rows (run_id, user, reply, preview): the latest non-empty user message that is answered later, with the first answer after it."""
    role, text = F.lower("role"), filled("content")
    later = Window.partitionBy("run_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    answer = F.first(F.when(role == "assistant", text), ignorenulls=True).over(later)
    ok = df.withColumn("_a", answer).where((role == "user") & text.isNotNull() & F.col("_a").isNotNull())
    out = ok.groupBy("run_id").agg(F.max_by(text, "seq").alias("user"), F.max_by("_a", "seq").alias("reply"))
    return out.withColumn("preview", clip(F.regexp_replace("user", r"\s+", " "), chars))


def recent_runs(runs: DataFrame, exchanges: DataFrame, limit: int = 20) -> DataFrame:
    """The latest runs that have an exchange; the limit applies before those without one go.

    ``runs``: (run_id, name, mtime). Names with a time come first, by it; then by mtime."""
    stamp = F.regexp_extract("name", r"^run-(\d{8}-\d{6})", 1)
    at = F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd-HHmmss"))
    top = runs.withColumn("at", at).orderBy(F.col("at").isNotNull().desc(), F.col("at").desc(), F.col("mtime").desc(), F.col("name").desc()).limit(limit)
    return top.join(exchanges, "run_id").select("run_id", "name", "user", "reply")


def compact_history(df: DataFrame, messages: int = 160, chars: int = 250_000) -> DataFrame:
    """Messages of the runs that have at most so many messages and characters of JSON."""
    size = F.length(F.to_json(F.struct(*[c for c in df.columns if c not in ("run_id", "seq")]))) + 2
    ok = df.groupBy("run_id").agg(F.count("*").alias("_n"), F.sum(size).alias("_c")).where((F.col("_n") <= messages) & (F.col("_c") <= chars))
    return df.join(ok.select("run_id"), "run_id", "left_semi")


def estimate_tokens(df: DataFrame) -> DataFrame:
    """Rows (run_id, tokens): a quarter of the characters of contents and roles, one a message at least."""
    chars = F.sum(F.char_length(F.coalesce("content", F.lit(""))) + F.char_length(F.coalesce("role", F.lit(""))))
    return df.groupBy("run_id").agg(F.greatest(F.ceil(chars / 4), F.count("*")).alias("tokens"))


def agent_findings(df: DataFrame, last: int | None = None, sentences: int | None = None, agent_roles=("agent",)) -> DataFrame:
    """Rows (run_id, findings): non-empty agent outputs in order, numbered, with the agent's name if known; the last ``last`` of them, the first ``sentences`` of each."""
    text = filled("content")
    if sentences is not None:
        text = F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, sentences), " ")
    marked = df.where(is_agent(df, agent_roles, False)).withColumn("_t", text).where("_t is not null")
    if last is not None:
        marked = marked.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))).where(F.col("_r") <= last)
    marked = marked.withColumn("_i", F.row_number().over(by_run()))
    name = F.coalesce(F.concat(F.lit(" ("), filled("name"), F.lit(")")), F.lit("")) if "name" in df.columns else F.lit("")
    line = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("]"), name, F.lit(" "), "_t")
    return marked.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", line.alias("x")))), lambda s: s.x), "\n").alias("findings"))


def run_context_report(runs: DataFrame, messages: DataFrame, steps: DataFrame, limit: int = 420) -> DataFrame:
    """Rows (run_id, report): header, duration and tokens, conversation, steps and final output, each text clipped.

    ``runs``: (run_id, seconds, total_tokens, output); ``steps``: (run_id, step, agent, result)."""
    short = lambda c: clip_within(strip(F.coalesce(c, F.lit(""))), limit)
    ordered = lambda key, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), c.alias("x")))), lambda s: s.x), "\n")
    talk = messages.groupBy("run_id").agg(
        ordered("seq", F.concat(F.lit("- "), F.coalesce("role", F.lit("user")), F.lit(": "), short(F.col("content")))).alias("talk"),
        F.max_by(F.when(F.lower("role") == "assistant", F.col("content")), F.when(F.lower("role") == "assistant", F.col("seq"))).alias("final"),
    )
    done = steps.groupBy("run_id").agg(ordered("step", F.concat(F.lit("- step "), F.col("step").cast("string"), F.lit(" "), F.coalesce("agent", F.lit("?")), F.lit(": "), short(F.col("result")))).alias("steps"))
    out = runs.join(talk, "run_id", "left").join(done, "run_id", "left")
    report = F.concat_ws(
        "\n", F.concat(F.lit("## Run "), F.col("run_id").cast("string")),
        F.concat(F.lit("Duration: "), F.col("seconds").cast("string"), F.lit(" s")), F.concat(F.lit("Tokens: "), F.col("total_tokens").cast("string")),
        F.concat(F.lit("Conversation:\n"), "talk"), F.concat(F.lit("Steps:\n"), "steps"), F.concat(F.lit("Final output: "), F.nullif(short(F.coalesce("final", "output")), F.lit(""))),
    )
    return out.select("run_id", report.alias("report"))


def step_text(df: DataFrame, step: int, agent_roles=("agent",)) -> DataFrame:
    """Rows (run_id, text, agent): output and name of the step-th agent message; "" and null without one."""
    marked = with_agent_step(df, agent_roles, False).where(F.col("agent_step") == step)
    name = F.col("name") if "name" in df.columns else F.lit(None).cast("string")
    got = marked.select("run_id", F.col("content").alias("text"), name.alias("agent"))
    return df.select("run_id").distinct().join(got, "run_id", "left").select("run_id", F.coalesce("text", F.lit("")).alias("text"), "agent")


def step_prompts(df: DataFrame, keys: DataFrame, agent_roles=("agent",)) -> DataFrame:
    """Rows (run_id, step, prompt): before each agent step the flattened history as query, the step's knowledge as key.

    Histories are gathered once a run into arrays; a step's prefix is a filter of the run's array, so
    text is copied only into the prompts themselves. ``keys``: (run_id, step, text)."""
    marked = with_agent_step(df, agent_roles, True).withColumn("upto", F.sum(F.col("is_agent").cast("int")).over(so_far()))
    role = F.lower(F.coalesce("role", F.lit("")))
    tag = F.when(role.isin("system", "developer"), "USER_SYSTEM").otherwise("USER")
    text = F.coalesce("content", F.lit(""))
    item = F.when(F.col("is_agent"), F.col("content")).when(role == "assistant", strip(text)).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">")))
    kind = F.when(F.col("is_agent"), 2).when(role == "assistant", 1).otherwise(0)
    marked = marked.withColumn("user_before", F.max(F.when(role == "user", F.col("seq"))).over(so_far()))
    runs = marked.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "upto", kind.alias("kind"), item.alias("text"), (role == "user").alias("is_user")))).alias("h"), F.max("n_steps").alias("n_steps"))
    steps = runs.where("n_steps > 0").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("n_steps").cast("int"))))
    steps = steps.withColumn("p", F.filter("h", lambda m: m.upto < F.col("step")))
    last_user = F.aggregate("p", F.lit(-1).cast("long"), lambda s, m: F.when(m.is_user, F.greatest(s, m.seq.cast("long"))).otherwise(s))
    steps = steps.withColumn("last_user", last_user).withColumn("last_block", F.aggregate("p", F.lit(-1).cast("long"), lambda s, m: F.when(m.kind == 0, F.greatest(s, m.seq.cast("long"))).otherwise(s)))
    late = F.filter("p", lambda m: (m.kind == 2) & (F.col("last_user") >= 0) & (m.seq > F.col("last_user")))
    late = F.filter(F.transform(late, lambda m, i: F.concat(F.lit("<AGENT OUTPUT STEP "), (i + 1).cast("string"), F.lit(">"), m.text, F.lit("</AGENT OUTPUT STEP "), (i + 1).cast("string"), F.lit(">"))), lambda x: x.isNotNull())
    # agents' late outputs stand after the last user block, before later replies
    parts = lambda keep: F.transform(F.filter("p", lambda m: (m.kind != 2) & (m.text != "") & keep(m)), lambda m: m.text)
    query = F.array_join(F.concat(parts(lambda m: m.seq <= F.col("last_block")), late, parts(lambda m: m.seq > F.col("last_block"))), "\n\n")
    out = steps.join(keys.select("run_id", "step", "text"), ["run_id", "step"], "left")
    return out.select("run_id", "step", rank_prompt(query, F.col("text")).alias("prompt"))
