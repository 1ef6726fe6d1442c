"""The knowledge pool: entries (id, agent, text, tags, step, meta), where agent "*" means every agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.numbering import number_rows
from trialloom.functions.pairing import all_pairs
from trialloom.functions.text import filled, first_filled, json_candidates, seeded_order, strip

ANY_AGENT = "*"


def parse_tags(c: Column) -> Column:
    """Tags of a text: a JSON list's strings, else the parts of a comma list; stripped, without blanks."""
    as_list = F.when(strip(c).startswith("["), F.from_json(c, "array<string>"))
    parts = F.coalesce(as_list, F.split(F.coalesce(c, F.lit("")), ","))
    return F.filter(F.transform(parts, strip), lambda t: t.isNotNull() & (t != ""))


def numeric_id(c: Column) -> Column:
    """An id as long: a whole number, a whole float, else the first run of digits in the text."""
    s = filled(c.cast("string"))
    whole = F.when(s.rlike(r"^-?\d+$"), s.try_cast("long"))
    as_float = F.when(s.rlike(r"^-?\d+\.0+$"), F.regexp_extract(s, r"^-?\d+", 0).try_cast("long"))
    run = F.nullif(F.regexp_extract(s, r"(\d+)", 1), F.lit("")).try_cast("long")
    return F.coalesce(whole, as_float, run)


def normalize_entries(df: DataFrame) -> DataFrame:
    """Entries with text; tags as a list of strings, id numeric or the meta row index; an id of 0 or "" counts as missing."""
    have = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    text = first_filled(*[have(c) for c in ("knowledge", "text", "content", "value")])
    given = F.when(~have("id").isin("0", ""), have("id"))
    index = F.col("meta")["row_index"] if "meta" in df.columns else F.lit(None).cast("string")
    agent = have("agent")
    return df.select(F.coalesce(numeric_id(given), numeric_id(have("knowledge_id")), numeric_id(index)).alias("id"), agent.alias("agent"), text.alias("text"), parse_tags(have("tags")).alias("tags")).where("text is not null")


def step_conditions(spec: Column) -> Column:
    """A step specification as an array of alternatives, each an array of conditions (op, num).

    A bare number or comma list of numbers is alternatives of one "=="; with an operator the comma
    list's parts all have to hold. Null or blank: null (matches every step). Nothing parsable: no alternative."""
    s = filled(spec)
    parts = F.transform(F.split(s, ","), strip)
    form = r"^(<=|>=|<|>|==|=)?\s*(\d+)$"
    good = F.filter(parts, lambda p: p.rlike(form))
    cond = lambda p: F.struct(F.coalesce(F.nullif(F.regexp_extract(p, form, 1), F.lit("")), F.lit("==")).alias("op"), F.regexp_extract(p, form, 2).cast("int").alias("num"))
    alone = F.transform(F.filter(parts, lambda p: p.rlike(r"^\d+$") & (p.try_cast("int") > 0)), lambda p: F.array(cond(p)))
    return F.when(s.isNotNull(), F.when(s.rlike("[<>=]"), F.when(F.size(good) > 0, F.array(F.transform(good, cond))).otherwise(F.array().cast("array<array<struct<op:string,num:int>>>"))).otherwise(alone))


def matches_step(conditions: Column, step: Column) -> Column:
    """Whether parsed conditions hold for a step; null conditions always do, no alternatives never."""

    def holds(c):
        return (
            F.when(c.op.isin("=", "=="), step == c.num).when(c.op == "<", step < c.num).when(c.op == "<=", step <= c.num).when(c.op == ">", step > c.num).otherwise(step >= c.num)
        )

    return F.when(conditions.isNull(), F.lit(True)).otherwise(F.exists(conditions, lambda a: F.forall(a, holds)))


def match_steps(entries: DataFrame, max_steps: int, spec: str = "step") -> DataFrame:
    """One row for each entry and step in 1..max_steps that its specification matches: adds ``at_step``."""
    return entries.withColumn("_c", step_conditions(F.col(spec).cast("string"))).withColumn("at_step", F.explode(F.sequence(F.lit(1), F.lit(max_steps)))).where(matches_step(F.col("_c"), F.col("at_step"))).drop("_c")


def compose_step_knowledge(base: DataFrame, stores: DataFrame, inline: DataFrame, max_steps: int) -> DataFrame:
    """Rows (at_step, agent, ord, id, text): what each agent may use in each step, base first, then stores, then inline entries.

    ``stores`` have a ``config_step``; an entry's own step wins over its meta step, that over the
    store's. ``inline`` has a list of agents, default "*"; those that match no step vanish."""
    meta = lambda df: F.col("meta")["step"] if "meta" in df.columns else F.lit(None).cast("string")
    step = lambda df: F.col("step").cast("string") if "step" in df.columns else F.lit(None).cast("string")
    config = lambda df: F.col("config_step").cast("string") if "config_step" in df.columns else F.lit(None).cast("string")
    parts = []
    for n, df in enumerate((base, stores, inline)):
        agents = F.coalesce(F.filter("agents", lambda a: filled(a).isNotNull()), F.array().cast("array<string>")) if "agents" in df.columns else F.array("agent")
        agents = F.when(F.size(agents) > 0, agents).otherwise(F.array(F.lit(ANY_AGENT)))
        parts.append(df.select(F.lit(n).alias("source"), F.explode(agents).alias("agent"), F.col("ord"), F.col("id"), F.col("text"), first_filled(step(df), meta(df), config(df)).alias("spec")))
    return match_steps(parts[0].unionByName(parts[1]).unionByName(parts[2]), max_steps, "spec").drop("spec")


def agent_candidates(pool: DataFrame, agents: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """For each agent its own entries, then those of every agent: (for_agent, place, id, text).

    ``pool`` has ``ord``; a missing id becomes the place. With ``k``, k entries are drawn in hashed
    order. Two joins, not one on a disjunction; shared entries meet agents through ``all_pairs``, which
    broadcasts a side of few bytes or deals both to blocks."""
    own = pool.join(agents.select(F.col("agent")), "agent").select(F.col("agent").alias("for_agent"), F.lit(0).alias("_own"), "ord", "id", "text")
    every = pool.where(F.col("agent") == ANY_AGENT).select("ord", "id", "text")
    shared = all_pairs(agents.where(F.col("agent") != ANY_AGENT).select(F.col("agent").alias("for_agent")), every).select("for_agent", F.lit(1).alias("_own"), "ord", "id", "text")
    w = Window.partitionBy("for_agent").orderBy("_own", "ord")
    out = own.unionByName(shared).withColumn("place", F.row_number().over(w)).withColumn("id", F.coalesce("id", F.col("place").cast("long")))
    if k is not None:
        draw = Window.partitionBy("for_agent").orderBy(seeded_order(seed, "for_agent", "id", "place"), "place")
        out = out.withColumn("_d", F.row_number().over(draw)).where(F.col("_d") <= k)
    return out.select("for_agent", "place", "id", "text")


def extract_used_knowledge(messages: DataFrame, agent_roles=("agent",)) -> DataFrame:
    """Rows (run_id, step, ord, text, id): knowledge used in each agent step.

    ``knowledge`` is JSON: text, an object, or a flat list of these; ids come from objects, else from
    ``knowledge_id`` (a value, or a JSON list of as many) if no object has one. In a step equal texts
    count once, with the first id that is known."""
    from trialloom.operators.messages import with_agent_step

    raw = F.col("knowledge")
    head = strip(raw)
    schema = "struct<text:string, knowledge:string, content:string, value:string, id:string, knowledge_id:string>"
    elements = F.when(head.startswith("["), F.from_json(raw, "array<string>")).when(head != "", F.array(raw))
    obj = lambda e: F.from_json(e, schema)
    is_obj = lambda e: strip(e).startswith("{")
    quoted = lambda e: F.when(strip(e).startswith('"'), F.from_json(F.concat(F.lit("["), e, F.lit("]")), "array<string>")[0]).otherwise(e)
    item = lambda e: F.struct(
        F.when(is_obj(e), first_filled(obj(e).text, obj(e).knowledge, obj(e).content, obj(e).value)).otherwise(filled(quoted(e))).alias("text"),
        F.when(is_obj(e), F.coalesce(F.nullif(obj(e).id, F.lit("")), F.nullif(obj(e).knowledge_id, F.lit("")))).alias("id"),
    )
    steps = with_agent_step(messages, agent_roles, False).where("is_agent")
    out = steps.select("run_id", F.col("agent_step").alias("step"), F.filter(F.transform(elements, item), lambda x: x.text.isNotNull()).alias("items"), F.nullif(F.col("knowledge_id"), F.lit("")).alias("kid"))
    ids = F.when(strip("kid").startswith("["), F.from_json("kid", "array<string>")).otherwise(F.array("kid"))
    bare = F.forall("items", lambda x: x.id.isNull()) & F.col("kid").isNotNull()
    paired = F.when(F.size(ids) == F.size("items"), F.transform("items", lambda x, i: F.struct(x.text.alias("text"), F.get(ids, i).alias("id")))).when(F.size(ids) == 1, F.transform("items", lambda x: F.struct(x.text.alias("text"), F.get(ids, F.lit(0)).alias("id"))))
    out = out.withColumn("items", F.when(bare, F.coalesce(paired, "items")).otherwise(F.col("items")))
    rows = out.select("run_id", "step", F.posexplode("items").alias("ord", "x")).select("run_id", "step", "ord", "x.*")
    return rows.groupBy("run_id", "step", "text").agg(F.min("ord").alias("ord"), F.min_by("id", F.when(F.col("id").isNotNull(), F.col("ord"))).alias("id")).select("run_id", "step", "ord", "text", "id")


def knowledge_inference_map(pool: DataFrame, used: DataFrame, cap: int = 10) -> DataFrame:
    """Rows (id, uses, runs): for every pool entry how often runs retrieved it, and the first ``cap`` of them.

    ``used``: (id, run_id, ord). The cap is a report's length; rows beyond it are counted."""
    w = Window.partitionBy("id").orderBy("ord")
    counts = used.groupBy("id").agg(F.count("*").alias("uses"))
    top = used.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "run_id"))), lambda s: s.run_id).alias("runs"))
    empty = F.array().cast(top.schema["runs"].dataType)
    return pool.select("id").join(counts, "id", "left").join(top, "id", "left").select("id", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("runs", empty).alias("runs"))


def knowledge_score_delta(used: DataFrame) -> DataFrame:
    """Mean score of each knowledge id in the baseline and the rerun; null where it is unused.

    ``used``: (id, score, rerun), a row for each use. One aggregation serves both."""
    mean = lambda flag: F.avg(F.when(F.col("rerun") == flag, F.col("score")))
    return used.groupBy("id").agg(mean(False).alias("baseline"), mean(True).alias("rerun"))


def score_delta_report(delta: DataFrame) -> DataFrame:
    """The delta with 0.0 for missing means and the change."""
    out = delta.select("id", F.coalesce("baseline", F.lit(0.0)).alias("baseline"), F.coalesce("rerun", F.lit(0.0)).alias("rerun"))
    return out.withColumn("change", F.col("rerun") - F.col("baseline"))


def apply_threshold(original: DataFrame, updated: DataFrame, delta: DataFrame, threshold: float) -> DataFrame:
    """The entries that stay: (id, text, decision).

    An id both of whose means are known and rise by more than the threshold keeps its new text; any
    other original entry reverts to its old text, any other new entry goes."""
    old = original.select("id", F.col("text").alias("_old"))
    out = updated.select("id", "text").join(old, "id", "left").join(delta, "id", "left")
    rises = F.coalesce(F.col("rerun") - F.col("baseline") > threshold, F.lit(False))
    out = out.where(rises | F.col("_old").isNotNull())
    return out.select("id", F.when(rises, F.col("text")).otherwise(F.col("_old")).alias("text"), F.when(rises, "keep").otherwise("revert").alias("decision"))


def build_updated_pool(pool: DataFrame, changes: DataFrame, new: DataFrame) -> DataFrame:
    """The pool with texts replaced by id and new entries appended with ids from the largest on.

    ``new``: (ord, agent, text)."""
    kept = pool.join(changes.select("id", F.col("text").alias("_new")), "id", "left").select("id", "agent", F.coalesce("_new", "text").alias("text"))
    top = pool.agg(F.coalesce(F.max(F.col("id").try_cast("long")), F.lit(0)).alias("_top"))
    added = number_rows(new, "_n", "ord").crossJoin(F.broadcast(top))  # one row
    return kept.unionByName(added.select((F.col("_top") + F.col("_n")).cast(pool.schema["id"].dataType).alias("id"), "agent", "text"))


def apply_updates(pool: DataFrame, updates: DataFrame) -> DataFrame:
    """The pool with a flag ``updated``: the last update of an id wins, blank ids and texts and unknown ids count for nothing.

    ``updates``: (seq, id, text); of pool rows that share an id the last by ``ord`` is the target."""
    last = updates.where(filled(F.col("id").cast("string")).isNotNull() & filled("text").isNotNull()).groupBy("id").agg(F.max_by(strip("text"), "seq").alias("_t"))
    target = F.max("ord").over(Window.partitionBy("id")) == F.col("ord")
    out = pool.withColumn("_target", target).join(last, "id", "left")
    changed = F.col("_target") & F.col("_t").isNotNull() & (F.col("_t") != F.col("text"))
    return out.select("ord", "id", "agent", F.when(changed, F.col("_t")).otherwise(F.col("text")).alias("text"), F.coalesce(changed, F.lit(False)).alias("updated"))


def best_knowledge(tries: DataFrame, problem: str, iteration: str) -> DataFrame:
    """Per problem the text of the highest score, the earliest on ties; blank texts and null scores are skipped."""
    ok = tries.where(filled("text").isNotNull() & F.col("score").isNotNull())
    key = F.struct("score", -F.col(iteration))
    return ok.groupBy(problem).agg(F.max_by("text", key).alias("text"), F.max("score").alias("score"), F.max_by("run_id", key).alias("run_id"))


def sample_other_knowledge(entries: DataFrame, pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Rows (entry_id, place, text, score 0.0): n snippets of other ids for each entry, without replacement.

    The pool is ranked by hash once; an entry takes the n places after a hashed start, and a few
    spares for its own id, by an equi-join on the place. ``pool``: (id, text), ids distinct."""
    size = pool.count()
    if size == 0 or n <= 0:
        return entries.select("entry_id", F.lit(0).alias("place"), F.lit("").alias("text"), F.lit(0.0).alias("score")).limit(0)
    ranked = pool.withColumn("_h", seeded_order(seed, "id")).withColumn("_b", F.shiftright("_h", 54).cast("int"))
    counts = ranked.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 1024 rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = ranked.join(F.broadcast(before), "_b").withColumn("slot", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", "id")) - 1)
    take = min(n + 1, size)
    start = F.pmod(seeded_order(seed + 1, "entry_id"), F.lit(size))
    asks = entries.select("entry_id", F.col("id").alias("_own"), F.posexplode(F.sequence(F.lit(0), F.lit(take - 1))).alias("try", "k"), start.alias("s"))
    asks = asks.withColumn("slot", F.pmod(F.col("s") + F.col("k"), F.lit(size)))
    got = asks.join(ranked.select("slot", F.col("id").alias("_other"), "text"), "slot").where(~F.col("_own").eqNullSafe(F.col("_other")))
    w = Window.partitionBy("entry_id").orderBy("try")
    return got.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("entry_id", "place", "text", F.lit(0.0).alias("score"))


def pool_stats(pool: DataFrame) -> DataFrame:
    """Rows (agent, step, entries), with null for all agents or all steps."""
    step = F.coalesce(filled(F.col("step").cast("string")), F.lit("all"))
    by = pool.groupBy(F.col("agent"), step.alias("step")).agg(F.count("*").alias("entries"))
    agents = by.groupBy("agent").agg(F.sum("entries").alias("entries")).select("agent", F.lit(None).cast("string").alias("step"), "entries")
    return by.unionByName(agents).unionByName(by.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries")).select(F.lit(None).cast("string").alias("agent"), F.lit(None).cast("string").alias("step"), "entries"))


def parse_generated_entries(responses: DataFrame, response: str = "response") -> DataFrame:
    """Rows (run_id, ord, agent, text, tags, error): entries of a JSON array, fenced or not; a bad response or entry has an error."""
    fenced = F.nullif(F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    payload = strip(F.coalesce(fenced, F.col(response)))
    items = F.when(payload.startswith("["), F.from_json(payload, "array<struct<agent:string, knowledge:string, tags:string>>"))
    out = responses.select("run_id", F.posexplode_outer(F.coalesce(items, F.array(F.lit(None).cast("struct<agent:string, knowledge:string, tags:string>")))).alias("ord", "e"))
    agent, text = filled("e.agent"), filled("e.knowledge")
    error = F.when(F.col("ord").isNull(), F.lit(None)).when(F.col("e").isNull(), "not a JSON array").when(agent.isNull() | text.isNull(), "agent or knowledge missing")
    return out.where("ord is not null").select("run_id", "ord", agent.alias("agent"), text.alias("text"), parse_tags(F.col("e.tags")).alias("tags"), error.alias("error"))
