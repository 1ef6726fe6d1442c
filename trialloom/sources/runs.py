"""Readers and writers of run folders, knowledge files, results and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialloom.functions.folders import scratch
from trialloom.functions.numbering import number_within
from trialloom.functions.text import filled, first_filled, int_text, strip
from trialloom.operators.evaluation import run_cache_merge
from trialloom.operators.knowledge import parse_tags
from trialloom.sources.ranges import json_elements, read_csv_ranges
from trialloom.sources.store import BucketStore

TEXT_KEYS = ("knowledge", "text", "content", "value")
OWN_KEYS = ("agent", "name", *TEXT_KEYS, "tags", "id")
STEP_SCHEMA = "step int, agent string, result string, time double, knowledge string, knowledge_id string"
USAGE_SCHEMA = "timestamp long, model string, prompt_tokens long, completion_tokens long, total_tokens long"
_MESSAGE = "struct<role:string, content:string, name:string, code:string, agent:string, knowledge:string, knowledge_id:string, log:string>"
_TRIAL = "struct<trial:int, run_name:string, run_id:string, score:double, score_feedback:string, output:string, knowledge_used:array<struct<step:int, id:string, text:string>>>"
_SCORES = ", ".join(f"{n}:double" for n in ("no_klg_mean_score", "klg_mean_score", "no_klg_max_score", "klg_max_score", "no_klg_min_score", "klg_min_score", "mean_score_improvement", "max_score_improvement", "min_score_improvement"))
PROBLEM_SCHEMA = f"struct<id:string, problem:string, no_klg_trials:array<{_TRIAL}>, klg_trials:array<{_TRIAL}>, {_SCORES}>"
CACHED_SCHEMA = "struct<run_id:string, output:string, saved_at:string, msg_history:string>"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def _entry(values: Column, row: Column, csv: bool) -> list[Column]:
    """Columns of an entry from a map of its fields."""
    get = lambda k: F.try_element_at(values, F.lit(k))
    agent = filled(get("agent")) if csv else first_filled(get("agent"), get("name"))
    meta = F.map_filter(values, lambda k, v: ~k.isin(*OWN_KEYS) & v.isNotNull() & (v != ""))
    if csv:
        meta = F.map_concat(meta, F.create_map(F.lit("row_index"), row.cast("string")))
    given = F.nullif(get("id"), F.lit(""))
    return [F.coalesce(given, row.cast("string")).alias("id") if csv else given.alias("id"), agent.alias("agent"), first_filled(*[get(k) for k in TEXT_KEYS]).alias("text"), parse_tags(get("tags")).alias("tags"), meta.alias("meta")]


def read_knowledge(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Entries (id, agent, text, tags, meta) of csv, json or jsonl files; rows lacking agent or text go.

    A csv row without id gets its 1-based number, counted before rows go. A json document is a list, or
    has one under ``knowledge`` or ``entries``. Large csv and json files are read by many tasks."""
    if kind == "csv":
        raw = read_csv_ranges(spark, path)
        fields = [c for c in raw.columns if not c.startswith("_") and c != "row_index"]
        values = F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*[F.col(f"`{c}`") for c in fields]))
        rows = raw.select(values.alias("v"), "row_index")
    elif kind == "json":
        found = json_elements(spark, path).where("section is null or (section in ('knowledge', 'entries') and key is null)")
        # entries under "knowledge", if a document has both
        has = found.groupBy(F.col("file").alias("_f")).agg(F.max(F.coalesce(F.col("section") == "knowledge", F.lit(False))).alias("_k"))
        found = found.join(has, F.col("file") == F.col("_f")).where("section is null or not _k or section = 'knowledge'")
        rows = found.select(F.from_json("value", "map<string,string>").alias("v"), F.lit(None).cast("int").alias("row_index")).where("v is not null")
    elif kind == "jsonl":
        rows = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("v"), F.lit(None).cast("int").alias("row_index")).where("v is not null")
    else:
        raise ValueError("kind must be csv, json or jsonl")
    return rows.select(*_entry(F.col("v"), F.col("row_index"), kind == "csv")).where("agent is not null and text is not null")


def read_knowledge_pool(spark: SparkSession, path: str) -> DataFrame:
    """Entries (ord, id, agent, text, tags, step) of csv files, the strict way; step is an int or null."""
    raw = read_csv_ranges(spark, path)
    have = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    tags = have("tags")
    head = F.substring(strip(tags), 1, 1)
    listed = F.when(head == "[", F.from_json(tags, "array<string>"))
    other = F.when(strip(tags).rlike(r'^(true|false|null|-?\d+(\.\d+)?)$') | (head == "{"), F.array().cast("array<string>"))
    single = F.when(head == '"', F.array(F.get_json_object(F.concat(F.lit('{"t":'), tags, F.lit("}")), "$.t")))
    parts = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), strip), lambda t: t != "")
    out = raw.select(
        "_file", "row_index", have("id").alias("id"), filled(have("agent")).alias("agent"), strip(F.coalesce(F.nullif(have("knowledge"), F.lit("")), have("text"))).alias("text"),
        F.coalesce(listed, other, single, parts).alias("tags"), int_text(have("step")).cast("int").alias("step"),
    ).where("agent is not null and text <> ''")
    return number_within(out, "ord", ["_file"], "row_index").withColumn("ord", F.col("ord").cast("int")).select("ord", "id", "agent", "text", "tags", "step")


def normalize_pool_ids(pool: DataFrame) -> DataFrame:
    """The pool with whole-number ids; others become the place in the list."""
    return pool.withColumn("id", F.coalesce(int_text("id"), F.col("ord").cast("long")))


def write_knowledge(df: DataFrame, path: str) -> None:
    """Write (id, agent, knowledge, tags as JSON, step); rows lacking text or agent are skipped."""
    ok = df.where(filled("text").isNotNull() & filled("agent").isNotNull())
    ok.select("id", "agent", F.col("text").alias("knowledge"), F.to_json("tags").alias("tags"), F.col("step").cast("string").alias("step")).write.csv(path, header=True, escape='"', quoteAll=True, mode="overwrite")


def append_knowledge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows of one header together; with different headers both as (run_id, agent, knowledge, tags)."""
    if old.columns == new.columns:
        return old.unionByName(new)
    names = ["run_id", "agent", "knowledge", "tags"]
    have = lambda df: df.select(*[F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in names])
    return have(old).unionByName(have(new))


def append_to_knowledge(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Append (run_id, agent, knowledge, tags) to the csv files in ``path``.

    Files with another header, or none, are written anew with these columns first, by way of a table of their own."""
    names = ["run_id", "agent", "knowledge", "tags"]
    tags = F.to_json("tags") if dict(new.dtypes).get("tags", "").startswith("array") else F.coalesce(F.nullif(F.col("tags"), F.lit("")), F.lit("[]"))
    ready = new.select(*[F.coalesce(strip(F.col(c).cast("string")), F.lit("")).alias(c) for c in names[:3]], tags.alias("tags"))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    old = _csv(spark, path) if there else None
    if old is not None and old.columns and old.columns != names:
        held = scratch(spark, "knowledge")
        filled_rows = old.where(F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in old.columns]).isNotNull())
        append_knowledge(filled_rows.limit(0).select(), filled_rows).fillna("").withColumn("tags", F.coalesce(F.nullif(F.col("tags"), F.lit("")), F.lit("[]"))).write.parquet(held)
        spark.read.parquet(held).write.csv(path, header=True, escape='"', quoteAll=True, mode="overwrite")
    ready.write.csv(path, header=True, escape='"', quoteAll=True, mode="append")


def read_messages(spark: SparkSession, runs_dir: str) -> DataFrame:
    """Messages (run_id, seq, role, content, ...) of every run folder's messages.json; what is not an object goes, seq follows the rest."""
    found = json_elements(spark, f"{runs_dir}/run-*/messages.json").where("section is null")
    placed = number_within(found, "seq", ["file"], "start", "n").select(F.element_at(F.split("file", "/"), -2).alias("run_id"), (F.col("seq") - 1).cast("int").alias("seq"), F.from_json("value", _MESSAGE).alias("m"))
    return placed.select("run_id", "seq", "m.*")


def parse_messages(files: DataFrame) -> DataFrame:
    """Messages of run documents (run_id, value), as ``read_messages`` gives them; for logs kept many runs a file."""
    items = F.filter(F.from_json(F.when(strip("value").startswith("["), F.col("value")), "array<string>"), lambda x: strip(x).startswith("{"))
    return files.select("run_id", F.posexplode(items).alias("seq", "m")).select("run_id", "seq", F.from_json("m", _MESSAGE).alias("m")).select("run_id", "seq", "m.*")


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Step logs, a JSON object a line; blank and bad lines go."""
    return spark.read.schema(STEP_SCHEMA).json(path, mode="DROPMALFORMED").withColumn("run_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


_LIMIT = "struct<limit:bigint, consumed:bigint, hit:boolean, last_error:struct<limit:bigint, consumed:bigint>>"
DATASET_SCHEMA = f"schema_version int, run_id string, run_name string, input_messages array<{_MESSAGE}>, final_output string, steps array<struct<step:int, agent:string, result:string, time:double>>, model_info struct<name:string>, timestamps struct<started:double, ended:double>, token_limit {_LIMIT}"


def read_run_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The append-only run data set, a JSON object a line."""
    return spark.read.schema(DATASET_SCHEMA).json(path, mode="DROPMALFORMED")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trials, run_cache) of result files: a document with ``detail`` or a bare list of problems.

    Of the cached runs of one id the first whose history is a list counts, by file, then place; blank ids do not.
    A document is cut into problems and cached runs once, by many tasks if it is large, and both tables are made of these."""
    found = read_result_objects(spark, path)
    return result_trials(found), result_cache(found)


def read_result_objects(spark: SparkSession, path: str) -> DataFrame:
    """Problems and cached runs of result files, as a written table (file, start, n, section, key, value)."""
    held = scratch(spark, "results")
    json_elements(spark, path).where("section is null or section in ('detail', 'run_cache')").write.parquet(held)
    return spark.read.parquet(held)


def _problems(found: DataFrame) -> DataFrame:
    return found.where("coalesce(section, 'detail') = 'detail'").select(F.from_json("value", PROBLEM_SCHEMA).alias("d")).where("d is not null")


def result_trials(found: DataFrame) -> DataFrame:
    """Trials (problem_id, arm, trial, run_name, run_id, score, feedback, output, knowledge_used) of result objects."""
    arms = F.array(*[F.struct(F.lit(name).alias("arm"), F.col(f"d.{c}").alias("trials")) for c, name in (("no_klg_trials", "no_klg"), ("klg_trials", "klg"))])
    trials = _problems(found).select(F.col("d.id").alias("problem_id"), F.explode(arms).alias("a")).select("problem_id", "a.arm", F.explode("a.trials").alias("t"))
    return trials.select("problem_id", "arm", "t.trial", "t.run_name", "t.run_id", "t.score", F.col("t.score_feedback").alias("feedback"), "t.output", "t.knowledge_used")


def result_knowledge(found: DataFrame) -> DataFrame:
    """What trials used: (problem_id, arm, trial, run_id, score, step, knowledge_id, text), an entry a row, in no order."""
    used = result_trials(found).select("problem_id", "arm", "trial", "run_id", "score", F.explode("knowledge_used").alias("k"))
    return used.select("problem_id", "arm", "trial", "run_id", "score", "k.step", F.col("k.id").alias("knowledge_id"), "k.text")


def result_scores(found: DataFrame) -> DataFrame:
    """The scores that result files give for each problem, as ``problem_scores`` makes them."""
    names = [f"{a}_{s}" for s in ("mean", "max", "min") for a in ("no_klg", "klg")]
    return _problems(found).select(F.col("d.id").alias("problem_id"), *[F.col(f"d.{n}_score").alias(n) for n in names], F.col("d.mean_score_improvement").alias("improvement"))


def result_cache(found: DataFrame) -> DataFrame:
    """Cached runs, the first with a list as history of each run id: (run_id, entry_id, run_name, output, saved_at, msg_history)."""
    cache = found.where("section = 'run_cache'").select("file", "start", "n", "key", F.from_json("value", CACHED_SCHEMA).alias("c"))
    cache = cache.select("file", "start", "n", F.substring_index("key", "::", 1).alias("entry_id"), F.expr("substring(key, instr(key, '::') + 2)").alias("run_name"), "c.*")
    listed = cache.withColumn("run_id", strip("run_id")).where((F.col("run_id") != "") & F.col("msg_history").startswith("["))
    return listed.groupBy("run_id").agg(F.min_by(F.struct("entry_id", "run_name", "output", "saved_at", "msg_history"), F.struct("file", "start", "n")).alias("f")).select("run_id", "f.*")


_COUNTS = "struct<count:int, role_counts:map<string,bigint>>"
META_SCHEMA = (
    "struct<run_id:string, run_name:string, model:string, timings:struct<started_at:double, completed_at:double, total_sec:double>, usage:map<string,bigint>, max_steps:int, "
    f"token_limit_hit:boolean, stop_reason:string, input_messages:{_COUNTS}, message_history:{_COUNTS}>"
)


def read_meta(spark: SparkSession, runs_dir: str, pattern: str = "run-*/meta.json") -> DataFrame:
    """A row for each run folder's meta.json (small documents): (folder, modified, run_id, run_name, model, timings, usage, ...). Broken ones go."""
    files = spark.read.text(f"{runs_dir}/{pattern}", wholetext=True)
    return parse_meta(files.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"), F.col("_metadata.file_modification_time").alias("modified"), "value"))


def parse_meta(files: DataFrame) -> DataFrame:
    """Metadata of run documents (folder, modified, value), as ``read_meta`` gives it; for logs kept many runs a file."""
    whole = files.where(F.get_json_object("value", "$").isNotNull())
    return whole.select("folder", "modified", F.from_json("value", META_SCHEMA).alias("m")).select("folder", "modified", "m.*")


def run_cache_store(spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64) -> BucketStore:
    """The run cache as a table in buckets of its keys; ``merge_run_cache`` rewrites those that new runs touch."""
    return BucketStore(spark, path, keys, schema, buckets)


def merge_run_cache(store: BucketStore, new: DataFrame, payload: list[str], saved_at: str = "saved_at") -> list[int]:
    """Merge new runs into the cache as ``run_cache_merge`` does; returns the buckets that were written anew."""
    held = scratch(store.spark, "new-runs")
    new.select(*store.keys, *payload, saved_at).write.parquet(held)
    return store.merge(store.spark.read.parquet(held), lambda old, runs: run_cache_merge(old, runs, store.keys, payload, saved_at))


def write_training_sets(df: DataFrame, train: str, test: str, split: str = "split") -> None:
    """Two JSON-lines outputs by the split column."""
    df.where(F.col(split) == "train").drop(split).write.json(train, mode="overwrite")
    df.where(F.col(split) != "train").drop(split).write.json(test, mode="overwrite")


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=USAGE_SCHEMA)


def validate_tables(spark: SparkSession, wanted: DataFrame, path: str, limit: int = 5) -> DataFrame:
    """``judge_tables`` of the csv files named in ``wanted`` (file), found by their names below ``path``.

    Of each file only the first block is read, line by line. Names come from a listing on the driver, as Spark's
    sources skip files without a byte."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    lines = spark.read.text(path).select(name, F.col("_metadata.file_block_start").alias("_start"), "value").where("_start = 0").select("file", F.monotonically_increasing_id().alias("line"), "value")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, names = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        names.append((files.next().getPath().getName(),))
    listed = spark.createDataFrame(names, "file string")
    return judge_tables(wanted, listed, lines, limit)


def judge_tables(wanted: DataFrame, listed: DataFrame, lines: DataFrame, limit: int = 5) -> DataFrame:
    """Rows (file, verdict, preview) for each file of ``wanted`` (file).

    ``listed``: (file) the files there are; ``lines``: (file, line, value) their lines, in order of ``line``. Verdicts:
    missing, empty, blank header cell, header only, ok; the preview is the first limit + 1 lines. Header cells may be
    quoted, with commas and line ends within the quotes; blank lines after the header count as rows."""
    first = Window.partitionBy("file").orderBy("line")
    few = lines.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit + 1)
    few = few.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x.value), "\n").alias("text"))  # limit + 1 lines a file
    out = wanted.select("file").distinct().join(listed.select("file", F.lit(True).alias("_there")).distinct(), "file", "left").join(few, "file", "left")
    cell = r'"(?:[^"]|"")*"|[^",\n]*'
    header = F.regexp_extract("text", rf"\A(?:{cell})(?:,(?:{cell}))*", 0)
    cells = F.regexp_extract_all(header, F.lit(rf"(?:\A|,)({cell})"), F.lit(1))
    rest = F.substring("text", F.char_length(header) + 1, F.char_length("text"))
    verdict = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("text").isNull(), "empty")
        .when(F.exists(cells, lambda c: (c == "") | (c == '""')), "blank header cell").when(rest == "", "header only").otherwise("ok")
    )
    return out.select("file", verdict.alias("verdict"), F.coalesce("text", F.lit("")).alias("preview"))
