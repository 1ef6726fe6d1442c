"""Planning, expanding and validating evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.numbering import number_rows
from trialloom.functions.text import filled, seeded_order, strip

# Markers of patch texts.
BEGIN, END = "*** Begin Patch", "*** End Patch"
UPDATE, ADD, DELETE, MOVE = "*** Update File:", "*** Add File:", "*** Delete File:", "*** Move to:"


#: Payloads with more different keys are not a table's cells.
MOST_KEYS = 2000


def payload_keys(df: DataFrame, payload: str = "payload_json", most: int = MOST_KEYS) -> list[str]:
    """All keys of the payload objects, sorted, by one distinct aggregation; more than ``most`` of them are an error."""
    rows = df.select(F.explode(F.json_object_keys(payload)).alias("k")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{payload} has more than {most} different keys")
    return sorted(r.k for r in rows)


def expand_json_column(df: DataFrame, keys: list[str] | None = None, payload: str = "payload_json") -> tuple[DataFrame, DataFrame]:
    """(cells, meta): a text column for each key of the payloads, and the other columns.

    Booleans are lower case, nested values JSON, null "". Bad JSON, payloads that are no objects, and
    no keys at all are errors; an empty payload is an object without keys."""
    blank = filled(payload).isNull()
    bad = df.where(~blank & F.json_object_keys(payload).isNull()).limit(1).count()
    if bad:
        raise ValueError(f"{payload} must hold JSON objects")
    keys = payload_keys(df, payload) if keys is None else keys
    if not keys:
        raise ValueError(f"{payload} has no keys to expand")
    parsed = F.from_json(payload, "map<string,string>")
    cells = df.select(*[F.coalesce(F.try_element_at(parsed, F.lit(k)), F.lit("")).alias(k) for k in keys])
    return cells, df.drop(payload)


def completed_samples(records: DataFrame, n: int, topic: str = "Topic", sample: str = "SampleIndex", hyper: str = "HyperParamIndex") -> DataFrame:
    """(topic, sample) that have n or more distinct integer hyper-parameter indices."""
    done = records.groupBy(topic, sample).agg(F.countDistinct(F.col(hyper).try_cast("int")).alias("n"))
    return done.where(F.col("n") >= n).select(topic, sample)


def pending_samples(topics: DataFrame, samples: int, completed: DataFrame, topic: str = "Topic", sample: str = "SampleIndex") -> DataFrame:
    """The grid topic x sample without completed ones."""
    grid = topics.select(topic).distinct().withColumn(sample, F.explode(F.sequence(F.lit(1), F.lit(samples))))
    return grid.join(completed.select(topic, sample), [topic, sample], "left_anti")


def drop_stale(records: DataFrame, pending: DataFrame, topic: str = "Topic", sample: str = "SampleIndex") -> DataFrame:
    """Records without those of samples that are to be made again."""
    return records.join(pending.select(topic, sample), [topic, sample], "left_anti")


def expand_records(samples: DataFrame, artifacts: str) -> DataFrame:
    """One row for each artifact of a sample, numbered from 1."""
    rest = [c for c in samples.columns if c != artifacts]
    return samples.select(*rest, F.posexplode(artifacts).alias("_p", "artifact")).select(*rest, (F.col("_p") + 1).alias("artifact_index"), "artifact")


def select_files(listed: DataFrame, folder: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct paths in first order: folder content without what a rule excludes, then listed files.

    ``listed`` and ``folder``: (ord, path); ``rules``: (rule): ``dir/`` excludes by prefix, others by equal
    path or file name. Equal rules are joins; the folders of a path are exploded to meet prefix rules."""
    r = rules.select(strip("rule").alias("rule")).where("rule <> ''").distinct()
    name = F.substring_index("path", "/", -1)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    keys = folder.select("ord", "path", F.explode(F.array_distinct(F.concat(F.array("path", name), F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))))).alias("rule"))
    out = keys.join(r, "rule", "left_semi").select("ord", "path").distinct()
    kept = folder.join(out, ["ord", "path"], "left_anti")
    both = kept.select(F.lit(0).alias("src"), "ord", "path").unionByName(listed.select(F.lit(1).alias("src"), "ord", "path"))
    first = both.groupBy("path").agg(F.min(F.struct("src", "ord")).alias("at"))
    return first.select("path", "at.src", "at.ord")


def estimate_patch_count(text: Column) -> Column:
    """3 to 10 patches, one more for each 200 lines with text."""
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: strip(x) != ""))
    return F.greatest(F.lit(3), F.least(F.lit(10), 3 + F.floor((lines - 1) / 200))).cast("int")


def validate_patch(patch: Column, expected: Column) -> Column:
    """Why a patch is not valid; null if it is."""
    updates = F.filter(F.transform(F.split(patch, "\n"), strip), lambda x: x.startswith(UPDATE))
    path = strip(F.substring(F.get(updates, F.lit(0)), len(UPDATE) + 1, 1 << 30))
    return (
        F.when(patch.isNull() | (strip(patch) == ""), "patch is empty")
        .when(~patch.contains(BEGIN) | ~patch.contains(END), "begin or end marker missing")
        .when(patch.contains(ADD) | patch.contains(DELETE) | patch.contains(MOVE), "not an update only")
        .when(F.size(updates) != 1, "not exactly one update line")
        .when(path != expected, "other path than expected")
        .when(~patch.contains("@@") & ~patch.contains("<EDIT "), "edit marker missing")
    )


def validate_patches(bundles: DataFrame, patches: DataFrame) -> DataFrame:
    """Bundles (bundle_id, file_path, asked) with the first reason against one; patches: (bundle_id, ord, problem, answer, patch)."""
    p = patches.join(bundles.select("bundle_id", "file_path"), "bundle_id")
    reason = F.when(filled("problem").isNull(), "problem is empty").when(filled("answer").isNull(), "answer is empty").otherwise(validate_patch(F.col("patch"), F.col("file_path")))
    found = p.withColumn("_r", reason).groupBy("bundle_id").agg(F.count("*").alias("_n"), F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("ord"))).alias("_r"))
    out = bundles.join(found, "bundle_id", "left")
    return out.select(*bundles.columns, F.when(F.coalesce("_n", F.lit(0)) != F.col("asked"), "count differs").otherwise(F.col("_r")).alias("reason"))


def touched_paths(df: DataFrame, key: str, patch: str) -> DataFrame:
    """Rows (key, place, path): distinct paths after a patch's markers, in first order."""
    form = r"^\*\*\* (?:Update File|Add File|Delete File|Move to):(.*)$"
    lines = df.select(key, F.posexplode(F.split(patch, "\n")).alias("pos", "line"))
    paths = lines.select(key, "pos", F.when(strip("line").rlike(form), filled(F.regexp_extract(strip("line"), form, 1))).alias("path")).where("path is not null")
    first = paths.groupBy(key, "path").agg(F.min("pos").alias("pos"))
    return first.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("pos"))).alias("place"), "path")


def plan_regeneration(specs: DataFrame, records: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files to make, records that stay): files with fewer records than needed; their old records go. ``specs``: (file_path, needed)."""
    counts = records.groupBy("file_path").agg(F.count("*").alias("_n"))
    s = specs.join(counts, "file_path", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    todo = s if force else s.where(F.col("_n") < F.col("needed"))
    redo = todo if force else todo.where("_n > 0")
    return todo.select("file_path", "needed", F.col("_n").alias("recorded")), records.join(redo.select("file_path"), "file_path", "left_anti")


def assign_patch_index(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New patches numbered on from the largest N of the names patch*N*.txt."""
    top = existing.agg(F.coalesce(F.max(F.nullif(F.regexp_extract("name", r"^patch\D*(\d+)\D*\.txt$", 1), F.lit("")).try_cast("long")), F.lit(0)).alias("_top"))
    return number_rows(new, "_n", order).crossJoin(F.broadcast(top)).withColumn("patch_index", F.col("_top") + F.col("_n")).drop("_n", "_top")


def validate_rubric(items: Column, question: Column) -> Column:
    """Why a rubric (array of (requirement, score text)) is not valid, or its question names no search; null if all is well."""
    score = lambda i: F.when(strip(i.score).rlike(r"^[+-]?\d+$"), i.score).try_cast("int")
    total = F.aggregate(items, F.lit(0), lambda s, i: s + F.coalesce(score(i), F.lit(0)))
    return (
        F.when(items.isNull() | (F.size(items) == 0), "no items")
        .when(F.exists(items, lambda i: filled(i.requirement).isNull()), "requirement missing")
        .when(F.exists(items, lambda i: score(i).isNull()), "integer score missing")
        .when(F.exists(items, lambda i: score(i) <= 0), "score not positive")
        .when(total != 10, "scores do not sum to 10")
        .when(~F.coalesce(F.lower(question).contains("search"), F.lit(False)), "question without search")
    )


def sample_problems(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in hashed order."""
    return df.withColumn("_h", seeded_order(seed, *keys)).orderBy("_h", *keys).limit(n).drop("_h")


def rename_split(frames: dict[str, DataFrame], columns: dict[str, str], separator: str | None = None) -> DataFrame:
    """Union of splits with renamed columns and a ``split`` column; texts end before the separator."""
    out = None
    for name, df in frames.items():
        cut = lambda c: F.substring_index(c, separator, 1) if separator else F.col(c)
        part = df.select(*[(cut(a) if dict(df.dtypes)[a] == "string" else F.col(a)).alias(b) for a, b in columns.items()], F.lit(name).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


def number_paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, number, paragraph): blank-line-separated paragraphs with text, numbered from 1."""
    parts = F.filter(F.split(text, "\n\n"), lambda p: strip(p) != "")
    return df.select(key, F.posexplode(parts).alias("_p", "paragraph")).select(key, (F.col("_p") + 1).alias("number"), "paragraph")


def text_before_paragraph(text: Column, number: int | Column) -> Column:
    """The paragraphs before that number, "" if there is none of it."""
    parts = F.filter(F.split(text, "\n\n"), lambda p: strip(p) != "")
    n = F.lit(number) if isinstance(number, int) else number
    return F.when((n >= 1) & (n <= F.size(parts)), F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), "\n\n")).otherwise(F.lit(""))


def fenced_block(text: Column, language: str) -> Column:
    """The first fenced block of a language, stripped; null without one."""
    form = rf"(?s)```\Q{language}\E\s*(.*?)\s*```"
    return F.when(text.rlike(form), strip(F.regexp_extract(text, form, 1)))
