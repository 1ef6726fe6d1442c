"""Queries on rows as large tables have them: ids of six and seven digits, deep trees, many runs."""

import os

import pytest
from pyspark.sql import functions as F

from tests.compare import TABLES, duck, rows_of, sql_rows
from trialloom.operators import evaluation as ev
from trialloom.operators import knowledge as kn
from trialloom.operators import retrieval as rt
from trialloom.plans import logs, registry
from trialloom.sources import ranges
from trialloom.sources import runs as src


def folder_with(sf_dir, path, **tables):
    """The driver's tables in a folder of their own, with some of them given as data frames."""
    os.makedirs(path, exist_ok=True)
    for t in TABLES:
        place = f"{path}/{t}.parquet"
        if t in tables:
            tables[t].coalesce(1).write.parquet(place)
        else:
            os.symlink(f"{sf_dir}/{t}.parquet", place)
    return str(path)


def same_as_sql(spark, folder, name):
    got, expected = rows_of(registry.QUERIES[name](spark, folder)), sql_rows(duck(folder), registry.ORACLE_SQL[name])
    assert got == expected
    return got[1]


def test_flatten_attempts_of_any_depth(spark, sf_dir, tmp_path):
    line, at = set(range(21)), 5_999_999
    while at > 20:
        line.add(at)
        at //= 8
    e = spark.read.parquet(f"{sf_dir}/events.parquet").limit(1).drop("event_id").crossJoin(spark.createDataFrame([(i,) for i in line], "event_id long"))
    rows = same_as_sql(spark, folder_with(sf_dir, tmp_path / "d", events=e), "flatten_attempts")
    assert max(int(r[0]) for r in rows) == 8
    with pytest.raises(ValueError):  # a circle beside a long line
        ev.flatten_attempts(spark.createDataFrame([*[(i, i - 1 if i else None) for i in range(40)], (50, 51), (51, 52), (52, 50), (53, 50)], "node long, parent long"))


def test_token_budget_of_many_parts(spark, sf_dir, tmp_path):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + 1_000_000 * (F.col("l_suppkey") % 3))  # noqa: E741
    same_as_sql(spark, folder_with(sf_dir, tmp_path / "d", lineitem=l), "token_budget")


def test_ids_and_ties_past_a_million(spark):
    """Where the SQL's texts of five digits and packed keys end (REPLY_r03.md)."""
    e = spark.createDataFrame([(99_999,), (100_000,), (1_000_002,)], "idx long")
    assert [r.entry_id for r in ev.entry_id(e, "idx").orderBy("idx").collect()] == ["idx_99999", "idx_100000", "idx_1000002"]
    tries = spark.createDataFrame([(1, 10, "a", 5000, "t"), (1, 2_000_000, "b", 5001, "t"), (1, 3_000_000, "c", 5001, "t")], "p long, i long, run_id string, score long, text string")
    assert kn.best_knowledge(tries, "p", "i").first().run_id == "b"


def test_pairs_cost_what_their_parts_do(spark, monkeypatch):
    """Scores by parts are those of whole prompts, and no text meets another."""
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["", None, " q\u00e9 ", "<query>x</query>", "\n"])], "query_id long, query string")
    k = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("k", ["a", " "]), (None, ["a"]), (" ", None), ("<key>y</key>", ["b"]), ("z" * 900, [])])], "key_id long, key string, tags array<string>")
    score = lambda n: (n * 7 % 13).cast("double")
    whole = rt.score_pairs(q, k, lambda prompt: score(F.char_length(prompt)))
    met, pairs = [], rt.all_pairs
    monkeypatch.setattr(rt, "all_pairs", lambda a, b: met.append((dict(a.dtypes)["_q"], dict(b.dtypes)["_k"])) or pairs(a, b))
    parts = rt.score_pairs(q, k, lambda a, b: score(rt.prompt_chars(a, b)), part=F.char_length)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 25
    assert met == [("int", "int")]


def test_nearest_unseen_joins_once(spark):
    s = spark.createDataFrame([(1, 1, 9.0), (1, 2, 8.0), (1, 3, 7.0), (1, 4, 7.0), (2, 1, 1.0), (3, 1, None), (4, 5, 2.0)], "query_id long, key_id long, relevance double")
    gone, kept = s.where("query_id = 1 and key_id < 2 or query_id = 2"), s.where("query_id = 1 and key_id <= 2")
    out = rt.nearest_unseen(s, gone.union(gone), kept)
    assert sorted(map(tuple, out.collect())) == [(1, 3, 7.0), (3, 1, None), (4, 5, 2.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1


def test_meta_of_many_runs_is_few_files(spark, sf_dir, tmp_path, monkeypatch):
    """Files and folders do not grow with the runs; documents in folders give the same rows."""
    made = []
    monkeypatch.setattr(logs, "scratch", lambda spark, name: made.append(str(tmp_path / name)) or made[-1])
    rows = registry.QUERIES["read_meta"](spark, sf_dir).count()
    files = [f for _, _, names in os.walk(made[0]) for f in names if f.endswith(".parquet")]
    assert rows > 10 > len(files)
    docs = ['{"run_id": "a", "usage": {"total_tokens": 3}}', "{broken", '{"timings": {"started_at": 1.5}}']
    for i, d in enumerate(docs):
        (tmp_path / f"run-{i}").mkdir()
        (tmp_path / f"run-{i}" / "meta.json").write_text(d)
    kept = src.parse_meta(spark.createDataFrame([(f"run-{i}", None, d) for i, d in enumerate(docs)], "folder string, modified timestamp, value string"))
    assert sorted(map(str, kept.drop("modified").collect())) == sorted(map(str, src.read_meta(spark, str(tmp_path)).drop("modified").collect()))


def test_whole_files_are_read_once(spark, tmp_path):
    """A file that is one range has no state to be summed up before it is cut."""
    (tmp_path / "a.json").write_text(' \n[{"a": "}"}, {"b": {"c": 1}}]')
    (tmp_path / "b.json").write_text('{"detail": [{"a": 1}], "run_cache": {"k": {"b": 2}}}')
    assert ranges._range_states(ranges._pieces(spark, str(tmp_path), "}"), lambda start, texts: {}).count() == 0
    got = sorted((r.section or "", r.key or "", r.value) for r in ranges.json_elements(spark, str(tmp_path)).collect())
    assert got == [("", "", '{"a": "}"}'), ("", "", '{"b": {"c": 1}}'), ("detail", "", '{"a": 1}'), ("run_cache", "k", '{"b": 2}')]
