"""Hand-made frames for edge rules: nulls, ties, thresholds, truncation, random operators."""

import pytest
from pyspark.sql import functions as F

from trialloom.functions import text as tx
from trialloom.functions import pairing
from trialloom.operators import datasets as ds
from trialloom.operators import evaluation as ev
from trialloom.operators import knowledge as kn
from trialloom.operators import messages as ms
from trialloom.operators import pages as pg
from trialloom.operators import preference as pr
from trialloom.operators import retrieval as rt
from trialloom.operators import telemetry as tm


@pytest.fixture(scope="module")
def history(spark):
    rows = [("r", 0, "user", "ask", None), ("r", 1, "system", "hint", None), ("r", 2, "agent", "first", None), ("r", 3, "agent", "second", None), ("r", 4, "assistant", "done", None)]
    return spark.createDataFrame(rows, "run_id string, seq long, role string, content string, name string")


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_prefixes(history):
    assert seqs(history) == [0, 1, 2, 3, 4]
    assert seqs(ms.prefix_through_step(history, 1)) == [0, 1, 2]
    assert seqs(ms.prefix_through_step(history, 2)) == [0, 1, 2, 3]
    assert seqs(ms.prefix_through_step(history, 9)) == [0, 1, 2, 3, 4]
    assert seqs(ms.prefix_before_step(history, 1)) == [0, 1]
    assert seqs(ms.prefix_before_step(history, 2)) == [0, 1, 2]
    with pytest.raises(ValueError):
        ms.prefix_through_step(history, 0)


def test_broad_agent_rule(spark):
    df = spark.createDataFrame([("r", 0, "system", "x"), ("r", 1, "system", ""), ("r", 2, "AGENT", None), ("r", 3, None, "x")], "run_id string, seq int, role string, agent string")
    got = {r.seq: r.f for r in df.select("seq", ms.is_agent(df).alias("f")).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False}
    assert not df.where(ms.is_agent(df, broad=False)).where("seq = 0").count()


def test_flatten(history):
    flat = ms.flatten_conversation(history, system="SYS").orderBy("pos").collect()
    late = "<AGENT OUTPUT STEP 1>first</AGENT OUTPUT STEP 1>\n\n<AGENT OUTPUT STEP 2>second</AGENT OUTPUT STEP 2>"
    assert [(r.role, r.content) for r in flat] == [("user", f"SYS\n\n\n<USER>ask</USER>\n\n<USER_SYSTEM>hint</USER_SYSTEM>\n\n{late}"), ("assistant", "done")]
    dropped = ms.flatten_conversation(history, drop_system=True).where("role = 'user'").first().content
    assert "hint" not in dropped


def test_flatten_without_user(spark):
    df = spark.createDataFrame([("r", 0, "agent", "a"), ("r", 1, "assistant", "b")], "run_id string, seq int, role string, content string")
    assert [(r.role, r.content) for r in ms.flatten_conversation(df).collect()] == [("assistant", "b")]


def test_truncation(spark):
    df = spark.createDataFrame([("abc  defgh",), ("abc",), (None,)], "t string")
    got = [tuple(r) for r in df.select(tx.clip("t", 5), tx.clip_within("t", 8), tx.clip_marked("t", 4), tx.clip_plain("t", 5)).collect()]
    assert got[0] == ("abc...", "abc...", "[CON", "abc  ...") and got[1] == ("abc",) * 4 and got[2] == (None,) * 4


def test_judgements(spark):
    texts = ['{"score": 11, "feedback": "x"}', "```json\n{\"score\": \"7.5\"}\n```", 'so {"score": -1, "rationale": " y "} it is', "no", '{"score": null}', "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    got = {r.i: (r.score, r.feedback) for r in ev.parse_judgement(df).collect()}
    assert got == {0: (10.0, "x"), 1: (7.5, ""), 2: (0.0, "y"), 3: (0.0, ""), 4: (0.0, ""), 5: (0.0, ""), 6: (0.0, "")}


def test_scores_and_summary(spark):
    t = spark.createDataFrame([(1, "klg", 1, 6.0, "f"), (1, "klg", 2, 0.0, " "), (1, "no_klg", 1, 4.0, "f"), (2, "klg", 1, 0.0, "bad"), (2, "klg", 2, None, None)], "problem_id int, arm string, trial int, score double, feedback string")
    s = {r.problem_id: r for r in ev.problem_scores(ev.valid_trials(t)).collect()}
    assert (s[1].klg_mean, s[1].no_klg_mean, s[1].improvement) == (6.0, 4.0, 2.0)
    assert (s[2].klg_mean, s[2].no_klg_mean) == (0.0, 0.0)
    total = ev.evaluation_summary(ev.problem_scores(ev.valid_trials(t))).first()
    assert (total.total_problems, total.mean_win, total.mean_tie, total.mean_loss) == (2, 1, 1, 0)
    empty = ev.evaluation_summary(ev.problem_scores(t.limit(0))).first()
    assert empty.total_problems == 0 and empty.klg_mean_mean == 0.0


def test_pairs_are_strict(spark):
    g = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.5), (1, 2, 2.1), (1, 3, None)], "group int, idx int, score double")
    assert [(r.winner, r.loser) for r in pr.comparison_pairs(g).orderBy("i", "j").collect()] == [(2, 0), (2, 1)]
    best = pr.running_best_pairs(g, "group", "idx", "score").collect()
    assert sorted((r.winner, r.loser) for r in best) == [(1, 0), (2, 1)]


def test_batches(spark):
    items = spark.range(0, 23).selectExpr("id % 2 as p", "id % 5 as m", "id as s")
    b = pr.balanced_batches(items, "p", "m", "s", 5, 3)
    sizes = b.groupBy("p", "batch").agg(F.count("*").alias("n"), F.countDistinct("s").alias("d"), F.countDistinct("slot").alias("slots")).collect()
    assert all(r.n == 5 and r.d == 5 and r.slots == 5 for r in sizes)
    assert b.where("not repeat").select("s").distinct().count() == 23
    again = pr.balanced_batches(items.repartition(7), "p", "m", "s", 5, 3)
    assert sorted(map(tuple, b.collect())) == sorted(map(tuple, again.collect()))
    tiny = pr.balanced_batches(items.limit(1), "p", "m", "s", 5, 3)
    assert tiny.count() == 5 and tiny.select("slot").distinct().count() == 5


def test_split_is_exact_and_stable(spark):
    df = spark.range(1003)
    a = pr.train_test_split(df, 0.1, 7, "id")
    assert a.where("split = 'train'").count() == 902 and a.select("id").distinct().count() == 1003
    b = pr.train_test_split(df.repartition(9), 0.1, 7, "id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert pr.train_test_split(df, 2.0, 7, "id").where("split = 'train'").count() == 0


def test_rewards(spark):
    r = spark.createDataFrame([(1, 2.5), (1, 3.5), (2, None), (2, 4.0), (3, 12.0)], "g int, x double")
    assert [v[0] for v in r.select(pr.reward_score(F.col("x"))).collect()] == [2.0, 4.0, None, 4.0, 10.0]
    adv = pr.group_advantage(r, "g", "x").collect()
    assert all(a.advantage == 0 for a in adv if a.g != 1)
    assert sorted(round(a.advantage, 3) for a in adv if a.g == 1) == [-1.0, 1.0]


def test_step_specs(spark):
    specs = ["2", ">=2", "<4", ">=1,<=3", "1,3", "abc", None, " ", "==2,x", "0", "-1,2"]
    e = spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, step string")
    got = {}
    for r in kn.match_steps(e, 4).collect():
        got.setdefault(r.i, set()).add(r.at_step)
    everything = {1, 2, 3, 4}
    assert got == {0: {2}, 1: {2, 3, 4}, 2: {1, 2, 3}, 3: {1, 2, 3}, 4: {1, 3}, 6: everything, 7: everything, 8: {2}, 10: {2}}


def test_ids(spark):
    df = spark.createDataFrame([("7", "t"), ("kb-17", "t"), ("0", "t"), ("3.0", "t"), (None, "t"), ("1", " ")], "id string, text string")
    assert [r.id for r in kn.normalize_entries(df).collect()] == [7, 17, None, 3, None]


def test_threshold(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, text string")
    new = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, "E")], "id int, text string")
    delta = spark.createDataFrame([(1, 0.5, 0.75), (2, 0.5, 0.6), (4, 0.5, 0.9), (5, None, 0.9)], "id int, baseline double, rerun double")
    got = {r.id: (r.text, r.decision) for r in kn.apply_threshold(old, new, delta, 0.1).collect()}
    assert got[1] == ("A", "keep") and got[3] == ("c", "revert") and got[4] == ("D", "keep") and 5 not in got


def test_weighted_sample(spark):
    scored = spark.range(0, 40).selectExpr("id % 2 as query_id", "id as key_id", "cast(-id as double) as relevance")
    top = rt.top_k_keys(scored, 8)
    assert rt.rank_weighted_sample(top, 3, 8, decay=0.0).where("rank > 3").count() == 0
    s = rt.rank_weighted_sample(top, 3, 8, decay=0.9, seed=4)
    assert s.count() == 6 and s.dropDuplicates(["query_id", "key_id"]).count() == 6
    w = rt.rank_weighted_sample(top, 2, 8, weights=[0.0, 0.0, 1.0, 0.0])
    assert sorted(r.rank for r in w.where("query_id = 0").collect()) == [1, 3]


def test_block_scores_equal_join(spark):
    v = spark.range(0, 300).selectExpr("id", "array(cast(id % 7 as double), cast(id % 5 as double), 1.0D) as vector")
    got = rt.block_scores(v.where("id < 20"), v, 4, "id", "id")
    a, b = v.where("id < 20").selectExpr("id as query_id", "vector as x"), v.selectExpr("id as key_id", "vector as y")
    pairs = a.crossJoin(b).selectExpr("query_id", "key_id", "aggregate(zip_with(x, y, (p, q) -> p * q), 0.0D, (s, t) -> s + t) as relevance")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rt.top_k_keys(pairs, 4).collect()))


def test_all_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairing, "BROADCAST_BYTES", 3)
    monkeypatch.setattr(pairing, "BLOCK_ROWS", 4)
    got = pairing.all_pairs(spark.range(11).selectExpr("id as a"), spark.range(9).selectExpr("id as b"))
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(11) for b in range(9)]


def test_urls(spark):
    urls = {
        "http://WWW.Example.com/a/": "https://example.com/a", "https://x.org/": "https://x.org/", "https://x.org": "https://x.org", "http://x.org/p?utm_a=1&b=2#f": "https://x.org/p?b=2",
        "https://x.org/?utm_source=q": "https://x.org/", " no host ": "no host", "": "", None: "", "ftp://a.b/c?x": "ftp://a.b/c?x=",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(pg.normalize_url("u")).collect()] == list(urls.values())


def test_empty_history_passes_everything(spark):
    r = spark.createDataFrame([(1, 1, "http://a.b/"), (1, 2, "http://a.b/")], "query_id int, pos int, url string")
    assert pg.filter_visited(r, r.select("url").limit(0)).count() == 2
    assert pg.filter_visited(r, spark.createDataFrame([("https://x.y",)], "url string")).count() == 1


def test_budget(spark):
    c = spark.createDataFrame([("r", 1, 5), ("r", 2, 6), ("r", 3, 1)], "run_id string, seq int, tokens long")
    got = [(r.seq, r.accepted, r.consumed, r.hit) for r in tm.token_budget(c, 10).orderBy("seq").collect()]
    assert got == [(1, True, 5, True), (2, False, 5, True), (3, False, 5, True)]
    assert tm.token_budget(c, 0).where("accepted").count() == 3


def test_expand_errors(spark):
    bad = spark.createDataFrame([("[1]", 1)], "payload_json string, x int")
    with pytest.raises(ValueError):
        ds.expand_json_column(bad)
    with pytest.raises(ValueError):
        ds.expand_json_column(spark.createDataFrame([("{}", 1)], "payload_json string, x int"))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "run_id string, seq int, role string, content string, name string")
    assert ms.flatten_conversation(none).count() == 0
    assert ms.step_prompts(none, none.selectExpr("run_id", "seq as step", "content as text")).count() == 0
    assert pr.comparison_pairs(spark.createDataFrame([], "group int, idx int, score double")).count() == 0
