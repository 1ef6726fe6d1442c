"""Growing tables and streams: buckets that are rewritten alone, equal results after each batch."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from trialloom.operators import evaluation as ev
from trialloom.operators.pages import content_signature, normalize_url
from trialloom.sources.store import BucketStore
from trialloom.streaming import streams as st


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), ["k"], "k long, v string", buckets=8)
    assert store.read().count() == 0 and store.upsert(spark.createDataFrame([], "k long, v string")) == []
    rows = {k: "a" for k in [*range(200), None]}
    store.upsert(spark.createDataFrame([(k, v) for k, v in rows.items()], "k long, v string"))
    first = store.manifest()
    assert len(first) == 8
    changes = [(3, "b"), (3, "c"), (500, "d"), (None, "n")]
    touched = store.upsert(spark.createDataFrame(changes, "k long, v string"))
    second = store.manifest()
    assert {b for b in second if second[b] != first.get(b)} == set(touched) and len(touched) <= 3
    rows |= {3: "c", 500: "d", None: "n"}
    assert {r.k: r.v for r in store.read().collect()} == rows
    version = store.versions()[-1]
    store.upsert(spark.createDataFrame([(4, "x")], "k long, v string"), version=version + 1)
    store.upsert(spark.createDataFrame([(4, "y")], "k long, v string"), version=version + 1)  # a batch that runs again
    rows[4] = "y"
    assert {r.k: r.v for r in store.read().collect()} == rows
    assert {r.k: r.v for r in store.read(version).collect()} == rows | {4: "a"}
    folders = {f"data/{d}/{b}" for d in os.listdir(tmp_path / "s" / "data") for b in os.listdir(tmp_path / "s" / "data" / d) if b.startswith("bucket=")}
    assert folders == {f for v in store.versions() for f in store.manifest(v).values()}


TRIAL = "problem_id long, arm string, trial long, score double, feedback string"


def put(path, batch, rows):
    """One file, later than those before."""
    os.makedirs(path, exist_ok=True)
    names = [f.split()[0] for f in TRIAL.split(", ")] if len(rows[0]) == 5 else ["page_id", "url", "text"]
    file = f"{path}/{batch:04d}.json"
    with open(file, "w") as f:
        f.write("\n".join(json.dumps(dict(zip(names, r))) for r in rows) + "\n")
    os.utime(file, (1_700_000_000 + batch, 1_700_000_000 + batch))


def test_summary_after_each_batch_equals_batch(spark, tmp_path):
    """New trials, better scores, scores taken back, invalid ones, null ids and arms, one hot problem."""
    rng = random.Random(7)
    known = {}
    for batch in range(5):
        rows = []
        for _ in range(120):
            problem = rng.choice([None, 0, 0, 0, *range(1, 12)])
            rows.append((problem, rng.choice(["no_klg", "klg", "klg", "other"]), rng.randrange(25), rng.choice([None, 0.0, 0.0, 2.5, 7.25, 10.0]), rng.choice([None, " ", "ok"])))
        rows = list({r[:3]: r for r in rows}.values())
        known |= {r[:3]: r for r in rows}
        put(str(tmp_path / "in"), batch, rows)
        s = st.stream_json(spark, str(tmp_path / "in"), TRIAL, 1)
        st.start_summary(s, str(tmp_path / "state"), str(tmp_path / "sum"), str(tmp_path / "c"), slices=3, buckets=4).awaitTermination()
        got = st.latest_summary(spark, str(tmp_path / "sum")).collect()
        expected = ev.evaluation_summary(ev.problem_scores(ev.valid_trials(spark.createDataFrame(list(known.values()), TRIAL)))).collect()
        assert got == expected


def test_trial_repeated_in_a_batch_and_order(spark, tmp_path):
    rows = [(1, "klg", 1, 5.0, "a"), (1, "klg", 1, 3.0, "b"), (1, "no_klg", 1, 0.0, None)]
    put(str(tmp_path / "in"), 0, rows)
    s = st.stream_json(spark, str(tmp_path / "in"), TRIAL, 1)
    st.start_summary(s, str(tmp_path / "state"), str(tmp_path / "sum"), str(tmp_path / "c")).awaitTermination()
    got = st.latest_summary(spark, str(tmp_path / "sum")).first()
    assert (got.total_problems, got.klg_mean_mean, got.no_klg_mean_mean) == (1, 5.0, 0.0)


def test_work_of_a_batch_follows_its_problems(spark, tmp_path):
    """A batch of one problem rewrites one bucket of slices, however much came before."""
    put(str(tmp_path / "in"), 0, [(p, "klg", t, 5.0, "a") for p in range(300) for t in range(3)])
    run = lambda: st.start_summary(st.stream_json(spark, str(tmp_path / "in"), TRIAL, 1), str(tmp_path / "state"), str(tmp_path / "sum"), str(tmp_path / "c"), slices=2, buckets=32).awaitTermination()
    run()
    from trialloom.sources.store import BucketStore

    store = BucketStore(spark, str(tmp_path / "state" / "slices"), ["problem_id"], f"problem_id long, slice int, trials long, {st.STATS}", 32)
    for batch in range(1, 4):
        before = store.manifest()
        put(str(tmp_path / "in"), batch, [(batch, "no_klg", 0, 7.0, "a")])
        run()
        after = store.manifest()
        assert sum(after[b] != before.get(b) for b in after) == 1
    got = st.latest_summary(spark, str(tmp_path / "sum")).first()
    assert (got.total_problems, got.mean_win, got.mean_loss) == (300, 297, 3)


def test_trials_are_held_in_buckets(spark, tmp_path):
    """A batch of one trial rewrites one bucket of trials; taken back, the trial goes. No problem takes a Python call of its own."""
    put(str(tmp_path / "in"), 0, [(p, "klg", t, 5.0, "a") for p in range(2000) for t in range(2)])

    def run():
        query = st.start_summary(st.stream_json(spark, str(tmp_path / "in"), TRIAL, 1), str(tmp_path / "state"), str(tmp_path / "sum"), str(tmp_path / "c"), slices=2, buckets=32)
        query.awaitTermination()
        return query.lastProgress

    assert not run()["stateOperators"]
    store = BucketStore(spark, str(tmp_path / "state" / "trials"), ["problem_id", "slice"], "problem_id long, slice int, arm string, trial long, score double", 32)
    before = store.manifest()
    put(str(tmp_path / "in"), 1, [(7, "klg", 0, 0.0, " ")])
    run()
    after = store.manifest()
    assert sum(after[b] != before.get(b) for b in after) == 1
    assert store.read().count() == 3999 and [r.trial for r in store.read().where("problem_id = 7").collect()] == [1]
    assert st.latest_summary(spark, str(tmp_path / "sum")).first().total_problems == 2000


def one_pass(rows):
    urls, contents, kept = set(), set(), []
    for page, url, signature in sorted(rows):
        if url not in urls:
            urls.add(url)
            if signature not in contents:
                contents.add(signature)
                kept.append(page)
    return kept


@pytest.mark.parametrize("sizes", [[40], [1, 39], [13, 14, 13], [8] * 5])
def test_unseen_pages_for_any_split(spark, tmp_path, sizes):
    rng = random.Random(3)
    rows = [(i, rng.choice(["http://www.a.org/", "https://a.org", "b.org/x?utm_a=1", "https://b.org/y", "", None, f"https://c.org/{i % 7}"]), rng.choice([None, "", "x  y", "x y", f"t{i % 9}"])) for i in range(40)]
    at = 0
    for k, n in enumerate(sizes):
        put(str(tmp_path / "in"), k, rows[at : at + n])
        at += n
    s = st.stream_json(spark, str(tmp_path / "in"), "page_id long, url string, text string", 1)
    st.start_unseen_pages(s, str(tmp_path / "t"), str(tmp_path / "h"), str(tmp_path / "c"), ["page_id"], buckets=4).awaitTermination()
    got = sorted(r.page_id for r in spark.read.parquet(str(tmp_path / "t")).collect())
    df = spark.createDataFrame(rows, "page_id long, url string, text string")
    marked = [tuple(r) for r in df.select("page_id", normalize_url("url"), content_signature(F.coalesce("text", F.lit("")))).collect()]
    assert got == one_pass(marked)


def test_cache_merge_rewrites_its_buckets(spark, tmp_path):
    from trialloom.sources import runs as src

    schema = "k long, output string, saved_at long"
    old = spark.range(400).selectExpr("id as k", "'o' as output", "id as saved_at")
    store = src.run_cache_store(spark, str(tmp_path / "c"), ["k"], schema, 32)
    src.merge_run_cache(store, old, ["output"])
    before = store.manifest()
    new = spark.createDataFrame([(5, "o", 1000), (6, "n", 1001), (7, "n", 1), (900, "n", 2)], schema)
    touched = src.merge_run_cache(store, new, ["output"])
    after = store.manifest()
    assert {b for b in after if after[b] != before.get(b)} == set(touched) and len(touched) <= 4
    got = {tuple(r) for r in store.read().collect()}
    assert got == {tuple(r) for r in ev.run_cache_merge(old, new, ["k"], ["output"]).collect()}
    assert (5, "o", 5) in got and (6, "n", 1001) in got and (7, "o", 7) in got
