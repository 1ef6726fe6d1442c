"""Queries without SQL against plain versions, and cases that the driver's tables do not reach."""

import hashlib
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from trialloom.functions.numbering import number_rows
from trialloom.functions.text import seeded_uniform
from trialloom.functions import pairing
from trialloom.operators import evaluation as ev
from trialloom.operators import preference as pr
from trialloom.operators import retrieval as rt
from trialloom.plans import registry
from trialloom.plans.knowledge import _scored
from trialloom.sources import runs as src


def test_rank_weighted_sample(spark, sf_dir):
    """Keys by the largest ln(u) / weight of the five best, u being the same hash."""
    u = {(r.query_id, r.key_id): (r.relevance, r.u) for r in _scored(spark, sf_dir).withColumn("u", seeded_uniform(2, "query_id", "key_id")).collect()}
    expected = set()
    for q in {q for q, _ in u}:
        best = sorted((-r, k) for (x, k), (r, _) in u.items() if x == q)[:5]
        drawn = sorted((-math.log(u[q, k][1]) / 0.5**i, i + 1, k) for i, (_, k) in enumerate(best))[:3]
        expected |= {(q, k, rank, pick + 1) for pick, (_, rank, k) in enumerate(drawn)}
    got = {(r.query_id, r.key_id, r.rank, r.pick) for r in registry.QUERIES["rank_weighted_sample"](spark, sf_dir).collect()}
    assert got == expected and {r[2] for r in got} > {1, 2, 3}


def test_run_cache_keeps_first_history(spark, tmp_path):
    run = lambda i, h: {"run_id": i, "output": h[0] if h else "", "msg_history": h}
    cache = {"y::a": run("1", "text"), "z::a": run("1", ["first"]), "a::a": run(" 1 ", ["second"]), "b::a": run(" ", ["blank"]), "c::b::2": run("2", [])}
    (tmp_path / "r.json").write_text(json.dumps({"detail": [], "run_cache": cache}))
    got = {r.run_id: (r.entry_id, r.run_name, r.output) for r in src.read_results(spark, str(tmp_path))[1].collect()}
    assert got == {"1": ("z", "a", "first"), "2": ("c", "b::2", "")}


def test_tables_in_files(spark, tmp_path):
    files = {"a.csv": '"x,",y\n1,2\n', "b.csv": '"x\ny",z\n1,2\n', "c.csv": "x,,y\n1,2,3\n", "d.csv": 'x,""\n1,2\n', "e.csv": "x,y\n", "f.csv": "", "g.csv": "x\n\n", "h.csv": "\nx\n1\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    wanted = spark.createDataFrame([(n,) for n in [*files, "none.csv"]], "file string")
    got = {r.file[0]: r.verdict for r in src.validate_tables(spark, wanted, str(tmp_path)).collect()}
    assert got == {"a": "ok", "b": "ok", "c": "blank header cell", "d": "blank header cell", "e": "header only", "f": "empty", "g": "ok", "h": "blank header cell", "n": "missing"}


def test_messages_in_folders(spark, tmp_path):
    for run in (1, 2):
        (tmp_path / f"run-{run}").mkdir()
        (tmp_path / f"run-{run}" / "messages.json").write_text(json.dumps(["stray", {"role": "user", "content": f"c{run}"}, {"role": "system", "content": "é\n"}]))
    got = sorted((r.run_id, r.seq, r.role, r.content) for r in src.read_messages(spark, str(tmp_path)).collect())
    assert got == [(f"run-{k}", s, r, c) for k in (1, 2) for s, r, c in ((0, "user", f"c{k}"), (1, "system", "é\n"))]


def test_deep_trees(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(8)], "node int, parent int")
    assert [(r.root, r.leaf, len(r.path)) for r in ev.flatten_attempts(chain).collect()] == [(0, 7, 8)]
    assert [(r.root, r.leaf) for r in ev.flatten_attempts(chain, 7).collect()] == [(0, 7)]
    with pytest.raises(ValueError):
        ev.flatten_attempts(chain, 6)


def test_numbers_and_samples(spark):
    df = spark.range(5000).withColumn("k", F.xxhash64("id") % 50)
    got = [(r.k, r.id, r.n) for r in number_rows(df, "n", "k", F.desc("id")).collect()]
    assert [n for *_, n in sorted(got, key=lambda r: (r[0], -r[1]))] == list(range(1, 5001))
    assert number_rows(df.limit(0), "n", "id").count() == 0
    assert pr.subsample(df, 0.1, 3, "id").count() == 500 and pr.subsample(df, 0.0, 3, "id").count() == 1
    assert pr.subsample(df, 0.01, 3, "id", multiple=8).count() == 48 and pr.subsample(df.limit(0), 0.5, 3, "id").count() == 0


def test_pairs_in_blocks(spark, monkeypatch):
    q = spark.createDataFrame([(i, "q" * i) for i in range(30)], "query_id int, query string")
    k = spark.createDataFrame([(i, "k" * i) for i in range(50)], "key_id int, key string")
    expected = sorted(map(tuple, pairing.all_pairs(q, k).select("query_id", "key_id").collect()))
    monkeypatch.setattr(pairing, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(pairing, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, pairing.all_pairs(q, k).select("query_id", "key_id").collect())) == expected and len(expected) == 1500


def test_page_text(spark, sf_dir):
    from trialloom.operators.pages import page_text

    page = (
        "<html><head><title>T</title></head><body><h2>A  <b>head</b></h2><p>x<sup>2</sup> &amp; y<sub class='i'>k</sub> 【n】 😀</p><ul><li><a href='/a'>one</a></li><li><a href='http://o.org/b'>t†wo</a></li></ul>"
        "<a href='/a'>again</a> <a href='#s'>here</a> <a href='mailto:m'>mail</a> <a href='/c'></a><br>end<script>no()</script><math><mi>q</mi></math> <img alt='pic'><img src='z'></body>"
    )
    rows = spark.createDataFrame([(page, "http://h.org/p"), (None, "u"), ("", None), ("<a href='/a'>one</a>", None)], "html string, url string")
    got = [r[0] for r in rows.select(page_text("html", "url")).collect()]
    assert got[0] == "## A head\n\nx^{2} & y_{k} 〖n〗\n\n  * 【0†one】\n  * 【1†t‡wo†o.org】\n\n【0†again】 here mail\nend [Image 0: pic][Image 1]"
    assert got[1:] == [None, "", "one"]
    # every page's words are there, but for scripts and styles
    squeeze = lambda t: re.sub(r"【\d+†|†[^】†]*】|】|\[Image \d+[^]]*\]|^#+ |^ *\* |\s", "", t, flags=re.M)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    texts = {r.page_id: r.text for r in registry.QUERIES["page_text"](spark, sf_dir).collect()}
    import html

    for p in pages:
        body = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<head.*?</head>|<title.*?</title>|<[^>]+>", "", p.html or "")
        assert squeeze(texts[p.page_id] or "") == re.sub(r"^#+ |\s", "", html.unescape(body)), p.page_id


def test_payload_keys_are_bounded(spark):
    from trialloom.operators import datasets as ds

    df = spark.range(30).select(F.concat(F.lit('{"k'), F.col("id"), F.lit('": 1}')).alias("payload_json"))
    assert len(ds.payload_keys(df, most=30)) == 30
    with pytest.raises(ValueError):
        ds.payload_keys(df, most=29)
