"""Files read by byte ranges against whole-file parsers, with range edges at every place."""

import json
import random

import pytest

from trialloom.sources import ranges as rg
from trialloom.sources import runs as src


@pytest.fixture
def small_ranges(spark):
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield cut
    for c in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{c}")


CSV = 'id,agent,"te,xt",tags\n1,a,"x\ny","[""p"", ""q""]"\n\n2,,"say ""hi""\n\n, ""\n"\n"",b,,\n4,"c",plain,"\n"\n5,d,"é☃\n",t\n'


@pytest.mark.parametrize("size", [1 << 20, 7, 10, 23])
def test_csv_equals_single_task(spark, tmp_path, small_ranges, size):
    (tmp_path / "a.csv").write_text(CSV)
    expected = [tuple(r) for r in spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"').collect()]
    small_ranges(size)
    rows = rg.read_csv_ranges(spark, str(tmp_path))
    assert rows.columns == ["id", "agent", "te,xt", "tags", "_file", "row_index"]
    got = sorted((r.row_index, *tuple(r)[:4]) for r in rows.collect())
    assert [g[0] for g in got] == list(range(1, len(got) + 1))
    assert [g[1:] for g in got] == expected and len(expected) == 5


def test_csv_of_random_cells(spark, tmp_path, small_ranges):
    import csv
    import io

    rng = random.Random(3)
    files = {}
    for f in range(3):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\r\n" if f == 2 else "\n")
        header = ["k", "v"] if f < 2 else ["v", "extra"]
        rows = [["".join(rng.choices('ab",\n ', k=rng.randrange(6))) for _ in header] for _ in range(30)]
        rows = [[f"{i}.{c}".replace("\n", "\r\n" if f == 2 else "\n") for c in r] for i, r in enumerate(rows)]
        w.writerow(header)
        w.writerows(rows)
        (tmp_path / f"{f}.csv").write_bytes(out.getvalue().encode())
        files[f"{f}.csv"] = [dict(zip(header, [c.replace("\r\n", "\n") or None for c in r])) for r in rows]
    small_ranges(150)
    read = rg.read_csv_ranges(spark, str(tmp_path))
    assert set(read.columns) == {"k", "v", "extra", "_file", "row_index"}
    for name, rows in files.items():
        got = sorted((r for r in read.collect() if r["_file"].endswith(name)), key=lambda r: r.row_index)
        assert [{k: r[k] for k in rows[0]} for r in got] == rows


def plain_objects(doc):
    if isinstance(doc, list):
        return [(None, None, x) for x in doc if isinstance(x, dict)]
    out = []
    for section, inner in doc.items():
        if isinstance(inner, list):
            out += [(section, None, x) for x in inner if isinstance(x, dict)]
        elif isinstance(inner, dict):
            out += [(section, k, x) for k, x in inner.items() if isinstance(x, dict)]
    return out


def random_value(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind < 3:
        return ["}{", 'q"\\', None, 1.5, "a}b]", "\n ☃", True, ""][rng.randrange(8)]
    if kind == 3:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {f"k{rng.choice('ab}:,')}{i}": random_value(rng, depth - 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize(("size", "indent"), [(1 << 20, None), (90, None), (157, 2)])
def test_json_objects_equal_whole_parse(spark, tmp_path, small_ranges, size, indent):
    rng = random.Random(size)
    docs = {}
    for f in range(3):
        if f % 2:
            doc = [random_value(rng, 3) for _ in range(7)]
        else:
            doc = {"schema": 2, "summary": {"n": 1, "pairs": [[1, 2]]}, "detail": [random_value(rng, 3) for _ in range(6)], "a}\"b": {}, "run_cache": {f"e{i}::r}}{i}": random_value(rng, 2) for i in range(5)}, "last": [], "count": 3}
        docs[f"{f}.json"] = doc
        (tmp_path / f"{f}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(f % 3)))
    (tmp_path / "e.json").write_text(" ")
    small_ranges(size)
    rows = rg.json_elements(spark, str(tmp_path)).collect()
    for name, doc in docs.items():
        own = sorted((r for r in rows if r.file.endswith(name)), key=lambda r: (r.start, r.n))
        got = [(r.section, r.key, json.loads(r.value)) for r in own]
        assert got == plain_objects(doc)
    assert not [r for r in rows if r.file.endswith("e.json")]


def test_many_ranges_are_exchanged_to_their_states(spark, tmp_path, small_ranges, monkeypatch):
    doc = [{"a": i, "b": ["x}" * i, {}]} for i in range(15)]
    (tmp_path / "a.json").write_text(json.dumps(doc))
    small_ranges(40)
    monkeypatch.setattr(rg, "BROADCAST_RANGES", 3)
    rows = sorted(rg.json_elements(spark, str(tmp_path)).collect(), key=lambda r: (r.start, r.n))
    assert [json.loads(r.value) for r in rows] == doc and len({r.start for r in rows}) > 5


def test_results_of_many_ranges(spark, tmp_path, small_ranges):
    trial = lambda i, arm: {"trial": i, "run_name": f"n{i}", "run_id": f"{arm}{i}", "score": i / 2, "score_feedback": "}", "output": "o{" * i, "knowledge_used": [{"step": 1, "id": 40 + i, "text": "t}"}] if arm == "k" else []}
    detail = [{"id": f"p{p}", "problem": "?", "no_klg_trials": [trial(i, "n") for i in range(2)], "klg_trials": [trial(i, "k") for i in range(3)], "no_klg_mean_score": 0.25, "klg_mean_score": 0.5, "mean_score_improvement": 0.25} for p in range(5)]
    cache = {f"p{p}::n{p}": {"run_id": f"r{p}", "output": "x", "msg_history": [{"role": "user", "content": "}"}]} for p in range(5)}
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": 2, "summary": {"total": 5}, "detail": detail, "run_cache": cache, "run_cache_count": 5}, indent=2))
    small_ranges(400)
    found = src.read_result_objects(spark, str(tmp_path))
    assert found.select("start").distinct().count() > 3
    trials, runs = src.read_results(spark, str(tmp_path))
    assert sorted((r.problem_id, r.arm, r.trial, r.run_id, r.score, r.output) for r in trials.collect()) == sorted((d["id"], a, t["trial"], t["run_id"], t["score"], t["output"]) for d in detail for a in ("no_klg", "klg") for t in d[f"{a}_trials"])
    assert sorted((r.run_id, r.entry_id, r.run_name) for r in runs.collect()) == [(f"r{p}", f"p{p}", f"n{p}") for p in range(5)]
    used = src.result_knowledge(found).collect()
    assert sorted((r.problem_id, r.arm, r.trial, r.step, r.knowledge_id, r.text) for r in used) == sorted((f"p{p}", "klg", i, 1, str(40 + i), "t}") for p in range(5) for i in range(3))
    assert {(r.problem_id, r.no_klg_mean, r.klg_mean, r.improvement) for r in src.result_scores(found).collect()} == {(f"p{p}", 0.25, 0.5, 0.25) for p in range(5)}


def test_knowledge_documents(spark, tmp_path):
    entry = lambda t: {"id": t, "agent": "a", "text": t}
    (tmp_path / "a.json").write_text(json.dumps({"entries": [entry("no")], "knowledge": [entry("yes"), "stray", {"agent": "a"}], "other": {"x": entry("no")}}))
    (tmp_path / "b.json").write_text(json.dumps({"entries": [entry("e"), {**entry("f"), "tags": ["t"], "more": 1}]}))
    (tmp_path / "c.json").write_text(json.dumps([entry("l")]))
    got = sorted((r.id, r.text, r.tags, r.meta) for r in src.read_knowledge(spark, str(tmp_path), "json").collect())
    assert got == [("e", "e", [], {}), ("f", "f", ["t"], {"more": "1"}), ("l", "l", [], {}), ("yes", "yes", [], {})]


def test_run_metadata(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"run-{k}").mkdir()
        meta = {"run_id": f"r{k}", "model": "m", "timings": {"started_at": 1.5, "completed_at": 4.0}, "usage": {"total_tokens": 7}, "message_history": {"count": 2, "role_counts": {"user": 2}}, "extra": {"a": 1}}
        (tmp_path / f"run-{k}" / "meta.json").write_text(json.dumps(meta, indent=2) if k == 1 else "{broken")
    (row,) = src.read_meta(spark, str(tmp_path)).collect()
    assert (row.folder, row.run_id, row.timings.completed_at, row.usage, row.message_history.role_counts) == ("run-1", "r1", 4.0, {"total_tokens": 7}, {"user": 2})
