"""Collocations against SQL and a plain count; automata against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialloom.llm import collocations as co
from trialloom.llm.queries import ORACLE_SQL, op12_collocations
from tests.compare import duck, rows_of, sql_rows


def entries_of(counts):
    """Entries of {(word, ...): weight}, in sorted order."""
    words = sorted({w for p in counts for w in p})
    at = {w: i + 1 for i, w in enumerate(words)}
    keys = sorted(counts)
    ids = np.array([[at[p[k]] if k < len(p) else 0 for p in keys] for k in range(3)], np.int64).reshape(3, -1)
    return co.Entries(pa.array(words, pa.large_binary()), ids, np.array([counts[k] for k in keys], np.int64))


def dict_of(entries):
    words = [None, *entries.words.to_pylist()]
    return {tuple(words[i] for i in p if i): w for p, w in zip(entries.ids.T.tolist(), entries.weights.tolist())}


def random_counts(rng, n, letters=b"abcdefg"):
    word = lambda: bytes(rng.choices(letters, k=rng.randrange(1, 3)))
    return {tuple(word() for _ in range(rng.randrange(1, 4))): rng.randrange(1, 5) for _ in range(n)}


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_automaton_keeps_every_weight(n):
    rng = random.Random(n)
    counts, other = random_counts(rng, n), random_counts(rng, n + 3, b"abcdxyz")
    a = co.Automaton.build(entries_of(counts))
    assert dict_of(a.entries()) == counts
    b = co.Automaton.unpack(a.pack())
    assert dict_of(b.entries()) == counts
    asked = entries_of(other)
    assert b.compose(asked).tolist() == [counts.get(p, 0) for p in dict_of(asked)]


def test_equal_states_are_one():
    counts = {(a, b, c): 2 for a in (b"p", b"q") for b in (b"x", b"y") for c in (b"k", b"l")}
    a = co.Automaton.build(entries_of(counts))
    assert len(a.start2) - 1 == 1 and len(a.start1) - 1 == 1 and len(a.label2) == 2
    counts[b"q", b"y", b"l"] = 3
    b = co.Automaton.build(entries_of(counts))
    assert len(b.start2) - 1 == 2 and len(b.start1) - 1 == 2 and dict_of(b.entries()) == counts


def test_register_tells_states_of_one_hash_apart(monkeypatch):
    state, label = np.array([0, 0, 1, 1, 2, 2]), np.array([1, 2, 1, 2, 1, 3])
    same = np.unique
    monkeypatch.setattr(np, "unique", lambda x, **k: same(np.zeros_like(x), **k))
    number, start, arcs = co.register(state, 3, label, np.ones(6, np.int64), np.zeros(6, np.int64))
    assert number.tolist() == [0, 0, 1] and start.tolist() == [0, 2, 4] and arcs.tolist() == [0, 1, 4, 5]


def test_union_sums_weights():
    rng = random.Random(4)
    parts = [random_counts(rng, 50) for _ in range(5)]
    total = Counter()
    for p in parts:
        total.update(p)
    united = co.sum_entries([entries_of(p) for p in parts])
    assert dict_of(united) == dict(total)
    assert list(dict_of(united)) == sorted(total)


TEXTS = ["", None, "A b A b a B. the end", "x\ty  z,x y z\nx y z", "\x0b\x0cé É", "one", "..!?", "a b"]


def plain_counts(texts):
    out = Counter()
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            for n in (1, 2, 3):
                out.update(tuple(w.encode() for w in words[i : i + n]) for i in range(len(words) - n + 1))
    return out


def test_counts_of_texts(monkeypatch):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choices("ab. \n,", k=rng.randrange(200))) for _ in range(40)]
    assert dict_of(next(co.count_phrases(pa.array(texts)))) == dict(plain_counts(texts))
    monkeypatch.setattr(co, "SHARD_WORDS", 7)
    parts = list(co.count_phrases(pa.array(texts)))
    assert len(parts) > 20 and dict_of(co.sum_entries(parts)) == dict(plain_counts(texts))
    assert list(co.count_phrases(pa.array([], pa.string()))) == [] and list(co.count_phrases(pa.array([None, ""]))) == []


def test_cuts_follow_splitters():
    rng = random.Random(6)
    counts = random_counts(rng, 300)
    splitters = sorted((rng.choice([b"de", b"en", b"fr"]), *(bytes(rng.choices(b"abcdefg", k=rng.randrange(3))) for _ in range(2))) for _ in range(25))
    seen = {}
    for at, piece in co.cut_entries(entries_of(counts), b"en", splitters):
        for p, w in dict_of(piece).items():
            assert co.range_of(splitters, (b"en", p[0], p[1] if len(p) > 1 else b"")) == at
            seen[p] = w
    assert seen == counts


def test_op12_equals_sql(spark, sf_dir):
    assert rows_of(op12_collocations(spark, sf_dir)) == sql_rows(duck(sf_dir), ORACLE_SQL["op12_collocations"])


def test_many_ranges_and_runs_change_nothing(spark, monkeypatch):
    """Hot words, ties, nulls and clashing names; ranges of a few words; against SQL on the same rows."""
    import duckdb

    rng = random.Random(2)
    words = ["the", "of", "New", "york", "new", "é", "x-y", "a'b", "zz"]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), " ".join(rng.choices(words, [30, 20, 5, 5, 5, 3, 3, 3, 1], k=60)) + rng.choice([".", "\n", "  ,x"])) for _ in range(150)]
    rows += [("en", None), (None, ""), ("fr", "alone"), ("en", rows[0][1]), ("en", rows[0][1]), ("en", "y " * 20_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "lang string, text string, range int").repartition(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    for name, value in (("RANGE_CHARS", 3000), ("SAMPLE_CHARS", 64), ("SHARD_WORDS", 500), ("PENDING", 300)):
        monkeypatch.setattr(co, name, value)
    assert len(co.prefix_splitters(df.select("lang", "text").na.fill(""))) > 10
    assert rows_of(co.collocations(df)) == sql_rows(con, ORACLE_SQL["op12_collocations"])
    assert co.collocations(df.limit(0)).count() == 0
    assert co.collocations(df.where("lang = 'fr'")).count() == 0
    assert co.collocations(df, top=3).groupBy("lang").agg(F.count("*").alias("n")).where("n > 3").count() == 0
