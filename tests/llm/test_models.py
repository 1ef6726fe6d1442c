"""Near-duplicates, search, secrets, quality, language model, pipeline."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.compare import duck, rows_of, sql_rows
from tests.llm.test_shingle_dedup import brute
from trialloom.llm import queries as q
from trialloom.llm import secrets as sc
from trialloom.llm import simhash as sh
from trialloom.llm.common import Scratch, span_hashes, text_buffers, word_spans
from trialloom.llm.components import connected_components
from trialloom.llm.embedding_dedup import near_duplicate_vectors
from trialloom.llm.exact_topk import exact_top_k
from trialloom.llm.pitman_yor import score_texts
from trialloom.llm.quality import score_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_word_spans():
    import pyarrow as pa

    raw, offsets = text_buffers(pa.array(["a  b", None, "", " x", "y"]))
    s, e, row = word_spans(raw, offsets)
    assert [bytes(raw[a:b]).decode() for a, b in zip(s, e)] == ["a", "b", "x", "y"] and row.tolist() == [0, 0, 3, 4]
    raw, offsets = text_buffers(pa.array(["one two one", "two"]))
    s, e, _ = word_spans(raw, offsets)
    h = span_hashes(raw, s, e)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(60)]
    df = spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b", Scratch(spark, "t")).collect()}
    label = components(400, links)
    assert got == {x: label[x] for x in {v for p in links for v in p if p[0] != p[1]}}
    assert connected_components(df.limit(0), "a", "b", Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("name", ["op5_embedding_dedup", "op10_exact_top_k"])
def test_vectors_equal_sql(spark, sf_dir, name):
    assert rows_of(q.QUERIES[name](spark, sf_dir)) == sql_rows(duck(sf_dir), q.ORACLE_SQL[name])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rep string")


def test_vector_dedup_edges(spark, monkeypatch):
    import trialloom.llm.embedding_dedup as ed

    monkeypatch.setattr(ed, "TILE", 40)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    near = [(base + 0.05 * rng.standard_normal(8)).astype(float).tolist() for _ in range(150)]
    rows = [(i + 1, v) for i, v in enumerate(near)] + [(500 + i, [1.0] * 8) for i in range(60)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, []), (None, [1.0] * 8), (905, [1.0, 2.0]), (3, near[2])]
    got = near_duplicate_vectors(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    a = np.array([np.float32(v) for v in near] + [np.float32(near[2])], float)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = ((a @ a.T) >= 0.9).sum(axis=1) - 1
    ones = np.ones(8) / math.sqrt(8)
    cross = (a @ ones >= 0.9).astype(int)
    for i in range(150):
        assert by[i + 1][0].n_links == n[i] + 60 * cross[i]
    assert by[500][0].n_links == 59 + cross.sum() and by[500][0].component_id == (1 if cross.any() else 500)
    for lone in (900, 901, 902, 903, 904, 905, None):
        assert by[lone][0].n_links == 0 and by[lone][0].component_id == lone and by[lone][0].kept
    assert near_duplicate_vectors(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_top_k_edges(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(1, 40)] + [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (60, None), (61, [float("inf"), 1.0]), (62, [None, 1.0]), (None, [9.0, 9.0]), (63, []), (64, [2.0])]
    v = vectors(spark, rows)
    got = exact_top_k(v, v.where("vec_id % 50 = 0"), k=5).collect()
    ok = [(i, x) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    grid = lambda x: [math.floor(256 * np.float64(np.float32(c))) for c in x] + [0] * (2 - len(x))
    for query in (0, 50):
        own = grid(dict(ok)[query])
        best = sorted(((-sum(a * b for a, b in zip(own, grid(x))), i) for i, x in ok if i != query))[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == query), key=lambda r: r.rank)] == [(i, -s) for s, i in best]
    few = vectors(spark, [(0, [1.0]), (1, [2.0])])
    assert [(r.query_id, r.rank, r.vec_id) for r in exact_top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert exact_top_k(few.limit(0), few.limit(0)).count() == 0


def brute_fingerprint(text, width=4):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(docs)
    fp = np.array([brute_fingerprint(docs[i]) for i in ids], np.uint64)
    links = [(a, int(b) + a + 1) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(fp[a] ^ fp[a + 1 :]) <= 4)]
    label = components(len(ids), links)
    expected = {i: (format(int(f), "016x"), ids[c]) for i, f, c in zip(ids, fp, label)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in q.op9_simhash(spark, sf_dir).collect()} == expected


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 8])
def test_links_of_fingerprints(spark, monkeypatch, bits):
    monkeypatch.setattr(sh, "LEAF_ROWS", 16)
    monkeypatch.setattr(sh, "TILE", 24)
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**63, 400, np.uint64)
    for k in range(60):  # flips of up to 6 bits of some, and of each other
        flips = rng.choice(64, rng.integers(1, 11), replace=False)
        fp = np.append(fp, fp[rng.integers(0, len(fp))] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)))
    near = fp[0] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))  # many within 2 of each other
    fp = np.unique(np.append(fp, near))
    df = spark.createDataFrame([(int(f), i) for i, f in enumerate(fp.view(np.int64))], "fp long, rep long")
    s = Scratch(spark, "t")
    got = connected_components(sh.link_fingerprints(df, bits, s), "rep", "root", s).collect()
    links = [(a, int(b) + a + 1) for a in range(len(fp)) for b in np.flatnonzero(np.bitwise_count(fp[a] ^ fp[a + 1 :]) <= bits)]
    label = components(len(fp), links)
    assert {r.node: r.component for r in got} == {i: c for i, c in enumerate(label) if label.count(c) > 1}


def test_simhash_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  TWO"), (6, "a b c d e"), (None, "a b c d e"), (None, "lone text"), (6, "a b c d e"), (7, "w " * 50_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in sh.simhash_components(df).collect()]
    assert len(got) == len(rows)
    by = {i: (f, c) for i, f, c in got if i is not None}
    assert by[1] == by[2] == by[3] == ("0" * 16, 1) and by[4] == by[5] and by[5][1] == 4
    assert sorted((c or -1) for i, f, c in got if i is None) == [-1, 6]
    assert sh.simhash_components(df.limit(0)).count() == 0
    kept = sh.drop_near_duplicates(df).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, -1, 1, 4, 6, 7]


def brute_base(text):
    """The base patterns, written out without the module's."""
    out = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(1)) >= 12:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 18), (2, r"[0-9a-f]+", 16)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


def brute_ratio(models, s):
    """Log-likelihood ratio of a string, character by character."""
    at = [sc.ALPHABET.index(c) for c in s]
    chain = lambda table: sum(table[x, y] for x, y in zip([sc.STATES, *at], at))
    size = sum(n for n, kind in ((26, str.isupper), (26, str.islower), (10, str.isdigit), (4, lambda c: not c.isalnum())) if any(kind(c) for c in s))
    ordinary = chain(models.ordinary)
    if models.further is not None:
        ordinary = models.ordinary[sc.STATES, at[0]] + models.ordinary[at[0], at[1]] + sum(float(models.further[x, y, z]) for x, y, z in zip(at, at[1:], at[2:]))
    return np.logaddexp(chain(models.random), -len(s) * math.log(size)) - math.log(2) - ordinary


def brute_spans(models, text):
    base = brute_base(text)
    out = list(base)
    for m in re.finditer(r"([A-Za-z0-9+/_-]{12,})={0,2}", text):
        if not any(a < m.end() and m.start() < b for a, _, b in base) and len(set(m[1])) >= 5 and brute_ratio(models, m[1]) > models.threshold:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_secrets(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text or "" for r in table.collect()}
    models = sc.fit_models(table)
    listed = lambda spans: ",".join(f"{sc.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for r in q.op8_secrets(spark, sf_dir).collect():
        base = brute_base(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert r.spans == listed(brute_spans(models, docs[r.doc_id]))


ALPHABETS = {"small": "abcdefghijklmnopqrstuvwxyz", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": sc.ALPHABET}


def test_planted_secrets(spark):
    """Random strings of 12 to 19 characters in prose are found, in each alphabet; no other string of 12 or more is."""
    rng = np.random.default_rng(6)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    parts = "con ver tion ing the er an al men te re pro com ma li sta for der ung keit che".split()
    word = lambda: "".join(rng.choice(parts, rng.integers(2, 7)))
    rows, planted = [], {}
    for i in range(1500):
        words = [word() for _ in range(60)] + ["----------------", "WARNINGCONVERSION", "2024-01-02"]
        if i % 4 == 0:
            words.append(f'token = "{draw("0123456789abcdef", 40)}"')
        if i % 5 == 0:
            kind = list(ALPHABETS)[i // 5 % 4]
            planted[i] = (kind, draw(ALPHABETS[kind], int(rng.integers(12, 20))))
            words.insert(7, planted[i][1])
        rows.append((i, "é " + " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    models = sc.fit_models(df)
    text, got, other = dict(rows), set(), 0
    for r in sc.find_secrets(df, models).collect():
        found = {text[r.doc_id][s.start : s.end] for s in r.secret_spans if s.kind == "random"}
        if r.doc_id in planted and planted[r.doc_id][1] in found:
            got.add(r.doc_id)
        other += len(found - {planted.get(r.doc_id, ("", ""))[1]})
        assert sorted((s.start, sc.KINDS.index(s.kind), s.end) for s in r.secret_spans) == brute_spans(models, text[r.doc_id])
    for kind in ALPHABETS:
        own = [i for i, (k, s) in planted.items() if k == kind]
        assert sum(i in got for i in own) >= 0.9 * len(own), kind
    assert other <= 2


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_no_word_of_prose_is_a_secret(spark, sf_dir, sf):
    """The given documents hold no secrets but those of the patterns."""
    import os

    path = os.path.join(os.path.dirname(sf_dir.rstrip("/")), sf, "documents.parquet")
    if not os.path.exists(path):
        pytest.skip(f"no {path}")
    found = sc.find_secrets(spark.read.parquet(path).select("doc_id", "text"))
    assert found.where(F.exists("secret_spans", lambda s: s.kind == "random")).count() == 0


def test_secret_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "key Zq8xK2vW9pLr7TnB3sD== end " * 3, 5), (3, "x" * 100_000, 5), (3, "x" * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secret_spans int")
    counts = np.ones((2, sc.STATES + 1, sc.STATES))
    counts[1, :, 26:52] += 1000
    models = sc.MarkovModels.fit(counts[0], counts[1], 10.0)
    found = sc.find_secrets(df, models, redact_as="[X]").collect()
    assert len(found) == 5
    by = {r.doc_id: r for r in found}
    assert by[1].secret_spans == [] and by[1].redacted_text is None and by[2].redacted_text == "" and by[3].secret_spans == []
    assert by[None].redacted_text == "key [X] end " * 3
    none = sc.fit_models(df.limit(0))
    assert none.threshold == np.inf and sc.find_secrets(df.limit(0)).count() == 0


def test_redact_overlaps():
    text = 'a password="0123456789abcdef01" b'
    spans = sc.base_spans(text)
    assert [k for _, k, _ in spans] == [0, 2] and sc.redact(text, spans, "#") == 'a #" b'
    assert sc.base_spans("secret = password: abcdefghijklmnop") == []  # the short match is used up
    assert sc.base_spans("ſecret=abcdefghijklmnop") == []  # only ASCII letters fold


def test_quality(spark, sf_dir):
    got = q.op7_quality(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (held.predicted == held.quality).mean() >= 0.9


def test_discriminant_equals_formula(spark):
    """Scores against the densities written out with scipy-free determinants and inverses, from the same statistics."""
    import pyarrow as pa

    from trialloom.llm import quality as ql

    rng = np.random.default_rng(8)
    words = np.array("the of and to some longer words with $$ !! CAPS 12 end.".split())
    rows = [(i, " ".join(rng.choice(words[: 9 if i % 2 else 14], rng.integers(5, 80))), i % 2) for i in range(120)]
    x = ql.statistics(pa.array([t for _, t, _ in rows]))
    y = np.array([q for _, _, q in rows])
    k, n = x.shape[1], np.array([(y == c).sum() for c in (0, 1)])
    centre, scale = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-6))
    z = (x - centre) / scale
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    logs = []
    for c in (0, 1):
        w = 0.1 + 0.9 * k / (k + n[c])
        cov = (1 - w) * own[c] + w * pooled + 0.01 * np.eye(k)
        d = np.clip(z, -8, 8) - z[y == c].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    prior = (n[1] + 1) / (n.sum() + 2)
    expected = 1 / (1 + np.exp(-(math.log(prior / (1 - prior)) + (logs[1] - logs[0]) / math.sqrt(k))))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in score_quality(docs, labels, F.lit(True)).collect()}
    assert np.allclose([got[i] for i in range(120)], expected, atol=1e-6)


def test_quality_of_null_ids(spark, tmp_path):
    spark.createDataFrame([(None, "some text", "en"), (1, None, "en"), (1, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = q.op7_quality(spark, str(tmp_path)).collect()
    assert len(got) == 3 and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "some words here", 0.1), (3, "!!! $$$ ### " * 3000, 0.1), (3, "again", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs, none, F.lit(True)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None), (3, 7)], "doc_id long, quality int")
    assert len({r.score for r in score_quality(docs, one, F.lit(True)).collect()}) == 1
    assert score_quality(docs.limit(0), one, F.lit(True)).count() == 0


def test_language_model(spark, sf_dir):
    got = {r.doc_id: r for r in q.op6_lm_score(spark, sf_dir).collect()}
    docs = {r.doc_id: WORD.findall(lower(r.text)) + [None] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = collections.Counter()
    for i, w in docs.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for i, w in docs.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_sums_to_one(spark):
    """After any context the probabilities of all known words, the end and one unknown word sum to one."""
    train = [(i, "a b a c a b d a b" if i % 2 else "b a c c a") for i in range(40)]
    words = ["a", "b", "c", "d", "zz"]
    texts = ["", *words, *[f"{c} {w}" for c in words for w in words]]
    df = spark.createDataFrame([*train, *[(1000 + i, t) for i, t in enumerate(texts)]], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(df, F.col("doc_id") < 1000).collect()}
    p = {t: 10 ** got[1000 + i] for i, t in enumerate(texts)}
    # With X(w) = P(w | start): P(w | c) = P("c w") X(w) / (X(c) P("w")) and P(end | c) = P("c") / X(c). That these sum to
    # one for each c gives X; then the start's own probabilities must sum to one as well.
    x = np.linalg.solve(np.eye(5) - np.array([[p[f"{c} {w}"] / p[w] for w in words] for c in words]), np.array([p[c] for c in words]))
    assert (x > 0).all() and math.isclose(x.sum() + p[""], 1, rel_tol=1e-5)
    rows = spark.createDataFrame([(0, None), (1, ""), (None, "a"), (1, "")], "doc_id long, text string")
    edge = score_texts(rows, F.lit(True)).collect()
    assert sorted(r.n_tokens for r in edge) == [1, 1, 1, 2]
    untrained = score_texts(rows, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and math.isclose(r.score, 0.0, abs_tol=1e-6) for r in untrained)
    assert score_texts(rows.limit(0), F.lit(True)).count() == 0
    # the same texts in other partitions get the same scores
    again = {r.doc_id: r.score for r in score_texts(df.repartition(5), F.col("doc_id") < 1000).collect()}
    assert again == got


def test_frequent_words_change_nothing(spark, sf_dir, monkeypatch):
    """Scores do not depend on which words' entries are dealt by parent."""
    from trialloom.llm import pitman_yor as py

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    found = []
    for share in (2.0, 1 / 300, 1 / 10**9):
        monkeypatch.setattr(py, "FREQUENT_SHARE", share)
        found.append({r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in score_texts(docs, F.col("doc_id") % 4 != 0).collect()})
    assert all(math.isclose(x, y, rel_tol=1e-6) for other in found[1:] for i in found[0] for x, y in zip(found[0][i], other[i]))


def test_contexts_grow_with_the_text():
    from trialloom.llm.pitman_yor import Layout

    assert [Layout.bits_for(x) for x in (0, 1 << 20, 1 << 28, 1 << 29, 1 << 35, 1 << 45)] == [12, 12, 14, 15, 21, 22]


def test_restaurants_are_distributions():
    from trialloom.llm import pitman_yor as py

    rng = np.random.default_rng(0)
    none = np.zeros(0, np.int64)
    layout = py.Layout(14, none.view(np.uint64))
    flat = np.zeros(py.Totals.size(layout))
    words, contexts = 6, [3, 70, 16000]
    customers = rng.integers(0, 9, (words, len(contexts))) + (np.arange(words)[:, None] == 0)
    tables = np.minimum(customers, 1 + customers // 3)
    parents = [c >> layout.below for c in contexts]
    flat[contexts] = customers.sum(axis=0)
    flat[np.array(contexts) + layout.contexts] = tables.sum(axis=0)
    parent_tables = np.minimum(tables, 1)
    at = 2 * layout.contexts
    flat[at + np.array(parents)] = tables.sum(axis=0)
    flat[at + py.PARENTS + np.array(parents)] = parent_tables.sum(axis=0)
    root_customers = parent_tables.sum(axis=1)
    root_tables = np.minimum(root_customers, 1)
    at += 2 * py.PARENTS
    known = (root_customers > 0).sum()
    flat[at : at + 2], flat[-1] = (root_customers.sum(), root_tables.sum()), known
    t = py.Totals(flat, (0.8, 0.6, 0.5), layout, none, none, none)
    for j, c in enumerate(contexts):
        rc, rt = np.append(root_customers[root_customers > 0], 0), np.append(root_tables[root_customers > 0], 0)
        pick = lambda x: np.append(x[root_customers > 0, j], 0)  # noqa: B023, E731
        root = t.root_probability(rc, rt)
        parent = t.parent_probability(np.full(len(rc), parents[j]), pick(tables), pick(parent_tables), root)
        p = t.context_probability(np.full(len(rc), c), pick(customers), pick(tables), parent)
        assert math.isclose(root.sum(), 1) and math.isclose(parent.sum(), 1) and math.isclose(p.sum(), 1)


def test_table_draws():
    """Exact conditionals against enumerated seatings; long ones in range and near their mean."""
    from trialloom.llm import pitman_yor as py

    d, base, others, c = 0.5, 0.2, 10, 4
    weight = collections.Counter()

    def seat(sizes, w, left):
        if not left:
            weight[len(sizes)] += w
            return
        for i, s in enumerate(sizes):
            seat(sizes[:i] + [s + 1] + sizes[i + 1 :], w * (s - d), left - 1)
        seat([*sizes, 1], w * (py.STRENGTH + d * (others + len(sizes))) * base, left - 1)

    seat([1], (py.STRENGTH + d * others) * base, c - 1)
    total = sum(weight.values())
    n = 40_000
    u = (np.arange(n) + 0.5) / n
    got = py.draw_tables(np.full(n, c), np.ones(n, int), np.full(n, others + 1.0), np.full(n, base), d, u, u)
    for k, w in weight.items():
        assert abs((got == k).mean() - w / total) < 1e-3
    many = py.draw_tables(np.full(500, 5000), np.ones(500, int), np.full(500, 1001.0), np.full(500, 0.01), d, u[:: n // 500][:500], u[:: n // 500][:500][::-1])
    assert many.min() >= 1 and many.max() < 5000 and 10 < many.mean() < 100


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "t")
    seen = [docs]
    for name, stage in cp.STAGES:
        seen.append(scratch.table(stage(spark, seen[-1], sf_dir), name))
    for df in seen[1:-1]:
        assert df.schema.simpleString() == docs.schema.simpleString()
    good, single, clean, packed = seen[1:]
    predicted = {r.doc_id for r in q.op7_quality(spark, sf_dir).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == predicted
    kept = {r.doc_id: r.text for r in single.collect()}
    label, _ = brute([(r.doc_id, r.text) for r in good.collect()])  # Jaccard similarities of all pairs
    assert set(kept) == set(label.values())
    redacted = {r.doc_id: r.text for r in clean.collect()}
    models = sc.fit_models(single)
    for i, text in kept.items():
        assert redacted[i] == (sc.redact(text, brute_spans(models, text), "[SECRET]") if text else text)
    assert set(redacted) == set(kept)
    assert {r.doc_id for r in packed.collect()} == set(kept)
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert whole <= 2048 and cp.run(spark, sf_dir).count() == packed.count()


@pytest.mark.parametrize("x", [1e17, 5e8, -1e300])
def test_top_k_refuses_scores_that_overflow(spark, x):
    df = spark.createDataFrame([(0, [x, 1.0]), (1, [1.0, x])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        exact_top_k(df, df)


def test_whole_previous_words_are_contexts(spark):
    """300 words that end alike are each followed by a word of their own; a context shared with others would not tell which."""
    from trialloom.llm import pitman_yor as py

    texts = {i: " ".join([f"q{i}zz follow{i}"] * 20) for i in range(300)}
    asked = {1000 + i: f"q{i}zz follow{i}" for i in range(300)} | {2000 + i: f"q{i}zz follow{(i + 1) % 300}" for i in range(300)}
    df = spark.createDataFrame([*texts.items(), *asked.items()], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(df, F.col("doc_id") < 1000).collect()}
    assert min(got[1000 + i] - got[2000 + i] for i in range(300)) > 2
    # numbers tell all words apart, and each context's customers are what follows the word
    docs = df.withColumn("train", F.col("doc_id") < 1000)
    layout = py.Layout(12, np.zeros(0, np.int64), 8, 8)
    scratch = Scratch(spark, "t")
    blocks = scratch.table(py.make_blocks(docs, 8).withColumn("part", F.when(F.col("bucket") < 0, "body").otherwise("words")), "blocks", "part")
    names = scratch.table(py.number_words(blocks, layout, 8), "names")
    frequent, trained = py.frequent_words(names)
    assert trained == 300 * 41 and len(frequent) <= 1 / py.FREQUENT_SHARE
    held = collections.Counter()
    for row in py.merge_counts(py.ask(blocks, names, layout, 8), layout, 8).collect():
        s = py.Seating(row.asDict(), layout)
        for c, n in zip(s.contexts.tolist(), s.customers.tolist()):
            held[c] += n
    assert sorted(held.values()) == [20] * 600 + [300]
