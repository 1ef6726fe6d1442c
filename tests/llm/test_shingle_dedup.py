"""The pipeline's near-duplicate stage against Jaccard similarities of all pairs."""

import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, similarity=0.8):
    """Smallest id reachable for each id, and the similarities of all pairs."""
    ids = sorted({i for i, _ in rows if i is not None})
    label, found = {i: i for i in ids}, []
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            s = len(a & b) / len(a | b) if a | b else 1.0
            found.append(s)
            if s >= similarity and label[i] != label[j]:
                x, y = sorted((label[i], label[j]))
                label = {n: x if c == y else c for n, c in label.items()}
    return label, found


def copies(rng):
    """Texts with copies that share 0.6 to 1 of their shingles, chains, and a passage that many hold."""
    words = np.array([f"w{k}" for k in range(400)])
    passage = list(rng.choice(words, 30))
    rows = []
    for k in range(40):
        base = list(rng.choice(words, rng.integers(8, 150)))
        base = passage + base if k % 3 == 0 else base
        rows.append(base)
        for _ in range(4):
            new = list(rows[-1] if k % 2 else base)
            for at in rng.choice(len(new), max(1, int(len(new) * rng.uniform(0, 0.06))), replace=False):
                new[at] = rng.choice(words)
            rows.append(new)
    rows += [passage + list(rng.choice(words, n)) for n in (0, 0, 1, 2, 3, 5, 8, 13)]
    texts = [" ".join(r) for r in rows] + ["one two", "One  TWO", "two one", "", None, " \t", "w " * 3000]
    order = rng.permutation(len(texts))
    return [(int(i), texts[k]) for i, k in enumerate(order)]


def test_stage_equals_all_pairs(spark):
    import corpus_pipeline as cp

    rows = copies(np.random.default_rng(4))
    label, found = brute(rows)
    near = [s for s in found if 0.6 <= s < 1]
    assert sum(0.8 <= s < 0.9 for s in near) > 20 and sum(0.65 <= s < 0.8 for s in near) > 20
    df = spark.createDataFrame([*rows, (None, "one two"), (0, rows[0][1])], "doc_id long, text string")
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in cp.near_duplicates(spark, df, "").collect())
    assert kept == sorted([-1, *set(label.values())])
    assert cp.near_duplicates(spark, df.limit(0), "").count() == 0


def test_rows_of_one_id(spark):
    """Rows of one id but unlinked texts both stay; of equal or linked ones the same row stays in any order."""
    from trialloom.llm.shingle_dedup import drop_similar
    from trialloom.llm.simhash import drop_near_duplicates

    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, "b", "x"), (1, "another text of its own", "a", "x"), (1, long, "a", "x"), (2, long + " more", "a", "x"), (None, long, "a", "x"), (None, long, "a", "x"), (3, None, "c", "x"), (3, "", "d", "x")]
    for drop in (drop_similar, drop_near_duplicates):
        for order in (rows, rows[::-1]):
            df = spark.createDataFrame(order, "doc_id long, text string, _hash string, component_id string").repartition(3)
            kept = sorted((r.doc_id or -1, r.text or "", r._hash) for r in drop(df).collect())
            assert kept == sorted([(-1, long, "a")] * 2 + [(1, long, "a"), (1, "another text of its own", "a"), (3, "", "c")]), drop


def test_components_equal_all_pairs(spark, sf_dir):
    from trialloom.llm.shingle_dedup import shingle_components

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label, _ = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: r.component_id for r in shingle_components(docs).collect()} == label


def test_near_fingerprints_are_candidates(spark):
    """Sets with fingerprints at most 4 bits apart are joined by candidate pairs, others by none."""
    from trialloom.llm.common import Scratch
    from trialloom.llm.shingle_dedup import fingerprint_pairs

    far = 0x0F0F_3355_6699_AA00
    rows = [(1, 0), (2, 0), (3, 0b1111), (4, 0b11110000), (5, 0b111111111 << 30), (6, far), (7, far ^ 1), (8, far ^ 0b111110)]
    pairs = {(r.a, r.b) for r in fingerprint_pairs(spark.createDataFrame(rows, "sig long, fp long"), Scratch(spark, "t")).collect()}
    label = {s: s for s, _ in rows}
    for a, b in sorted(pairs):
        assert a < b
        label = {n: min(label[a], label[b]) if c in (label[a], label[b]) else c for n, c in label.items()}
    assert label == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8}
