"""Groups that hold most of a table: pairs, batches, numbers, softmaxes, trees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trialloom.functions.numbering import number_within
from trialloom.operators import evaluation as ev
from trialloom.operators import preference as pr


def test_number_within(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice(["a", "b"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, h string, o long").repartition(6)
    got = {(r.g, r.h, r.o): (r.n, r.all) for r in number_within(df, "n", ["g", "h"], F.desc("o"), total="all").collect()}
    for g, h in {r[:2] for r in rows}:
        own = sorted((o for a, b, o in rows if (a, b) == (g, h)), reverse=True)
        assert [got[g, h, o] for o in own] == [(k + 1, len(own)) for k in range(len(own))]


def plain_pairs(rows, threshold):
    by = {}
    for g, i, s in rows:
        if g is not None and s is not None:
            by.setdefault(g, []).append((i, s))
    return sorted(
        (g, i, j, *((i, j) if a > b else (j, i))) for g, m in by.items() for i, a in m for j, b in m if i < j and abs(a - b) > threshold
    )


@pytest.mark.parametrize("threshold", [0.0, 0.5, 3.0])
def test_pairs_of_tiles(spark, threshold):
    rng = random.Random(2)
    rows = [(1, i, rng.choice([0.0, 0.5, 1.0, 2.0, None, 4.0, 4.5])) for i in range(90)]
    rows += [(2, i, 7.0) for i in range(60)] + [(3, i, float(i)) for i in range(4)] + [(None, 0, 1.0), (None, 1, 9.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "group long, idx long, score double")
    for tile in (7, 1024):
        assert sorted(map(tuple, pr.comparison_pairs(df, threshold=threshold, tile=tile).collect())) == plain_pairs(rows, threshold)


def test_tiles_spread_a_hot_group(spark):
    """No task makes more than a share of the pairs, and equal scores are not paired."""
    df = spark.range(6000).select(F.lit(1).alias("group"), F.col("id").alias("idx"), F.when(F.col("id") < 3000, 1.0).otherwise(F.col("id") % 7).cast("double").alias("score"))
    pairs = pr.comparison_pairs(df, tile=250)
    scores = [1] * 3000 + [i % 7 for i in range(3000, 6000)]
    expected = 6000 * 5999 // 2 - sum(math.comb(scores.count(k), 2) for k in range(7))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r.n for r in pr.comparison_pairs(df, tile=250).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == expected and len(sizes) == 16 and max(sizes) < 0.2 * expected
    assert pairs.select("i", "j").distinct().count() == expected


def test_nested_parts(spark):
    g = spark.createDataFrame([(p, i, f"r{p}-{i}", float(i % 5), i) for p, n in ((1, 40), (2, 3)) for i in range(n)], "problem_id long, idx long, run_id string, score double, n_steps long")
    pairs = pr.comparison_pairs(g, "problem_id")
    rows = sorted(pr.nested_groups(g, pairs, pairs_a_row=100).collect())
    assert max(len(r.comparison) for r in rows) <= 100 and len({r.part for r in rows if r.problem_id == 1}) > 5
    for p in (1, 2):
        own = [r for r in rows if r.problem_id == p]
        assert [m.run_id for r in own for m in r.messages] == [f"r{p}-{i}" for i in range(40 if p == 1 else 3)]
        assert [r.first for r in own] == [sum(len(x.messages) for x in own[:k]) for k in range(len(own))]
        made = sorted(tuple(c) for r in own for c in r.comparison)
        assert made == sorted((x.winner, x.loser) for x in pairs.where(F.col("problem_id") == p).collect())
    assert [r.part for r in pr.nested_groups(g, pairs).collect()] == [0, 0]


def test_batches_deal_quotas(spark):
    """Every pair once before repeats; messages of a batch that are not used up differ by one at most; equal to a plain dealer."""
    rng = random.Random(4)
    items = [(0, m, s) for m in range(9) for s in range(rng.randrange(1, 30))] + [(1, 0, s) for s in range(3)] + [(2, m, 0) for m in range(4)]
    n = 7
    import hashlib

    draw = lambda *k: hashlib.md5(":".join(map(str, k)).encode()).hexdigest()
    expected = {}
    for p in {i[0] for i in items}:
        left = {m: sorted((s for a, b, s in items if (a, b) == (p, m)), key=lambda s: (draw(5, p, m, s), s)) for m in {b for a, b, _ in items if a == p}}
        order = sorted(left, key=lambda m: (draw(6, p, m), m))
        dealt = []
        while any(left.values()):
            dealt += [(m, left[m].pop(0)) for m in order if left[m]]
        expected[p] = dealt + [dealt[k % len(dealt)] for k in range(-len(dealt) % n)]
    df = spark.createDataFrame(items, "p long, m long, s long").repartition(5)
    rows = pr.balanced_batches(df, "p", "m", "s", n, 5).collect()
    for p, dealt in expected.items():
        got = {r.batch * n + r.slot: (r.m, r.s) for r in rows if r.p == p}
        assert [got[k] for k in range(len(got))] == dealt
        pairs = sum(i[0] == p for i in items)
        used = [(r.m, r.s) for r in rows if r.p == p and not r.repeat]
        assert len(used) == len(set(used)) == pairs
    own = expected[0][: sum(i[0] == 0 for i in items)]
    for b in range(len(own) // n):
        batch = [m for m, _ in own[b * n : (b + 1) * n]]
        later = {m for m, _ in own[(b + 1) * n :]}
        counts = [batch.count(m) for m in later]
        assert not counts or max(counts) - min(counts) <= 1


def softmax(xs):
    top = max(xs)
    z = sum(math.exp(x - top) for x in xs)
    return [x - top - math.log(z) for x in xs]


def test_softmax_and_kl_of_extreme_scores(spark):
    groups = {1: [1000.0, 999.0, -1000.0], 2: [-5000.0, -5001.0], 3: [0.0], 4: [700.0, 255.9, 256.1, 256.0], None: [3.0, 1.0], 5: [1.0, None]}
    refs = {1: [1.0, 2.0, 3.0], 2: [-900.0, 900.0], 3: [5.0], 4: [None, 1.0, 1.0, 1.0], None: [0.5, 0.25], 5: [2.0, 4.0]}
    df = spark.createDataFrame([(g, i, s, refs[g][i]) for g, xs in groups.items() for i, s in enumerate(xs)], "g long, i long, s double, q double")
    got = {(r.g, r.i): r.log_p for r in pr.group_log_softmax(df, "g", "s").collect()}
    total, n = 0.0, 0
    for g, xs in groups.items():
        p = [0.0] * len(xs) if None in xs else softmax(xs)
        assert all(math.isclose(got[g, i], x, rel_tol=1e-9, abs_tol=1e-9) for i, x in enumerate(p))
        if None not in refs[g]:
            q = softmax(refs[g])
            total, n = total + sum(math.exp(a) * (a - b) for a, b in zip(p, q)), n + 1
    row = pr.group_kl(df, "g", "s", "q").first()
    assert row.groups == n and math.isclose(row.kl, total / n, rel_tol=1e-9)
    assert tuple(pr.group_kl(df.limit(0), "g", "s", "q").first()) == (0.0, 0)


def test_trees_double_pointers(spark):
    rng = random.Random(6)
    parents = {0: None, 100: None, 200: 999}
    for n in [*range(1, 90), *range(101, 130), 201]:
        parents[n] = rng.choice([k for k in parents if (k < 100) == (n < 100) and (k >= 200) == (n >= 200)])
    df = spark.createDataFrame(list(parents.items()), "node long, parent long")
    expected = {}
    for leaf in set(parents) - set(parents.values()):
        path = [leaf]
        while parents.get(path[0]) is not None:
            path.insert(0, parents[path[0]])
        if path[0] in parents:
            expected[leaf] = path
    assert {r.leaf: r.path for r in ev.flatten_attempts(df).collect()} == expected and 201 not in expected
    deep = spark.range(300).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    row = ev.flatten_attempts(deep, 299).first()
    assert (row.root, row.leaf, row.path) == (0, 299, list(range(300)))
    with pytest.raises(ValueError):
        ev.flatten_attempts(deep, 298)
    for bad in ([(1, None), (2, 3), (3, 2)], [(1, None), (2, 1), (3, 2), (2, 3)]):
        with pytest.raises(ValueError):
            ev.flatten_attempts(spark.createDataFrame(bad, "node long, parent long"))
    assert ev.flatten_attempts(df.limit(0)).count() == 0


def test_small_groups_are_numbered_by_a_window(spark):
    """Groups on either side of the limit get the numbers of a plain count, null keys too."""
    from trialloom.functions.numbering import number_within_small

    rows = [(g, o) for g, n in ((None, 30), (1, 3), (2, 10), (3, 11)) for o in range(n)]
    df = spark.createDataFrame(rows, "g int, o int").repartition(3)
    for most in (10, 1000):
        assert sorted((r.g or 0, r.o, r.n) for r in number_within_small(df, "n", ["g"], F.desc("o"), most=most).collect()) == sorted((g or 0, o, {None: 30, 1: 3, 2: 10, 3: 11}[g] - o) for g, o in rows)
