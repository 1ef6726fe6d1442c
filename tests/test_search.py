"""Exact vector search: null, ragged and tied vectors, and blocks that bounds skip."""

import numpy as np
import pytest

from trialloom.operators import retrieval as rt

SCHEMA = "id long, vector array<double>"


def plain_top(queries, keys, k):
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v)
    out = set()
    for q, v in queries:
        if ok(v):
            scored = sorted((-float(np.dot(v, w)), i) for i, w in keys if ok(w) and len(w) == len(v))
            out |= {(q, i, n + 1) for n, (_, i) in enumerate(scored[:k])}
    return out


def rows():
    """Whole numbers, so that ties are exact; clusters, repeats, and vectors that take no part."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-40, 40, (6, 8))
    keys = [(i, [float(x) for x in centres[i % 6] + rng.integers(-1, 2, 8)]) for i in range(400)]
    keys += [(400 + i, keys[i][1]) for i in range(30)] + [(500, None), (501, []), (502, [1.0, None] + [0.0] * 6), (503, [float("nan")] * 8), (504, [float("inf")] * 8)]
    keys += [(600 + i, [float(i), 1.0, 2.0]) for i in range(4)] + [(700, [0.0] * 8)]
    return keys


@pytest.mark.parametrize("k", [1, 7, 600])
def test_search_equals_all_pairs(spark, k):
    keys = rows()
    queries = [r for r in keys if r[0] % 7 == 0 or r[0] >= 500] + [(900, [2.0, 5.0])]
    q, c = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(keys, SCHEMA).repartition(3)
    expected = plain_top(queries, keys, k)
    got = rt.block_scores(q, c, k, "id", "id").collect()
    assert {(r.query_id, r.key_id, r["rank"]) for r in got} == expected
    if k < 600:
        got, stats = rt.bounded_scores(q, c, k, "id", "id", block_rows=16)
        assert {(r.query_id, r.key_id, r["rank"]) for r in got.collect()} == expected
        s = stats.first()
        assert s.queries == len({i for i, _, _ in expected}) and 0.3 < s.skipped_share < 1
    assert rt.block_scores(q.limit(0), c, k, "id", "id").count() == 0


def test_bounds_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    top, stats = rt.bounded_scores(none, none, 3, "id", "id")
    assert top.count() == 0 and tuple(stats.first()) == (0, 0, 0, 0, 0.0)
