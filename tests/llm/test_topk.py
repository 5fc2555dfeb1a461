"""Exact top-k against brute force, with ties, copies and rows that take no part."""

import numpy as np
import pytest

from undula.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, score int, rank int"


def brute(vectors, k):
    out = []
    for q, x in vectors.items():
        if q % 20 == 0:
            c = sorted((-int(np.dot(x, y)), i) for i, y in vectors.items() if i != q and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(c)]
    return sorted(out)


def run(spark, rows, k=20, **settings):
    v = topk.integer_vectors(spark.createDataFrame([(i, x, 0, 0) for i, x in rows], SCHEMA))
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, v.filter("vec_id % 20 = 0"), k, **settings).collect())


def whole(rows):
    ok = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v = np.floor(64 * np.array(x, np.float32).astype(float)).astype(np.int64)
            ok[i] = min(ok.get(i, v), v, key=lambda a: a.tolist())
    return ok


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 60, "query_rows": 4}])
def test_brute_force(spark, settings):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 420)]  # a third are copies: ties by id
    rows += [(500, None), (520, [1.0] * 7 + [None]), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, [0.0] * 8), (580, [1.0, 2.0]), (581, [3.0, 4.0]), (600, []), (7, rows[7][1])]
    assert run(spark, rows, **settings) == brute(whole(rows), 20)


def test_fewer_candidates_and_empty(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 64 * 128)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_leaves_are_pruned_only_below_the_kth_score():
    rng = np.random.default_rng(4)
    x = rng.integers(-5, 6, (4000, 3))
    ids, q = np.arange(4000), x[:50]
    row, vec, score = topk.search(ids, x, ids[:50], q, np.full(50, topk.LOWEST), 7, leaf=16)
    s = q @ x.T
    s[np.arange(50), np.arange(50)] = -(10**9)
    for i in range(50):
        want = np.lexsort((ids, -s[i]))[:7]
        assert vec[row == i].tolist() == want.tolist() and score[row == i].tolist() == s[i, want].tolist()


def test_large_components_stay_exact():
    x = np.array([[2**31 + 1, 3], [2**31, 5], [-(2**31), 1]])
    row, vec, score = topk.search(np.arange(3), x, np.array([0]), x[:1], np.array([topk.LOWEST]), 2)
    assert vec.tolist() == [1, 2] and score.tolist() == [int(x[0, 0]) * int(x[1, 0]) + 15, int(x[0, 0]) * int(x[2, 0]) + 3]


def test_scores_beyond_64_bits_are_refused():
    x = np.array([[10**17, 10**17], [10**17, 5 * 10**16], [3, 4]])
    with pytest.raises(ValueError, match="64 bits"):
        topk.search(np.arange(3), x, np.array([0]), x[:1] * 6, np.array([topk.LOWEST]), 2)
    # only the way to the sum passes 64 bits
    x = np.array([[2**40, 2**40, 1], [2**40, -(2**40), 5], [2**39, -(2**39), 7]])
    row, vec, score = topk.search(np.arange(3), x, np.array([0]), x[:1], np.array([topk.LOWEST]), 2)
    assert vec.tolist() == [2, 1] and score.tolist() == [7, 5]
