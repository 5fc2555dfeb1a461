"""Rotated binary codes and near-duplicate vectors against brute force."""

import numpy as np
import pytest

from undula.llm import neighbours, rotated

SCHEMA = "vec_id bigint, embedding array<double>, code string, key int, `a b` struct<`c d`: int>"


@pytest.mark.parametrize("dim", [1, 3, 64, 100, 300])
def test_estimates_stay_within_their_bounds(dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(500, dim))
    y = rotated.unit(x + rng.normal(size=x.shape) * rng.uniform(0, 1, (500, 1)))
    x = rotated.unit(x)
    a, b, cosine = rotated.encoded(x), rotated.encoded(y), (x * y).sum(1)
    off = np.abs(rotated.estimates(a, b, dim) - cosine)
    assert (off <= (np.sqrt(np.maximum(1 - cosine**2, 0)) * np.sqrt(np.maximum(1 - a["factor"].astype(float) ** 2, 0)) + b["lost"]) / a["factor"] + 1e-5).all()
    for least in (0.5, 0.9, 0.95):
        assert rotated.may_link(a, b, dim, least)[cosine >= least].all()
    if dim >= 64:  # nearly all others are thrown out without their vectors
        assert rotated.may_link(a, np.roll(b, 1), dim, 0.95).mean() < 0.01


def test_estimates_are_unbiased_over_rotations(monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rotated.unit(rng.normal(size=(2, 64)))
    y = rotated.unit((0.8 * x + 0.6 * y)[None])[0]
    got = []
    for seed in range(400):
        monkeypatch.setattr(rotated, "SEED", seed)
        rotated.rotations.cache_clear()
        a, b = rotated.encoded(x[None]), rotated.encoded(y[None])
        got.append(float(rotated.estimates(a, b, 64)[0]))
    rotated.rotations.cache_clear()
    assert abs(np.mean(got) - x @ y) < 4 * np.std(got) / 20 and np.std(got) > 0.01


def test_tables_reach_the_stated_recall():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x = rotated.unit(x)
    z = rng.normal(size=x.shape)
    z = rotated.unit(z - (z * x).sum(1)[:, None] * x)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z  # all at the threshold
    bits, number = rotated.tables(50_000, 0.95, 0.995, 64)
    a, b = (rotated.keys(rotated.encoded(v), 64, bits, number) for v in (x, y))
    assert (a == b).any(1).mean() > 0.99


def brute(rows, least=0.95):
    n = len(rows)
    ok = [v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    u = [rotated.unit(np.array([v], float))[0] if o else None for (_, v), o in zip(rows, ok, strict=True)]
    link = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= least] for i in range(n)]
    part = list(range(n))
    for i in range(n):
        stack, part[i] = [i], part[i]
        seen = {i}
        while stack:
            for j in link[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        part[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((i, len(k), c, i == c) for (i, _), k, c in zip(rows, link, part, strict=True)), key=str)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, "c", 0, (1,)) for i, v in rows], SCHEMA)
    return sorted(map(tuple, neighbours.near_duplicates(df, **settings).collect()), key=str)


@pytest.mark.parametrize("settings", [{"recall": 0.999999}, {"recall": 0.999999, "block": 16, "mean": 4}])
def test_equals_brute_force(spark, settings):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    rows += [(200 + i, (np.array(rows[3][1]) + rng.normal(size=16) * 0.08).tolist()) for i in range(100)]  # a third are near copies
    rows += [(400 + i, rows[5][1]) for i in range(60)] + [(500, [2 * c for c in rows[6][1]]), (501, [1e200 * c for c in rows[6][1]]), (502, [1e-200 * c for c in rows[6][1]])]
    walk = np.array(rows[9][1])
    for i in range(30):  # a chain of links
        walk = walk + rng.normal(size=16) * 0.15
        rows.append((600 + i, walk.tolist()))
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [float("inf")] + [1.0] * 15), (704, [None] * 16), (705, []), (706, [1.0]), (707, [3.0]), (708, [-1.0])]
    rows += [(709, [1.0, 2.0]), (710, [1.0, 2.1]), (None, rows[6][1]), (None, None), (None, [5.0, -7.0, 1.0]), (3, rows[3][1]), (711, [0.0, 1.0]), (712, [-0.0, 2.0])]
    assert run(spark, rows, **settings) == brute(rows)


def test_empty_table_and_other_thresholds(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 1, True)]
    rng = np.random.default_rng(9)
    rows = [(i, (np.array([1.0, 1, 1, 1]) + rng.normal(size=4) * 0.4).tolist()) for i in range(60)]
    assert run(spark, rows, least=0.9, recall=0.999999) == brute(rows, 0.9)


def test_no_group_of_copies_gives_pairs(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=32)
    rows = [(i, (base + rng.normal(size=32) * 0.02).tolist()) for i in range(200)]
    d = spark.createDataFrame([(v, 1, i) for i, v in rows], "v array<double>, copies bigint, vid bigint")
    found = neighbours.links(d, block=32).collect()
    edges = [r for r in found if r.b is not None]
    assert sum(r.n for r in found if r.b is None) == 200 * 199  # every link counted once
    assert len(edges) < 200 * 40  # of 19,900 links, forests of the buckets only


def test_hook_gives_a_spanning_forest():
    rng = np.random.default_rng(11)
    i, j = rng.integers(0, 300, (2, 260))
    keep = i != j
    root = np.arange(300)
    a, b = neighbours._hook(root, i[keep], j[keep])
    other = np.arange(300)
    again = neighbours._hook(other, a, b)
    assert (root == other).all() and len(again[0]) == len(a) == 300 - len(np.unique(root))
