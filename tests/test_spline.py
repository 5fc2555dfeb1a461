"""Cubic splines at arbitrary times: chunked solves against a dense solve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import resample, spline


def dense(t, v):
    """Second derivatives from the full system, not-a-knot at both ends."""
    n = len(t)
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    a, r = np.zeros((n, n)), np.zeros(n)
    a[0, :3] = -1 / h[0], 1 / h[0] + 1 / h[1], -1 / h[1]
    a[-1, -3:] = -1 / h[-2], 1 / h[-2] + 1 / h[-1], -1 / h[-1]
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * (d[i] - d[i - 1])
    return np.linalg.solve(a, r)


def value(t, v, m, x):
    i = np.clip(np.searchsorted(t, x, side="right") - 1, 0, len(t) - 2)
    h = t[i + 1] - t[i]
    b = (x - t[i]) / h
    a = 1 - b
    return a * v[i] + b * v[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h * h / 6


@pytest.mark.parametrize("n", [4, 5, 6, 50, 700])
def test_second_derivatives(n):
    rng = np.random.default_rng(n)
    t, v = np.cumsum(rng.exponential(size=n) ** 2 + 1e-3), rng.normal(size=n)
    assert np.allclose(spline.second_derivatives(t, v), dense(t, v), rtol=1e-7, atol=1e-7 * np.abs(dense(t, v)).max())


def test_a_halo_is_as_good_as_the_whole_line():
    rng = np.random.default_rng(7)
    t, v = np.cumsum(10.0 ** rng.uniform(-3, 3, 3000)), rng.normal(size=3000)  # steps of very different lengths
    m = spline.second_derivatives(t, v)
    part = slice(1000 - spline.HALO, 1400 + spline.HALO)
    near = spline.second_derivatives(t[part], v[part], False, False)[spline.HALO : -spline.HALO]
    assert np.abs(near - m[1000:1400]).max() <= 1e-12 * np.abs(m[part]).max()


def test_at_times_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(resample, "spline_segments", lambda *a: spline.spline_segments(*a, size=100))
    rng = np.random.default_rng(3)
    lines = {k: (np.cumsum(rng.exponential(size=n) + 0.01), rng.normal(size=n)) for k, n in (("long", 2500), ("short", 5), ("four", 4))}
    lines["three"], lines["one"] = (np.array([1.0, 2.0, 4.0]), np.array([0.0, 1.0, 5.0])), (np.array([2.0]), np.array([7.0]))
    lines["cubic"] = (np.arange(30.0), np.arange(30.0) ** 3)
    src = [(k, i, float(a), float(b)) for k, (t, v) in lines.items() for i, (a, b) in enumerate(zip(t, v, strict=True))]
    src += [("long", 9999, None, 1.0), ("long", 9998, 5.0, None)]
    at = {k: np.concatenate((rng.uniform(t[0] - 3, t[-1] + 3, 300), t)) for k, (t, _) in lines.items()}
    s = spark.createDataFrame(src, "k string, i long, t double, v double").repartition(5)
    d = spark.createDataFrame([(k, j, float(x)) for k, xs in at.items() for j, x in enumerate(xs)] + [("unknown", 0, 1.0)], "k string, j int, t double")
    got = {}
    for r in resample.at_times(s, d, ["k"], "t", "v", "i", 50.0, "cubic").collect():
        got.setdefault(r.k, {})[r.j] = r.v
    for k, (t, v) in lines.items():
        y = np.array([got[k][j] for j in range(len(at[k]))])
        if k == "one":
            assert (y == 7.0).all()
            continue
        m = dense(t, v) if len(t) > 3 else np.zeros(len(t))
        want = value(t, v, m, at[k])
        assert np.allclose(y, want, rtol=1e-8, atol=1e-8 * np.abs(want).max()), k
    assert np.allclose([got["cubic"][j] for j in range(300)], at["cubic"][:300] ** 3, atol=1e-6) and got["unknown"][0] is None


def test_equal_times_are_refused(spark):
    s = spark.createDataFrame([("a", i, float(t), 1.0) for i, t in enumerate([0, 1, 1, 2, 3])], "k string, i long, t double, v double")
    with pytest.raises(Exception, match="must differ"):
        resample.at_times(s, s.select("k", "t"), ["k"], "t", "v", "i", 10.0, "cubic").agg(F.sum("v")).collect()
    with pytest.raises(ValueError, match="method"):
        resample.at_times(s, s.select("k", "t"), ["k"], "t", "v", "i", 10.0, "quintic")
