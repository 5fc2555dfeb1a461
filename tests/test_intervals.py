import numpy as np
import pytest

from undula.operators import intervals as I

WIN, HOP, FS = 20, 10, 10.0


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(4)
    n = {0: 300, 1: 25, 2: 20}
    spans = [
        (0, "a", 0.0, 2.0), (0, "a", 1.0, 3.0), (0, "a", 3.0, 3.5), (0, "a", 5.0, 5.0), (0, "a", 7.0, 6.0), (0, "a", -2.0, 0.45),
        (0, "a", 29.0, 99.0), (1, "a", 0.31, 0.39), (1, "b", 0.0, 9.0), (2, "b", 1.95, 2.0), (0, "b", 4.0, 12.0), (0, "b", 4.0, 6.0),
    ]
    spans += [(0, "b", float(t), float(t + d)) for t, d in zip(rng.uniform(0, 28, 40), rng.uniform(0.05, 3, 40))]
    w = [(r, s) for r, m in n.items() for s in range(0, m - WIN + 1, HOP)]
    return (
        n, spans,
        spark.createDataFrame(w, "rec int, start bigint"),
        spark.createDataFrame(spans, "rec int, kind string, t0 double, t1 double").cache(),
    )


def mask(n, spans, rec, kind):
    y = np.zeros(n[rec])
    for r, k, t0, t1 in spans:
        if r == rec and k == kind:
            a, b = max(0, int(np.floor(t0 * FS))), min(n[rec], int(np.ceil(t1 * FS)))
            if b > a:
                y[a:b] = 1
    return y


def test_merge_keeps_the_mask(case):
    n, spans, _, df = case
    for width in (3, 1000):
        merged = I.merge_ranges(I.sample_ranges(df, FS), ["rec", "kind"], width).collect()
        for rec in n:
            for kind in "ab":
                y = np.zeros(n[rec])
                mine = sorted((r.a, r.b) for r in merged if r.rec == rec and r.kind == kind)
                assert all(b < c for (_, b), (c, _) in zip(mine, mine[1:]))
                for a, b in mine:
                    y[a:b] = 1
                assert np.array_equal(y, mask(n, spans, rec, kind))


@pytest.mark.parametrize("q", [0.8, 0.5, 1.0, 0.0])
def test_coverage_modes(case, q):
    n, spans, w, df = case
    c = I.window_coverage(w, I.sample_ranges(df, FS), ["rec"], WIN, HOP, ["a", "b"])
    cols = [I.coverage_score(k, WIN, m, q).alias(f"{k}_{m}") for k in "ab" for m in I.MODES]
    rows = c.select("rec", "start", *cols).collect()
    assert len(rows) == w.count()
    for r in rows:
        for k in "ab":
            y = mask(n, spans, r.rec, k)[r.start : r.start + WIN]
            want = {"mean": y.mean(), "center": y[WIN // 2], "max": y.max(), "q": np.quantile(y, q)}
            for m, v in want.items():
                assert np.isclose(r[f"{k}_{m}"], v, atol=1e-9), (r, k, m)


def test_quantile_steps_of_the_full_window(spark):
    df = spark.createDataFrame([(m,) for m in (81, 82, 83)], "ones_x int")
    got = [r[0] for r in df.select(I.coverage_score("x", 410, "q", 0.8)).collect()]
    assert got[0] == 0 and abs(got[1] - 0.2) < 1e-9 and got[2] == 1


def test_gaussian_modes(case):
    n, spans, w, df = case
    modes = {m: m for m in I.MODES}
    rows = I.gaussian_scores(w, df.filter("kind = 'b'"), ["rec"], FS, WIN, HOP, modes).collect()
    for r in rows:
        t = np.arange(n[r.rec]) / FS
        y = np.zeros(n[r.rec])
        for rec, k, t0, t1 in spans:
            if rec == r.rec and k == "b" and t1 > t0:
                g = np.exp(-0.5 * ((t - (t0 + t1) / 2) / max((t1 - t0) * 0.4, 1 / FS)) ** 2) * ((t >= t0) & (t <= t1))
                y = np.maximum(y, g)
        y = y[r.start : r.start + WIN]
        want = {"mean": y.mean(), "center": y[WIN // 2], "max": y.max(), "q": np.quantile(y, 0.8)}
        assert all(np.isclose(r[m], v, atol=1e-9) for m, v in want.items())


def test_match_reasons(spark):
    rec = spark.createDataFrame([("a.txt", 2, 500), ("b.txt", 1, 500), ("c.txt", 2, 9)], "file string, y int, n int")
    lab = spark.createDataFrame([("a.txt",), ("A.txt",), ("b.txt",), ("c.txt",)], "file string")
    got = {r.file: r.reject for r in I.match_labels(rec, lab, 410).collect()}
    assert got == {"a.txt": None, "A.txt": "not_found", "b.txt": "non_static", "c.txt": "too_short"}
