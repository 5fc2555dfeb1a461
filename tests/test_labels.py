import json

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.functions import scalar as S
from undula.operators import energy, fusion, losses, metrics, search, splits, tagging, weights


def reference_sizes(n, fractions):
    """Floors, then the largest remainders; reversed ascending order puts the later part first on ties."""
    f = np.array(fractions, float) / sum(fractions)
    raw = f * n
    out = np.floor(raw).astype(int)
    for i in np.argsort(raw - out, kind="stable")[::-1][: n - out.sum()]:
        out[i] += 1
    return out.tolist()


@pytest.mark.parametrize("fractions", [(0.8, 0.1, 0.1), (0.5, 0.25, 0.25), (1, 1, 1), (0.9, 0.1, 0.0), (0, 0, 2), (3, 2, 5)])
def test_split_sizes(spark, fractions):
    df = spark.range(0, 64).select(F.col("id").alias("n"))
    rows = df.select("n", *[c.alias(f"s{i}") for i, c in enumerate(splits.split_sizes(F.col("n"), fractions))]).collect()
    for r in rows:
        assert [r.s0, r.s1, r.s2] == reference_sizes(r.n, fractions), r


def test_split_guards(spark):
    for bad in ((0.5, 0.5), (1, -1, 1), (0, 0, 0)):
        with pytest.raises(ValueError):
            splits.normalise_fractions(bad)
    df = spark.createDataFrame([(1, 0, 0, "train")], "win_id int, y int, domain int, split string")
    with pytest.raises(ValueError):
        splits.train_val_split(df, "y", "win_id", 1.0)
    with pytest.raises(ValueError):
        splits.select_subjects(df, [])
    with pytest.raises(ValueError):
        splits.select_subjects(df, [5])
    with pytest.raises(ValueError):
        splits.prepare_case(df, "subject", target=5)
    with pytest.raises(ValueError):
        splits.prepare_case(df, "other")


@pytest.fixture(scope="module")
def classes(spark):
    sizes = {0: 1, 1: 2, 2: 5, 3: 3000}
    rows = [(f"{y}-{i}", y) for y, n in sizes.items() for i in range(n)]
    return sizes, spark.createDataFrame(rows, "id string, y int").repartition(6).cache()


def test_stratified_split(classes):
    sizes, df = classes
    out = splits.stratified_split(df, "y", "id", seed=1)
    got = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    for y, n in sizes.items():
        assert [got.get((y, p), 0) for p in splits.PARTS] == reference_sizes(n, (0.8, 0.1, 0.1))
    again = splits.stratified_split(df.repartition(3), "y", "id", seed=1)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


@pytest.mark.parametrize("n", [2, 1000, 1001, 5000])
def test_balanced_sample(classes, n):
    sizes, df = classes
    out = splits.balanced_sample(df, "y", "id", n, 3)
    rows = out.collect()
    assert len({r.id for r in rows}) == len(rows)
    for y, m in sizes.items():
        assert sum(r.y == y for r in rows) == min(n, m)


def test_draws_are_class_balanced(classes):
    _, df = classes
    rows = splits.balanced_draws(df, "y", "id", 2).collect()
    assert len(rows) == 3008 and len({r.draw for r in rows}) == 3008
    for y in range(4):
        assert abs(sum(r.y == y for r in rows) / 3008 - 0.25) < 0.04


def test_recordings_are_not_split(spark):
    df = spark.createDataFrame([(r, r % 2, i) for r in range(40) for i in range(5)], "rec int, y int, i int")
    out = splits.by_recording_split(df.select("rec", "y").distinct(), df, "rec", "y")
    assert out.count() == 200
    assert out.groupBy("rec").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()


def test_rebase(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "y int")
    values = lambda d: sorted(r.y for r in d.collect())
    assert values(splits.rebase_labels(df(1, 2, 3, 3), "y")) == [0, 1, 2, 2]
    assert values(splits.rebase_labels(df(1, 3), "y")) == [1, 3]
    assert values(splits.rebase_labels(df(0, 1), "y")) == [0, 1]


def test_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (2,)], "y int")
    with pytest.raises(ValueError):
        weights.balanced_class_weights(df, "y", 3)
    got = {r.y: r.weight for r in weights.inverse_frequency_weights(df, "y").collect()}
    assert got == {0: 100 / 3, 1: 0.0, 2: 100.0}
    full = {r.y: (r.n, r.weight) for r in weights.balanced_class_weights(df.filter("y = 0").union(df.selectExpr("y * 0 + 1")), "y", 2).collect()}
    assert sum(n * w for n, w in full.values()) == pytest.approx(7, rel=1e-6)
    none = spark.createDataFrame([(2, 0.5), (1, 1.0)], "a int, b double")
    assert none.agg(weights.positive_weight(F.col("a"), F.col("b"))).first()[0] == 1.0
    some = spark.createDataFrame([(2, 0.0), (2, 0.0), (2, 1.0)], "a int, b double")
    assert some.agg(weights.positive_weight(F.col("a"), F.col("b"))).first()[0] == 2.0


def test_tag_priority(spark):
    cols = "rec int, start bigint, y_win double, seq bigint"
    auto = spark.createDataFrame([(1, 0, 0.0, 1), (1, 0, 1.0, 2), (1, 8, 0.0, 3), (2, 0, 0.3, 4)], cols)
    manual = spark.createDataFrame([(1, 8, 0.5, 1), (1, 8, 1.0, 2), (3, 0, 0.999999, 3)], cols)
    got = {(r.rec, r.start): (r.y_h2, r.src_h2) for r in fusion.merge_tags(auto, manual, ["rec"]).collect()}
    assert got == {(1, 0): (1.0, 0), (1, 8): (0.5, 1), (2, 0): (0.5, 0), (3, 0): (1.0, 1)}
    w = spark.createDataFrame([(1, 2, 0), (1, 2, 8), (3, 2, 0), (3, 1, 0), (9, 2, 0)], "rec int, y_h1 int, start bigint")
    out = fusion.window_targets(w, fusion.merge_tags(auto, manual, ["rec"]), ["rec"])
    rows = {(r.rec, r.y_h1, r.start): (r.y_h2, r.src_h2, r.w_h2) for r in out.collect()}
    assert rows == {(1, 2, 0): (1.0, 0, 0.4), (1, 2, 8): (0.5, 1, 0.0), (3, 2, 0): (1.0, 1, 1.0), (3, 1, 0): (0.5, 0, 0.0), (9, 2, 0): (0.5, 0, 0.0)}


def test_four_classes(spark):
    df = spark.createDataFrame([(2, 0.5, 0.3), (2, 0.2, 0.0)], "y_h1 int, y_h2 double, w_h2 double")
    with pytest.raises(ValueError):
        fusion.four_classes(df)
    with pytest.raises(ValueError):
        fusion.four_classes(df, "keep")
    assert [(r.y, r.weight) for r in fusion.four_classes(df, "stable", -1.0).collect()] == [(2, 0.0), (2, 0.0)]


def test_scalars(spark):
    row = spark.createDataFrame([("a/b\\c.tar.txt", " d07 ", 0.125, 3661.5, -4.0)], "p string, c string, x double, s double, neg double").select(
        S.stem(F.col("p")), S.canonical(F.col("c")), S.clip_round(F.col("x"), 0.0, 1.0, 2), S.duration(F.col("s")), S.duration(F.col("neg")),
        S.sigmoid(F.lit(1000.0)), S.stem(F.lit(".hidden")),
    ).first()
    assert tuple(row)[:5] == ("c.tar", "D07", 0.12, "01:01:02", "00:00:00") and row[5] == pytest.approx(1.0) and row[6] == ".hidden"


def test_empty_evaluations(spark):
    df = spark.createDataFrame([], "t int, p int, y double")
    r = tagging.binary_evaluation(df, F.col("t"), F.col("p"), F.col("y"), F.col("y"), F.col("y")).first().asDict()
    assert all(v == 0 for v in r.values())
    h = spark.createDataFrame([(1.0, 0.5, 2)], "z double, y_h2 double, y_h1 int")
    assert losses.head2_loss(h).first().loss == 0.0
    e = spark.createDataFrame([("a", "x", "g", "dense_linear", 0, 1, 0, 0, 0)], "run string, layer string, group string, kind string, macs int, input_nonzero int, input_numel int, lif_nonzero int, lif_numel int")
    lay = energy.with_energy(energy.layer_totals(e))
    assert math.isnan(lay.first().input_rate)
    rep = energy.energy_report(lay, spark.createDataFrame([("a", 0)], "run string, n_samples int"))
    assert all(math.isnan(r.energy_total_reduction) and r.n_samples == 1 for r in rep.collect())
    c = metrics.confusion_counts(spark.createDataFrame([(0, 1)], "y_true int, y_pred int"), [0, 1, 2])
    assert c.count() == 9 and c.agg(F.sum("n")).first()[0] == 1


def test_hysteresis_and_smoothing(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(size=400).round(2)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(p)] + [(1, 0, 0.6), (2, 0, 0.9), (2, 1, 0.4)], "k int, i bigint, p double")
    with pytest.raises(ValueError):
        tagging.hysteresis(df, ["k"], "i", "p", 0.5, 0.5, "h")
    got = [r.h for r in tagging.hysteresis(df, ["k"], "i", "p", 0.6, 0.4, "h", width=7).filter("k = 0").orderBy("i").collect()]
    on, want = False, []
    for v in p:
        on = (on and v > 0.4) or (not on and v >= 0.6)
        want.append(int(on))
    assert got == want
    for k in (1, 2, 3, 4, 5):
        m = [r.m for r in tagging.moving_average(df, ["k"], "i", "p", k, "m").filter("k = 0").orderBy("i").collect()]
        assert np.allclose(m, np.convolve(p, np.ones(k) / k, "same") if k > 1 else p)
    short = tagging.moving_average(df, ["k"], "i", "p", 5, "m").filter("k = 2").orderBy("i").collect()
    assert np.allclose([r.m for r in short], [1.3 / 5, 1.3 / 5])


def test_logistic_fit_reaches_the_optimum(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=300) > 0.8).astype(float)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "f array<double>, y double")
    m = tagging.fit_weighted_logistic(df.withColumn("features", array_to_vector("f")), "y", 2e-3, 500)
    cw = (len(y) - y.sum()) / (y.sum() + 1e-6)
    wt, w, b = 1 + (cw - 1) * y, np.zeros(4), 0.0
    for _ in range(60_000):
        d = (1 / (1 + np.exp(-(x @ w + b))) - y) * wt
        w -= 0.05 * (x.T @ d / len(y) + 2e-3 * w)
        b -= 0.05 * d.mean()
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-4) and abs(m.intercept - b) < 1e-4


def test_early_stop(spark):
    loss = [5, 4, 4, 3, 3, 3, 3, 1]
    log = spark.createDataFrame([("r", i + 1, float(v)) for i, v in enumerate(loss)], "run string, epoch bigint, loss double")
    h = metrics.training_history(log, "run", "epoch", "loss", 3, width=2).orderBy("epoch").collect()
    assert [r.epoch for r in h] == [1, 2, 3, 4, 5, 6, 7] and h[-1].best_epoch == 4 and h[-1].stop == 7
    assert [r.improved for r in h] == [True, True, False, True, False, False, False]


def brute_score(x, y, theta, n, m, dz):
    from undula.operators import kernels as K

    up, back = K.make_resampler(n, m, "linear"), K.make_back_resampler(n, m, "linear")
    th = np.asarray(theta, np.float32)
    dense = up(x)
    _, _, tr = K.delta_events(dense, th, np.float32(dz) * th, dense[..., 0], True)
    d = (x - back(tr)).astype(float)
    rel = [(d[y == k] ** 2).sum() / (x[y == k].astype(float) ** 2).sum() for k in np.unique(y)]
    return np.mean(rel) + 0.5 * np.max(rel)


def test_search_equals_sequential_descent(spark):
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.normal(size=(40, 3, 16)), axis=2).astype(np.float32)
    y = rng.integers(0, 3, 40)
    frame = lambda s: spark.createDataFrame([(int(k), a.tolist()) for k, a in zip(y[s], x[s])], "y int, x array<array<float>>").cache()
    tr, va = slice(0, 25), slice(25, 40)
    s = search.SearchSettings([1.0, 0.7, 1.3], [2.0, 2.0, 1.4], 16, 64, init_step=0.25, min_step=0.05, decimals=3, alpha=0.5, max_epochs=5, patience_step=1, theta_min=0.01)
    got = search.ThetaSearch(frame(tr), frame(va), s).run()
    score = lambda sl, t: brute_score(x[sl], y[sl], t, 16, 64, 0.5)
    theta, step, best, stale = list(np.float32(s.theta0).astype(float)), 0.25, None, 0
    cur = score(tr, theta)
    best = (score(va, theta), list(theta))
    history = []
    for _ in range(5):
        before = cur
        for c in range(3):
            low, pick = cur, list(theta)
            for v in (theta[c] - step, theta[c] + step):
                cand = list(theta)
                cand[c] = search.clip_theta(v, 0.01, s.theta_max[c], 3)
                sc = score(tr, cand)
                if sc + 1e-7 < low:
                    low, pick = sc, cand
            if low + 1e-7 < cur:
                theta, cur = pick, low
        v = score(va, theta)
        if v + 1e-7 < best[0]:
            best, stale = (v, list(theta)), 0
        else:
            stale += 1
            if stale >= 1:
                step, stale = max(0.05, round(step * 0.5, 3)), 0
        history.append((step, list(theta)))
        if step <= 0.05 and cur >= before:
            break
    assert [(h[1], h[2]) for h in got["history"][1:]] == history
    assert got["theta"] == best[1] and got["val"] == pytest.approx(best[0], rel=1e-9)
    assert got["jobs"] < 3 * 2 * len(history) + len(history)
    states = []
    again = search.ThetaSearch(frame(tr), frame(va), s).run(save=lambda x: states.append(json.dumps(x)))
    assert again["history"] == got["history"] and len(states) == len(history)
    for stopped in (states[0], states[-2], states[-1]):
        rest = search.ThetaSearch(frame(tr), frame(va), s)
        on = rest.run(json.loads(stopped))
        assert on["history"] == got["history"] and on["theta"] == got["theta"] and on["val"] == got["val"]
