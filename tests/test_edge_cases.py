"""Values and shapes off the common path: special numbers, missing rows, odd starts, equal names."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import write
from undula import session
from undula.operators import energy, intervals, metrics, quantiles, segment, tagging
from undula.plans import folders, jobs
from undula.sources import text

INF, NAN = float("inf"), float("nan")
SPECIAL = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, NAN], [1.0, 2.0, 3.0, INF], [-INF, 1.0, 2.0, 3.0], [-INF, INF], [INF, INF, NAN, NAN], [0.0, -0.0, 5e-324, -5e-324], [1.7e308, -1.7e308, 2.0**1023], [NAN], [1.0] * 9 + [None]]


@pytest.mark.parametrize("bits", [quantiles.BITS, (1, 10, 41), (16, 36)])
def test_quantiles_do_not_depend_on_the_rounds(spark, bits):
    df = spark.createDataFrame([(g, v) for g, vs in enumerate(SPECIAL) for v in vs], "g int, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p5": 0.5, "p9": 0.9, "p1": 1.0}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs.values()])).alias("q")).collect()}
    got = {r.g: [r[k] for k in probs] for r in quantiles.exact_quantiles(df, ["g"], "v", probs, bits).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert [str(x) for x in got[g]] == [str(x) for x in want[g]] or np.array_equal(got[g], want[g], equal_nan=True)


def test_value_cells_follow_the_values(spark):
    v = [-INF, -1.7e308, -3.0, -1.0, -5e-324, 0.0, 5e-324, 1e-310, 0.99999, 1.0, 2.0**1023, 1.7e308, INF, NAN]
    cells = [r.c for r in spark.createDataFrame(list(enumerate(v)), "i int, v double").select("i", quantiles.value_cell(F.col("v")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells) and cells[-1] > cells[-2] > cells[-3] and cells[0] < cells[1]


def test_runs_without_sample_counts_stay(spark):
    calls = [(r, "l", "g", "dense_linear", 10.0, 1, 2, 0, 0, 0.0) for r in ("a", "b")]
    c = spark.createDataFrame(calls, "run string, layer string, group string, kind string, macs double, input_nonzero long, input_numel long, lif_nonzero long, lif_numel long, x double")
    rep = energy.energy_report(energy.with_energy(energy.layer_totals(c)), spark.createDataFrame([("a", 4), ("c", 1)], "run string, n_samples long"))
    assert {(r.run, r.n_samples, r.dense_macs_per_sample) for r in rep.filter("level = 'run'").collect()} == {("a", 4, 2.5), ("b", 1, 10.0)}


def test_comparison_has_groups_rates_and_dataset(spark):
    calls = [("a", "l1", "g", "spiking_conv1d", 10.0, 1, 2, 3, 4), ("a", "l2", "h", "dense_linear", 6.0, 1, 2, 1, 4), ("b", "l2", "h", "dense_linear", 8.0, 1, 2, 0, 0)]
    c = spark.createDataFrame(calls, "run string, layer string, group string, kind string, macs double, input_nonzero long, input_numel long, lif_nonzero long, lif_numel long")
    lay = energy.with_energy(energy.layer_totals(c))
    rep = energy.energy_report(lay, spark.createDataFrame([("a", 2)], "run string, n_samples long"))
    conf = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "run string, seed int, dataset string")
    got = {r.run: r for r in energy.run_comparison(rep, conf, spark.createDataFrame([("a", 0.5)], "run string, acc double"), ["seed"], layers=lay).collect()}
    assert (got["a"].dataset, got["a"].test_acc, got["a"].g_dense_macs, got["a"].h_dense_macs, got["a"].h_compute, got["a"].l1_rate) == ("x", 0.5, 10.0, 6.0, 3.0, 0.75)
    assert (got["b"].n_samples, got["b"].h_dense_macs, got["b"].g_dense_macs) == (1, 8.0, None) and got["c"].dense_macs is None


def test_starts_off_the_grid_are_refused(spark):
    w = spark.createDataFrame([("r", 3)], "k string, start long")
    spans = spark.createDataFrame([("r", "transition", 0.0, 9.0)], "k string, kind string, t0 double, t1 double")
    with pytest.raises(Exception, match="no multiple"):
        intervals.window_coverage(w, intervals.sample_ranges(spans, 1.0), ["k"], 8, 8, ["transition"]).collect()
    with pytest.raises(Exception, match="no multiple"):
        intervals.gaussian_scores(w, spans, ["k"], 1.0, 8, 8, {"s": "mean"}).collect()


def test_an_interval_far_beyond_the_recording(spark):
    w = spark.createDataFrame([("r", 0), ("r", 8)], "k string, start long")
    long = intervals.gaussian_scores(w, spark.createDataFrame([("r", 0.0, 1e9), ("other", 0.0, 1e9)], "k string, t0 double, t1 double"), ["k"], 1.0, 8, 8, {"mean": "mean", "max": "max", "mid": "center", "q": "q"})
    c, s = 5e8, 4e8
    for r in long.collect():
        g = [math.exp(-0.5 * ((t - c) / s) ** 2) for t in range(r.start, r.start + 8)]
        assert r["mean"] == pytest.approx(sum(g) / 8) and r["max"] == pytest.approx(max(g)) and r["mid"] == pytest.approx(g[4]) and r["q"] == pytest.approx(np.quantile(g, 0.8))


def test_history_with_nan_and_gaps(spark):
    log = [("a", 0, NAN), ("a", 1, 2.0), ("a", 5, 3.0), ("a", 9, None), ("a", 10, 1.0), ("b", 0, NAN), ("b", 1, NAN), ("b", 2, 1.0)]
    h = metrics.training_history(spark.createDataFrame(log, "run string, epoch long, loss double"), "run", "epoch", "loss", 2)
    got = {(r.run, r.epoch): (r.improved, r.best, r.bad_epochs, r.stop) for r in h.collect()}
    assert got == {
        ("a", 0): (False, None, 1, 9), ("a", 1): (True, 2.0, 0, 9), ("a", 5): (False, 2.0, 1, 9), ("a", 9): (False, 2.0, 2, 9),
        ("b", 0): (False, None, 1, 1), ("b", 1): (False, None, 2, 1),
    }


def test_peak_windows_of_one_channel(spark):
    s = spark.createDataFrame([("r", i, float(-9 if i == 13 else i % 3)) for i in range(20)], "k string, idx long, c0 double")
    rec = segment.recording_lengths(s, ["k"])
    starts = lambda d: sorted(r.start for r in d.collect())
    assert starts(segment.global_peak_starts(s, rec, ["k"], ["c0"], 8, F.lit(4))) == [8, 12]
    assert starts(segment.first_peak_starts(s, rec, ["k"], ["c0"], 8, F.lit(4))) == [8, 12]


def test_one_class_cannot_be_fitted(spark):
    from pyspark.ml.linalg import Vectors

    for y in (0.0, 1.0):
        with pytest.raises(ValueError, match="both classes"):
            tagging.fit_weighted_logistic(spark.createDataFrame([(Vectors.dense([1.0]), y)] * 3, ["features", "y"]), "y", 0.1, 5)


def test_only_shared_folders_for_clusters(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.own_root(False, "file:///", "app")
    assert session.own_root(False, "hdfs://n:1/", "app-1") == "hdfs://n:1/tmp/undula-staging-app-1"
    assert session.staging_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_equal_file_names_are_two_recordings(spark, tmp_path):
    rng, names = np.random.default_rng(3), []
    for folder in ("a", "b"):
        for i in range(6):
            name = f"D07_SA{i + 1:02d}_R01"
            move = np.arange(1500) % 1040 >= 500
            x = rng.normal(size=(1500, 9)) * np.where(move, 60, 4)[:, None] + (250 if folder == "a" else -250)
            write(tmp_path / "data" / folder / f"{name}.txt", "\n".join(",".join(str(int(v)) for v in r) + ";" for r in x))
            names.append(name)
    spans = {"transition": [{"t0": 2.5, "t1": 5.2}], "no_transition": [{"t0": 0, "t1": 2.5}, {"t0": 5.2, "t1": 7.5}]}
    for name in set(names[:4]):
        write(tmp_path / "labels" / f"{name}.json", json.dumps({"fs": 200, "labels": spans}))
    data, tags = str(tmp_path / "data"), str(tmp_path / "tags")
    s = folders.tag_folder(spark, data, str(tmp_path / "labels"), tags, jobs.TagWindows(steps=20))
    assert s["raw_data"]["recordings"] == 12 and s["autotagged_records"]["files"] == 12 and s["manual_records"]["files"] == 8
    d = folders.recording_events_folder(spark, data, tags, str(tmp_path / "events"), jobs.EventSettings(out_len=256))
    assert d.select("path").distinct().count() == 12 and d.select("file").distinct().count() == 6
    m = text.read_recordings(spark, data)
    per = m.groupBy("path").agg(F.count("*").alias("n"), F.max(F.col("c0") > 0).alias("up")).collect()
    assert len(per) == 12 and all(r.n == 1500 for r in per)


def test_staged_tables_can_be_deleted(spark, tmp_path, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(session, "_staged", {})
    t = session.stage(spark.range(3), "gone")
    assert t.count() == 3
    (p,) = session._staged[spark.sparkContext.applicationId]
    assert Path(p).exists() and session.clear_staged(spark) == 1 and not Path(p).exists()
