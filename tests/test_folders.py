"""The folder jobs on small generated data sets."""

import json

import numpy as np
import pytest

from tests.test_sources import matrices, write
from undula.__main__ import main
from undula.plans import folders, jobs
from undula.sources import store


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    """Still and moving stretches; annotations mark them in half of the static recordings."""
    root, rng = tmp_path_factory.mktemp("rec"), np.random.default_rng(8)
    for i in range(24):
        code = ("F01", "D01", "D07")[i % 3]
        n = 1500 + 40 * i
        move = np.arange(n) % 1040 >= 500
        x = rng.normal(size=(n, 9)) * np.where(move, 60, 4)[:, None] + [0, 250, 0, 0, 0, 0, 0, 250, 0]
        name = f"{code}_SA{i + 1:02d}_R01"
        write(root / "data" / f"SA{i + 1:02d}" / f"{name}.txt", "\n".join(",".join(str(int(v)) for v in r) + ";" for r in x))
        if code == "D07" and i % 2 == 0:
            spans = {"transition": [{"t0": 2.5, "t1": 5.2}], "no_transition": [{"t0": 0, "t1": 2.5}, {"t0": 5.2, "t1": 7.5}]}
            write(root / "labels" / f"{name}.json", json.dumps({"fs": 200, "labels": spans}))
    write(root / "labels" / "D07_SA99_R01.json", json.dumps({"transition": []}))
    write(root / "config.json", json.dumps({"steps": 7, "smooth_k": 5, "th_pt_on": 0.65, "posture_tagging": {"steps": 80, "pca_k": 4}}))
    return root


def test_tagging_and_events(spark, recordings, tmp_path):
    tags, events = str(tmp_path / "tags"), str(tmp_path / "events")
    args = ["tag", "--data", str(recordings / "data"), "--labels", str(recordings / "labels"), "--out", tags, "--config", str(recordings / "config.json"), "--smooth-k", "3"]
    s = main(args, spark)
    assert s["config"]["windows"]["steps"] == 80 and s["config"]["windows"]["pca_k"] == 4 and s["config"]["rules"]["smooth_k"] == 3
    assert s["config"]["rules"]["pt_on"] == 0.65
    assert s["raw_data"]["recordings"] == 24 and s["manual_annotations"] == {"files": 5, "skipped": {"not_found": 1}}
    assert s["autotagged_records"]["files"] == 8 and s["manual_records"]["files"] == 4
    e = s["evaluation"]
    assert e["n"] > 0 and e["tp"] + e["tn"] + e["fp"] + e["fn"] == e["n"] and e["recall"] > 0.5 and e["accuracy"] > 0.8
    assert main(args, spark) == s  # reused
    d = main(["recording-events", "--data", str(recordings / "data"), "--tags", tags, "--out", events, "--out-len", "512"], spark)
    assert {r.split for r in d.select("split").distinct().collect()} == {"train", "val", "test"} and d.filter("n_events > 0").count() > 0
    merged = d.filter("y_h1 = 2 AND w_h2 > 0")
    assert {(r.src_h2, r.w_h2) for r in merged.select("src_h2", "w_h2").distinct().collect()} == {(0, 0.4), (1, 1.0)}
    assert d.filter("y_h1 <> 2 AND (y_h2 <> 0.5 OR w_h2 <> 0)").isEmpty()


def test_windows_and_search(spark, tmp_path):
    matrices(tmp_path, "train", 90)
    matrices(tmp_path, "test", 30)
    root = str(tmp_path)
    common = ["--root", root, "--raw-win", "4", "--case", "official"]
    p = main(["prepare-windows", *common, "--out", root + "/p", "--val-ratio", "0.2"], spark)
    assert {r.split: r["count"] for r in p.groupBy("split").count().collect()} == {"train": 72, "val": 18, "test": 30}
    e = main(["window-events", *common, "--out", root + "/e", "--theta", "0.1,0.1,0.1,0.1,0.1,0.1", "--ups", "2"], spark)
    assert e.count() == 120 and len(e.first().offset) == 6
    with pytest.raises(ValueError):
        main(["window-events", *common, "--out", root + "/x", "--theta", "0.1,0.2"], spark)
    job = ["search", "--dataset", "windows", "--data", root, "--ups", "3", "--dead-zone", "0.5", "--case", "official", "--max-epochs", "2", "--out", root + "/s"]
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"val_per_class": 2}))
    folders.SEARCH_DEFAULTS["windows"] |= {"in_len": 4}
    try:
        r = main([*job, "--config", str(config)], spark)
        again = main([*job, "--config", str(config)], spark)
    finally:
        folders.SEARCH_DEFAULTS["windows"] |= {"in_len": 128}
    assert r == again and len(r["history"]) >= 2 and set(r["scores"]) == {"train", "val", "test_sampled", "test_full"}
    assert sum(r["n_windows"]["val"].values()) <= 12 and r["event_stats"]["test_full"]["global"]["n"] == 30


def test_pinned_length():
    assert folders.SearchJob("recordings", 5.0, 0.5).steps == 2048
    assert folders.SearchJob("recordings", 4.0, 0.5).steps == 1640
    assert folders.SearchJob("windows", 5.0, 0.5).steps == 640 and folders.WindowEvents().steps == 640
    assert folders.scaled_length(5, 0.5) == 2 and folders.scaled_length(7, 0.5) == 4


def test_recording_search_data(spark, recordings):
    from undula.session import stage
    from undula.sources import text

    samples = stage(text.read_recordings(spark, str(recordings / "data")), "samples")
    d = jobs.recording_search_data(samples, ["file"], text.CHANNELS, jobs.SearchData(3, 2, 2))
    got = {(r.part, r.y): r["count"] for r in d.groupBy("part", "y").count().collect()}
    assert all(got[("train", y)] == 3 for y in range(3)) and got[("test_full", 2)] >= got[("test_sampled", 2)]
    assert d.filter("part = 'train'").join(d.filter("part LIKE 'test%'"), "file", "left_semi").isEmpty()


def test_energy(spark, tmp_path):
    for n, acc in (("a_sis", 0.5), ("b_sis", 0.75)):
        write(tmp_path / "runs" / n / "config.json", json.dumps({"tau": 0.5, "kernels": [3, 3], "other": 1}))
        write(tmp_path / "runs" / n / "metrics" / "test_metrics.json", json.dumps({"acc": acc, "test_loss": 1.0}))
    rows = [(r, "", "", "", 0, 0, 0, 0, 0, 10) for r in ("a_sis", "b_sis")]
    rows += [("a_sis", "c1", "backbone", "spiking_conv1d", 100, 1, 4, 5, 20, None), ("b_sis", "c1", "backbone", "spiking_conv1d", 100, 0, 4, 5, 0, None)]
    rows += [("a_sis", "o", "head", "dense_linear", 30, 1, 1, 0, 0, None)]
    cols = "run string, layer string, group string, kind string, macs int, input_nonzero int, input_numel int, lif_nonzero int, lif_numel int, n_samples int"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "calls"))
    main(["energy", "--runs", str(tmp_path / "runs"), "--calls", str(tmp_path / "calls"), "--out", str(tmp_path / "out"), "--name", "SIS"], spark)
    got = {r.run: r for r in spark.read.json(str(tmp_path / "out" / "energy_summary_json")).collect()}
    a = got["a_sis"]
    assert a.energy_compute == pytest.approx(25 * 0.175 + 20 * 0.383 + 30) and a.energy_data == pytest.approx(25 * 1.819)
    assert a.kernels == "[3,3]" and a.tau == 0.5 and a.test_acc == 0.5 and a.test_loss == 1.0 and a.head_compute == pytest.approx(3.0)
    assert (a.place, got["b_sis"].place) == (2, 1) and float(a.c1_rate) == 0.25 and str(got["b_sis"].c1_rate) == "NaN"  # no output counted
    assert got["b_sis"].energy_compute == 0 and spark.read.option("header", True).csv(str(tmp_path / "out" / "energy_layers")).count() == 3
    assert store.exists(spark, str(tmp_path / "out" / "energy_summary"))
