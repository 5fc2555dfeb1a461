import json

import pytest
from pyspark.sql import functions as F

from undula.sources import annotations, store, text


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("set") / "with space"
    nine = "1, -2,+3,4, 5,6, 7,8,-9"
    write(root / "SA01" / "D01_SA01_R01.txt", f"{nine};\n\n 1,2,3\n{nine},10;\nnothing\n9,9,9,9,9,9,9,9,9\n")
    write(root / "SA01" / "f05_sa01_r02.TXT", "\n".join(",".join(str(i * j) for j in range(9)) for i in range(1000)))
    write(root / "SE02" / "D07_SE02_R03.txt", nine)
    write(root / "SE02" / "D20_SE02_R01.txt", nine)
    write(root / "SE02" / "notes.txt", nine)
    write(root / "SE02" / "D08_SE02_R01.txt", "1,2,3\n")
    write(root / "SE02" / "D09_SE02_R01.csv", nine)
    write(root / "desktop.ini", "x")
    return str(root)


def test_recordings(spark, folder):
    r = text.read_recordings(spark, folder)
    got = {(x.code, x.subject, x.trial, x.y): x.n for x in r.groupBy("code", "subject", "trial", "y").agg(F.count("*").alias("n")).collect()}
    assert got == {("D01", "SA01", "R01", 1): 3, ("F05", "SA01", "R02", 0): 1000, ("D07", "SE02", "R03", 2): 1}
    first = r.filter("code = 'D01'").orderBy("idx").collect()
    assert [x.idx for x in first] == [0, 1, 2]
    assert tuple(first[1][c] for c in text.CHANNELS) == (1, -2, 3, 4, 5, 6)
    other = text.read_recordings(spark, folder, "MMA8451Q").filter("code = 'D07'").first()
    assert tuple(other[c] for c in text.CHANNELS) == (7, 8, -9, 4, 5, 6)
    with pytest.raises(ValueError):
        text.read_recordings(spark, folder, "XYZ")


def test_line_order_across_blocks(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = text.text_lines(spark, folder)
        assert lines.filter(F.col("path").contains("f05")).select("block").distinct().count() > 2
        r = text.read_recordings(spark, folder).filter("code = 'F05'").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(r) == 1000 and all(x.c1 == x.idx for x in r)


def test_rejects(spark, folder):
    report = text.file_report(spark, folder)
    got = {r.reject: r.n for r in text.reject_counts(report).collect()}
    assert got == {"bad_name": 1, "unknown_code": 1, "empty": 1}
    assert report.filter("reject = 'ignored'").count() == 2 and report.count() == 8


def test_unreadable_files_are_reported_and_left_out(spark, tmp_path):
    rows = [(f"F0{i}_SA01_R01.txt", ", ".join(["7"] * 9)) for i in range(1, 4) for _ in range(300)]
    spark.createDataFrame(rows, "name string, value string").repartition(1, "name").write.partitionBy("name").text(f"{tmp_path}/rec")
    (tmp_path / "rec" / "F09_SA01_R01.txt").write_bytes(b"\xff\xfe 1 2 3 4 5 6 7 8 9\r\n" * 5)
    (tmp_path / "rec" / "F08_SA01_R01.txt").write_text("\n")
    part = next(f for f in (tmp_path / "rec" / "name=F02_SA01_R01.txt").iterdir() if f.suffix == ".txt")
    part.write_bytes(part.read_bytes().replace(b"7", b"8"))  # the check sums beside it no longer fit
    report = text.file_report(spark, str(tmp_path / "rec"))
    assert {r.file: (r.samples, r.reject) for r in report.collect()} == {
        "F01_SA01_R01.txt": (300, None), "F02_SA01_R01.txt": (None, "unreadable"), "F03_SA01_R01.txt": (300, None),
        "F08_SA01_R01.txt": (0, "empty"), "F09_SA01_R01.txt": (5, None),
    }
    with pytest.raises(Exception, match="[Cc]heck ?sum"):
        text.read_recordings(spark, str(tmp_path / "rec")).count()
    got = text.read_recordings(spark, str(tmp_path / "rec"), report=report).groupBy("code").count().collect()
    assert {r.code: r["count"] for r in got} == {"F01": 300, "F03": 300, "F09": 5}


def test_bundles_of_many_recordings(spark, tmp_path):
    rows = [(f"F{i:02}_SA01_R01.txt", j, ", ".join([str(i)] + [str(j)] * 8)) for i in range(1, 30) for j in range(20 * i)] + [("x.txt", 0, "1"), ("D77_SA01_R01.txt", 0, "1")]
    lines = spark.createDataFrame(rows, "name string, idx int, value string").repartition(7)
    text.write_bundle(lines, f"{tmp_path}/set", files=4)
    assert len(list((tmp_path / "set").glob("part-*"))) == 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # several blocks in a file
    try:
        assert text.text_lines(spark, f"{tmp_path}/set").select("block").distinct().count() > 8
        got = text.read_recordings(spark, f"{tmp_path}/set", bundled=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.file, r.idx, r.c0, r.c1) for r in got) == sorted((n, j, int(n[1:3]), j) for n, j, _ in rows if n[0] == "F")


def matrices(root, split, n, short=None):
    for s in text.SIGNALS:
        rows = ["  ".join(f"{i + k / 10:.7e}" for k in range(4)) for i in range(n - (s == short))]
        write(root / split / "Inertial Signals" / f"{s}{split}.txt", "\n".join(rows) + "\n")
    write(root / split / f"y_{split}.txt", "\n".join(str(i % 6 + 1) for i in range(n)))
    write(root / split / f"subject_{split}.txt", "\n".join(str(i % 30 + 1) for i in range(n)))


def test_window_set(spark, tmp_path):
    matrices(tmp_path, "train", 12)
    matrices(tmp_path, "test", 5)
    w = text.read_official(spark, str(tmp_path), length=4)
    rows = w.collect()
    assert len(rows) == 17 and len({r.win_id for r in rows}) == 17
    r = next(x for x in rows if x.win_id == "train:7")
    assert (r.split, r.y, r.domain, len(r.x)) == ("train", 1, 7, 6) and r.x[0] == pytest.approx([7.0, 7.1, 7.2, 7.3])
    matrices(tmp_path / "bad", "train", 6, short=text.SIGNALS[2])
    with pytest.raises(Exception, match="do not line up"):
        text.read_window_set(spark, str(tmp_path / "bad"), "train", length=4).collect()
    with pytest.raises(Exception, match="do not line up"):
        text.read_window_set(spark, str(tmp_path), "train", length=5).collect()


def test_annotations(spark, tmp_path):
    one = [{"t0": 1, "t1": 2.5}]
    write(tmp_path / "A.json", json.dumps({"fs": 200, "labels": {"transition": one, "no_transition": one, "ambiguous": []}}, indent=2))
    write(tmp_path / "B.json", json.dumps({"postural_transition": one, "stable_posture": one * 2}))
    write(tmp_path / "C.json", json.dumps({"labels": {"transitions": one}}))
    a = annotations.read_annotations(spark, str(tmp_path))
    got = {r.file: (len(r.transition), len(r.no_transition), len(r.ambiguous)) for r in a.collect()}
    assert got == {"A.txt": (1, 1, 0), "B.txt": (1, 2, 0), "C.txt": (1, 0, 0)}
    iv = annotations.intervals(a)
    assert iv.count() == 6 and iv.filter("t0 = 1.0 AND t1 = 2.5").count() == 6


def test_manifest_and_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val")], "a int, split string")
    path, calls = str(tmp_path / "d"), []

    def build():
        calls.append(1)
        return df

    config = {"root": "x\\y\\", "n": (1, 2)}
    for c in (config, {"root": "x/y", "n": [1, 2]}):
        assert store.load_or_build(spark, path, c, ("train", "val"), build).count() == 2
    assert len(calls) == 1
    store.load_or_build(spark, path, {**config, "n": [3]}, ("train", "val"), build)
    assert len(calls) == 2
    assert not store.is_current(spark, path, config, ("train",))
    versioned = {"config": config, "version": 3}
    store.save_splits(df, path, versioned)
    assert store.is_current(spark, path, versioned, ("train",), ("a",), ("version", "config"))
    assert not store.is_current(spark, path, {**versioned, "version": 4}, ("train",), ("a",), ("version", "config"))
    assert not store.is_current(spark, path, versioned, ("train",), ("b",), ("version", "config"))
    for n in ("sisa", "ucib"):
        write(tmp_path / "runs" / n / "config.json", json.dumps({"seed": 1, "k": [1, 2]}, indent=1))
        write(tmp_path / "runs" / n / "metrics" / "history.json", json.dumps([{"epoch": 1, "val": {"loss": 2.0}}, {"epoch": 2, "val": {"loss": 1.0}}]))
    write(tmp_path / "runs" / "empty" / "other.json", "{}")
    root = str(tmp_path / "runs")
    assert sorted(r.run_name for r in store.find_runs(spark, root).collect()) == ["sisa", "ucib"]
    assert [r.run_name for r in store.find_runs(spark, root, "UCI").collect()] == ["ucib"]
    h = store.run_files(spark, root, "metrics/history.json")
    assert sorted((r.run_name, r.epoch, r.val.loss) for r in h.collect()) == [("sisa", 1, 2.0), ("sisa", 2, 1.0), ("ucib", 1, 2.0), ("ucib", 2, 1.0)]
    assert store.config_id({"b": 1, "a": (1,)}) == store.config_id({"a": [1], "b": 1})


def test_bundled_annotations_read_like_single_files(spark, tmp_path):
    from undula.sources.annotations import intervals, read_annotations

    docs = {"a.json": {"fs": 50.0, "labels": {"transitions": [{"t0": 1.0, "t1": 2.0}]}}, "b.json": {"stable_posture": [{"t0": 0.5, "t1": 3.0}], "ambiguous": []}, "c.json": {}}
    (tmp_path / "one").mkdir()
    (tmp_path / "many").mkdir()
    for name, d in docs.items():
        (tmp_path / "one" / name).write_text(json.dumps(d, indent=1))
    (tmp_path / "many" / "part-0.txt").write_text("\n".join(json.dumps({"name": n, **d}) for n, d in docs.items()))
    one = read_annotations(spark, str(tmp_path / "one"))
    many = read_annotations(spark, str(tmp_path / "many"), "*", bundled=True)
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    assert {tuple(r) for r in intervals(many).collect()} == {("a.txt", "transition", 1.0, 2.0), ("b.txt", "no_transition", 0.5, 3.0)}
