import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import encode, resample, segment

STRIDES = {0: 3, 1: 5, 2: 4}


@pytest.fixture(scope="module")
def recs(spark):
    rng = np.random.default_rng(3)
    data = {k: rng.integers(-9, 10, size=(n, 2)) for k, n in enumerate([3, 8, 9, 50, 41, 8, 30, 200])}
    data[3][:] = 4  # all samples tie
    data[6][:] = 0
    data[6][29, 0] = -7  # peak behind the last window of stride 3
    rows = [(k, k % 3, i, float(a), float(b)) for k, x in data.items() for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "rec int, y int, idx bigint, a double, b double").repartition(5).cache()
    return data, df


def stride():
    return segment.class_stride(F.col("y"), STRIDES)


def starts_of(n, y, win=8):
    return list(range(0, n - win + 1, STRIDES[y])) if n >= win else []


def got(df):
    return sorted((r.rec, r.start) for r in df.select("rec", "start").collect())


def test_regular_starts_and_counts(recs):
    data, df = recs
    rec = segment.recording_lengths(df, ["rec"], "y")
    want = sorted((k, s) for k, x in data.items() for s in starts_of(len(x), k % 3))
    assert got(segment.window_starts(rec, ["rec"], 8, stride())) == want
    n = rec.agg(F.sum(segment.window_count(F.col("n"), 8, stride()))).first()[0]
    assert n == len(want)
    assert segment.window_starts(rec, ["rec"], 8, segment.class_stride(F.col("y") + 5, STRIDES)).isEmpty()
    with pytest.raises(ValueError):
        segment.class_stride(F.col("y"), {0: 0})


def test_global_peak_keeps_all_ties(recs):
    data, df = recs
    rec = segment.recording_lengths(df, ["rec"], "y")
    want = []
    for k, x in data.items():
        top = np.abs(x).max()
        peaks = np.unique(np.where(np.abs(x) == top)[0])
        want += [(k, s) for s in starts_of(len(x), k % 3) if any(s <= p < s + 8 for p in peaks)]
    found = got(segment.global_peak_starts(df, rec, ["rec"], ["a", "b"], 8, stride()))
    assert found == sorted(want)
    assert not [s for r, s in found if r == 6]  # its only peak lies behind the last window


def test_first_peak_with_centred_fallback(recs):
    data, df = recs
    rec = segment.recording_lengths(df, ["rec"], "y")
    want = []
    for k, x in data.items():
        if len(x) < 8:
            continue
        p = int(np.argmax(np.abs(x).max(axis=1)))
        cover = [s for s in starts_of(len(x), k % 3) if s <= p < s + 8]
        want += [(k, s) for s in cover or [int(np.clip(p - 4, 0, len(x) - 8))]]
    assert got(segment.first_peak_starts(df, rec, ["rec"], ["a", "b"], 8, stride())) == sorted(want)


def test_materialise_any_start(recs, spark):
    data, df = recs
    wanted = [(7, s) for s in (0, 1, 13, 14, 27, 100, 192, 193, 500)] + [(0, 0), (1, 0), (4, 33)]
    st = spark.createDataFrame([(r, s, f"t{s}") for r, s in wanted], "rec int, start bigint, tag string")
    out = segment.materialise(df, st, ["rec"], ["a", "b"], 8, chunk_windows=2).collect()
    assert sorted((r.rec, r.start) for r in out) == [(r, s) for r, s in sorted(wanted) if s + 8 <= len(data[r])]
    for r in out:
        assert np.array_equal(np.array(r.x).T, data[r.rec][r.start : r.start + 8]) and r.tag == f"t{r.start}"


@pytest.mark.parametrize("chunk", [1, 2, 16])
def test_regular_windows(recs, chunk):
    data, df = recs
    out = segment.regular_windows(df, ["rec"], ["a", "b"], 8, stride(), ["y"], chunk).collect()
    want = sorted((k, s) for k, x in data.items() for s in starts_of(len(x), k % 3))
    assert sorted((r.rec, r.start) for r in out) == want
    for r in out:
        assert r.y == r.rec % 3 and np.array_equal(np.array(r.x).T, data[r.rec][r.start : r.start + 8])


def test_pad_edges(recs):
    data, df = recs
    df = df.filter("rec >= 3")
    rec = segment.recording_lengths(df, ["rec"])
    p = segment.pad_edges(df, rec, ["rec"], 5, 2)
    for k in (3, 4, 6, 7):
        x = data[k]
        want = np.concatenate([np.tile(x[:5], (2, 1)), x, np.tile(x[-5:], (2, 1))])
        rows = sorted((r.idx, r.a, r.b) for r in p.filter(F.col("rec") == k).collect())
        assert [r[0] for r in rows] == list(range(len(want)))
        assert np.array_equal(np.array(rows)[:, 1:], want)


def test_encoder_arguments_and_variants(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.5, 1.0, 3.0], [1.0, 1.0, 1.0, 1.0]])], "id int, x array<array<float>>")
    for bad in ({"theta": -1.0}, {"theta": 1.0, "dead_zone": -0.1}, {"theta": 1.0, "init": "mean"}, {"theta": 1.0, "cap": -1}, {"theta": 1.0, "kind": "other"}):
        with pytest.raises(ValueError):
            encode.encode_windows(df, **bad)
    r = encode.encode_windows(df, 1.0, None, "zero", trace=True).first()
    assert [list(c) for c in r.recon] == [[0, 1, 1, 2], [1, 1, 1, 1]]
    assert r.offset == [0, 1] and r.state == [2, 1] and (r.n_up, r.n_down, r.n_events) == (3, 0, 3)
    v = encode.encode_windows(df, 1.0, [0.4, 5.0]).first()
    assert [(e.channel, e.t, e.n) for e in v.events] == [(0, 1, 1), (0, 3, 1)]
    sums = {c: sum(e.n for e in v.events if e.channel == c) for c in (0, 1)}
    assert all(np.isclose(v.state[c] - v.offset[c], sums[c]) for c in (0, 1))


def test_resample_arguments_and_times(spark):
    df = spark.createDataFrame([(1, [[0.0, 1.0]])], "id int, x array<array<float>>")
    with pytest.raises(ValueError):
        resample.resample_windows(df, 2, 4, "spline")
    with pytest.raises(ValueError):
        resample.resample_windows(df, 1, 4)
    src = [(1, 0.0, 5.0, 0), (1, 2.0, 7.0, 1), (1, 2.0, 9.0, 2), (1, 6.0, 1.0, 3), (2, 1.0, 4.0, 0)]
    s = spark.createDataFrame(src, "k int, t double, v double, i int")
    at = [-1.0, 0.0, 1.0, 2.0, 3.0, 6.0, 9.0]
    d = spark.createDataFrame([(1, t) for t in at], "k int, t double")
    for method in ("linear", "zoh"):
        got = [r.v for r in resample.at_times(s, d, ["k"], "t", "v", "i", 1.5, method).orderBy("t").collect()]
        xs, ys = np.array([0.0, 2.0, 2.0, 6.0]), np.array([5.0, 7.0, 9.0, 1.0])
        if method == "linear":
            want = [5.0, 5.0, 6.0, 9.0, 7.0, 1.0, 1.0]
        else:
            want = ys[np.clip(np.searchsorted(xs, at, side="right") - 1, 0, 3)].tolist()
        assert got == want


@pytest.mark.parametrize("chunk", [1, 3, 16])
@pytest.mark.parametrize("hop,pad_rep", [(4, 2), (3, 1), (5, 5)])
def test_padded_windows_are_those_of_padded_samples(spark, recs, chunk, hop, pad_rep):
    _, df = recs
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # chunks go on in later batches
    try:
        rec = segment.long_enough(segment.recording_lengths(df, ["rec"], "y"), 8)
        want = segment.regular_windows(segment.pad_edges(df, rec, ["rec"], 5, pad_rep), ["rec"], ["a", "b"], 8, F.lit(hop), ["y"], chunk)
        got = segment.padded_windows(df, rec, ["rec"], ["a", "b"], 8, hop, 5, pad_rep, ["y"], chunk)
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


@pytest.mark.parametrize("chunk", [1, 16])
def test_padded_windows_of_positions_that_miss_or_repeat(spark, chunk):
    rows = [(k, i + k, None if i % 7 == 3 else float(i * k % 5), float(i)) for k in range(4) for i in range(40) if i % 11 != 4 or k < 2]
    rows += [(3, 20, 1.5, None), (3, 20, None, 2.5)]
    df = spark.createDataFrame(rows, "rec int, idx bigint, a float, b float").repartition(3).cache()
    rec = segment.recording_lengths(df, ["rec"])
    want = segment.regular_windows(segment.pad_edges(df, rec, ["rec"], 5, 2), ["rec"], ["a", "b"], 8, F.lit(3), chunk_windows=chunk)
    got = segment.padded_windows(df, rec, ["rec"], ["a", "b"], 8, 3, 5, 2, chunk_windows=chunk)
    plain = lambda d: sorted((r.rec, r.start, str([[float("nan") if v is None else v for v in c] for c in r.x])) for r in d.collect())
    assert plain(got) == plain(want)
