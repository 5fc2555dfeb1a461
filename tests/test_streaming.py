"""Keyed streams: hot keys in bounded pieces, late rows, idle keys, restarts."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from undula.operators import kernels as K
from undula.streaming import stateful

SCHEMA = "k string, seq long, value double"


class Stream:
    """A folder that grows by triggers; each is a restart from the checkpoint."""

    def __init__(self, spark, folder, build):
        self.spark, self.folder, self.build = spark, folder, build

    def trigger(self, rows, files=1):
        df = self.spark.createDataFrame(rows, SCHEMA).repartition(files)
        df.write.mode("append").parquet(f"{self.folder}/in")
        source = self.spark.readStream.schema(df.schema).parquet(f"{self.folder}/in")
        q = self.build(source).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state")
        q = q.outputMode("append").trigger(availableNow=True).start()
        done = q.awaitTermination(90)
        q.stop()
        assert done

    def rows(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.folder}/out").collect()), key=str)


def events(values, start):
    x = np.array(values, np.float32)
    ev, after, _ = K.delta_events(x[None], np.float32(0.3), np.float32(0.15), x[:1] if start is None else np.array([start]))
    return ev[0].tolist(), after[0]


@pytest.fixture
def encoder():
    return lambda s: stateful.sigma_delta_stream(s, ["k"], "seq", 0.3, 0.5, piece=500)


def test_a_hot_key_is_taken_in_pieces(spark, tmp_path, encoder):
    rng = np.random.default_rng(0)
    hot = np.cumsum(rng.normal(size=20_000)).astype(np.float32)
    rows = [("hot", i, float(v)) for i, v in enumerate(hot)] + [("cold", 3 * i, float(i)) for i in range(40)] + [("cold", None, 1.0), ("cold", 7, None)]
    order = rng.permutation(len(rows))
    s = Stream(spark, tmp_path, encoder)
    cut = [rows[i] for i in order if rows[i][0] == "cold" or rows[i][1] < 12_000], [rows[i] for i in order if rows[i][0] == "hot" and rows[i][1] >= 12_000]
    for part in cut:
        s.trigger(part, files=4)
    want = [("hot", i, e) for i, e in enumerate(events(hot, None)[0])] + [("cold", 3 * i, e) for i, e in enumerate(events(range(40), None)[0])]
    assert s.rows() == sorted(want, key=str)


def test_late_rows_have_no_result_and_change_nothing(spark, tmp_path, encoder):
    s = Stream(spark, tmp_path, encoder)
    s.trigger([("a", i, i * 0.2) for i in range(10, 20)])
    s.trigger([("a", 5, 100.0), ("a", 19, -100.0), ("a", 20, 4.0), ("a", 22, 4.4), ("a", 21, 4.2)])
    first, carry = events([i * 0.2 for i in range(10, 20)], None)
    then, _ = events([4.0, 4.2, 4.4], carry)
    want = [("a", i, e) for i, e in zip(range(10, 20), first, strict=True)] + [("a", i, e) for i, e in zip(range(20, 23), then, strict=True)]
    assert s.rows() == sorted([*want, ("a", 5, None), ("a", 19, None)], key=str)


def test_an_idle_key_starts_anew(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    s = Stream(spark, tmp_path, lambda d: stateful.hysteresis_stream(d, ["k"], "seq", 60.0, 40.0, idle="1 second"))
    s.trigger([("a", 5, 70.0), ("b", 5, 70.0)])
    time.sleep(1.5)
    s.trigger([("b", 6, 50.0)])  # the state of a goes, b stays on
    s.trigger([("a", 1, 50.0), ("b", 7, 50.0)])  # neither late nor on
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert s.rows() == [("a", 1, 0), ("a", 5, 1), ("b", 5, 1), ("b", 6, 1), ("b", 7, 1)]


def test_intervals():
    assert stateful.milliseconds("5 minutes") == 300_000 and stateful.milliseconds("1 hour") == 3_600_000
    for bad in ("soon", "5", "-1 second"):
        with pytest.raises(ValueError, match="interval"):
            stateful.milliseconds(bad)
    with pytest.raises(ValueError, match="above"):
        stateful.hysteresis_stream(None, ["k"], "seq", 1.0, 1.0)


class Values:
    def __init__(self):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v

    def update(self, v):
        self.v = v


class Maps(dict):
    peak = 0

    def updateValue(self, k, v):
        self[k] = v
        self.peak = max(self.peak, len(self))

    def getValue(self, k):
        return self[k]

    def removeKey(self, k):
        del self[k]


def test_no_more_than_a_piece_is_held_at_once():
    sizes = []

    def step(x, before):
        sizes.append(len(x))
        return np.cumsum(x).astype(np.int32) + int(before or 0), float(np.cumsum(x)[-1] + (before or 0))

    e = stateful._Encoder(step, ["k"], "seq", "n", None, 100)
    values, maps = Values(), Maps()
    handle = type("Handle", (), {"getValueState": lambda *a: values, "getMapState": lambda *a: maps})()
    e.init(handle)
    rng = np.random.default_rng(2)
    seq = rng.permutation(5000)
    pieces = (pd.DataFrame({"seq": seq[i : i + 64], "value": np.ones(len(seq[i : i + 64]), np.float32)}) for i in range(0, 5000, 64))
    out = pd.concat(list(e.handleInputRows(("a",), pieces, None)))
    assert out["seq"].tolist() == list(range(5000)) and out["n"].tolist() == list(range(1, 5001))
    assert max(sizes) == 100 and not maps and maps.peak > 50 and values.v == (5000.0, 4999)


def test_counts_per_window_close_with_a_last_row(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "a")], "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k")
    last = stateful.closing_row(df, "ts", "2 hours").collect()
    assert len(last) == 1 and last[0].k is None and last[0].ts.hour == 2


@pytest.mark.parametrize("start", [None, (1.0, 9)])
def test_a_key_reads_and_writes_its_state_once(start):
    import numpy as np
    import pandas as pd

    calls = []

    class State:
        def get(self):
            calls.append("get")
            return start

        def exists(self):
            calls.append("exists")
            return start is not None

        def update(self, value):
            calls.append(value)

    held = stateful._Encoder(lambda x, before: (x.astype(np.int32), -1.0 if before is None else before), ["rec"], "seq", "out", None, 4)
    held.carry = State()
    out = list(held.handleInputRows((7,), iter([pd.DataFrame({"seq": [11, 10], "value": [3.0, 2.0]})]), None))
    assert calls == ["get", (-1.0 if start is None else 1.0, 11)]
    assert out[0].to_dict("list") == {"rec": [7, 7], "seq": [10, 11], "out": [2, 3]}
