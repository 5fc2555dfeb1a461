"""Streaming versions of the stateful encoders.

Samples arrive as (key columns, seq, value). State per key is the running reconstruction (or level, or membrane, or
on/off flag) and the last ``seq`` that it holds. The functions need the RocksDB state store (``use_rocksdb``).

- **Order and memory.** Within a trigger a key's rows are taken by ``seq`` (equal ones by value), however they
  arrive. A key whose rows fit one piece is sorted at once. More of them are first put into the state store by
  ranges of PIECE ``seq`` and then taken range by range, so a task holds one range of one key, not the key.
- **Late rows.** A row whose ``seq`` is not above the one carried from earlier triggers is late: its result is null,
  and it leaves the state as it is.
- **Idle keys.** With ``idle`` (an interval such as "30 minutes"), the state of a key without rows for that long in
  processing time is dropped by the next trigger that brings none for it, and a later row starts the key anew.
  Spark plans triggers without data for such timers, without end under ``availableNow``: set
  ``spark.sql.streaming.noDataMicroBatches.enabled`` to false there.
- **Nulls.** Rows without ``seq`` or value are left out; a null key is a key.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from undula.operators import kernels as K
from undula.session import ship_package

PIECE = 4096
_MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
Step = Callable[[np.ndarray, "np.float32 | None"], tuple[np.ndarray, float]]


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that keyed state with several columns and timers needs; queries started later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def milliseconds(interval: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*(millisecond|second|minute|hour|day)s?\s*", interval)
    if not m:
        raise ValueError("an interval is a number of milliseconds, seconds, minutes, hours or days")
    return int(m[1]) * _MS[m[2]]


class _Encoder(StatefulProcessor):
    """Runs ``step(values, carry or None) -> (results, carry)`` over the rows of a key in order."""

    def __init__(self, step: Step, keys: list[str], seq: str, out: str, idle: int | None, piece: int):
        self.step, self.keys, self.seq, self.out, self.idle, self.piece = step, keys, seq, out, idle, piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", "carry float, last bigint")
        self.parked = handle.getMapState("parked", "part bigint, number int", "seq binary, value binary")

    def _results(self, key: tuple, seq: np.ndarray, value: np.ndarray, floor: int | None, before: float | None) -> tuple[pd.DataFrame, float | None]:
        """One stretch in order, and the carry after it. ``floor``: the last seq of earlier triggers; rows up to it are late."""
        order = np.lexsort((value, seq))
        seq, value = seq[order], value[order]
        late = np.zeros(len(seq), bool) if floor is None else seq <= floor
        result = np.zeros(len(seq), np.int32)
        if not late.all():
            got, before = self.step(value[~late], None if before is None else np.float32(before))
            result[~late] = got
            self.carry.update((float(before), int(seq[-1])))
        if late.any():
            result = pd.arrays.IntegerArray(result, late)
        return pd.DataFrame({**{k: [key[i]] * len(seq) for i, k in enumerate(self.keys)}, self.seq: seq, self.out: result}, copy=False), before

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, floor = self.carry.get() or (None, None)  # one call: each goes to the JVM and back
        columns = lambda p: (p[self.seq].to_numpy(np.int64), p["value"].to_numpy(np.float32))
        first = next(rows, None)
        second = next(rows, None)
        if first is not None and second is None and len(first) <= self.piece:
            yield self._results(key, *columns(first), floor, before)[0]
        elif first is not None:
            parts: dict[int, int] = defaultdict(int)
            for piece in (p for some in ([first], [] if second is None else [second], rows) for p in some):
                seq, value = columns(piece)
                part = seq // self.piece
                order = np.argsort(part, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    k = int(part[at[0]])
                    self.parked.updateValue((k, parts[k]), (seq[at].tobytes(), value[at].tobytes()))
                    parts[k] += 1
            for k in sorted(parts):
                held = [self.parked.getValue((k, i)) for i in range(parts[k])]
                for i in range(parts[k]):
                    self.parked.removeKey((k, i))
                seq = np.frombuffer(b"".join(bytes(h[0]) for h in held), np.int64)
                value = np.frombuffer(b"".join(bytes(h[1]) for h in held), np.float32)
                out, before = self._results(key, seq, value, floor, before)
                yield out
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.carry.clear()
        return iter([])

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, keys: Sequence[str], seq: str, step: Step, out: str, idle: str | None, piece: int) -> DataFrame:
    names = list(keys)
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names)
    ship_package(df.sparkSession)
    use_rocksdb(df.sparkSession)
    rows = df.select(*names, F.col(seq).cast("bigint").alias(seq), F.col("value").cast("float").alias("value"))
    rows = rows.filter(F.col(seq).isNotNull() & F.col("value").isNotNull())
    encoder = _Encoder(step, names, seq, out, None if idle is None else milliseconds(idle), piece)
    return rows.groupBy(*names).transformWithStateInPandas(encoder, f"{head}, `{seq}` bigint, `{out}` int", "Append", "None" if idle is None else "ProcessingTime")


def sigma_delta_stream(
    df: DataFrame, keys: Sequence[str], seq: str, theta: float, dead_zone: float | None = 0.5, idle: str | None = None, piece: int = PIECE
) -> DataFrame:
    """Signed event per sample; the first sample of a key sets the reconstruction."""
    th = np.float32(theta)
    dead = np.float32(0 if dead_zone is None else dead_zone) * th

    def step(x, before):
        ev, after, _ = K.delta_events(x[None], th, dead, x[:1] if before is None else np.array([before]))
        return ev[0].astype(np.int32), after[0]

    return _keyed(df, keys, seq, step, "event", idle, piece)


def level_crossing_stream(
    df: DataFrame, keys: Sequence[str], seq: str, delta: float, cap: int | None = 15, idle: str | None = None, piece: int = PIECE
) -> DataFrame:
    """Steps up (positive) or down (negative) per sample; the first sample of a key sets the level."""

    def step(x, before):
        net, after, _ = K.crossing_counts(x[None], np.float32(delta), cap, x[:1] if before is None else np.array([before]))
        return net[0], after[0]

    return _keyed(df, keys, seq, step, "event", idle, piece)


def leaky_stream(
    df: DataFrame, keys: Sequence[str], seq: str, tau: float, threshold: float, soft_reset: bool = True, idle: str | None = None, piece: int = PIECE
) -> DataFrame:
    """1 for samples at which the leaky accumulator passes the threshold, else 0."""

    def step(x, before):
        s, after = K.leaky_spikes(x[None], tau, threshold, soft_reset, np.array([before or 0.0], np.float32))
        return s[0].astype(np.int32), after[0]

    return _keyed(df, keys, seq, step, "spike", idle, piece)


def hysteresis_stream(
    df: DataFrame, keys: Sequence[str], seq: str, on: float, off: float, idle: str | None = None, piece: int = PIECE
) -> DataFrame:
    """On/off state per sample; a key begins off."""
    if on <= off:
        raise ValueError("on must be above off")

    def step(x, before):
        up = x >= np.float32(on)
        last = np.maximum.accumulate(np.where(up | (x <= np.float32(off)), np.arange(len(x)), -1))  # the last turn so far
        state = np.where(last < 0, np.int32(before or 0.0), up[last]).astype(np.int32)
        return state, state[-1]

    return _keyed(df, keys, seq, step, "state", idle, piece)


def closing_row(df: DataFrame, ts: str, wait: str) -> DataFrame:
    """One row ``wait`` after the last one, all else null: at the end of a bounded run it moves the watermark
    past all windows that hold rows, so these are emitted. ``wait`` is the window's length plus the lateness
    allowed; the row's own windows stay open and never appear."""
    last = df.agg(F.max(F.col(ts)).alias(ts)).withColumn(ts, F.col(ts) + F.expr(f"INTERVAL {wait}"))
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != ts]
    return last.select(ts, *others).select(*df.columns)


def windowed_counts(
    df: DataFrame, ts: str, by: Sequence[str], length: str, slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Event-time counts per tumbling or sliding window; rows later than the watermark are left out.

    Zone-less timestamps are cast first, because watermarks do not accept them.
    """
    t = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    win = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        t.groupBy(win.alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
    )
