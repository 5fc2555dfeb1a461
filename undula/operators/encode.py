"""Event encoders over packed windows.

The recurrences depend on their own past decisions, so they run in an Arrow kernel that steps over
time once for all windows and channels of a batch. Windows are independent rows: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.operators import kernels as K
from undula.session import ship_package

EVENT = T.StructType(
    [
        T.StructField("channel", T.IntegerType()),
        T.StructField("t", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
    ]
)
FLOATS = T.ArrayType(T.FloatType())


def default_step(samples: DataFrame, keys: Sequence[str], channels: Sequence[str], k: float = 0.1, eps: float = 1e-6) -> DataFrame:
    """Step per key and channel: max(eps, k * population standard deviation)."""
    return samples.groupBy(*keys).agg(
        *[F.greatest(F.lit(eps), F.lit(k) * F.stddev_pop(F.col(c).cast("double"))).cast("float").alias(c) for c in channels]
    )


def _per_channel(v, c: int, name: str) -> np.ndarray:
    a = np.asarray(v, np.float32)
    if a.ndim == 0:
        return np.full(c, a, np.float32)
    if a.shape != (c,):
        raise ValueError(f"{name} must be a scalar or one value per channel")
    return a


def dead_zones(dead_zone, theta: np.ndarray) -> np.ndarray:
    """None -> 0; a scalar scales the step; a vector is absolute."""
    if dead_zone is None:
        return np.zeros_like(theta)
    a = np.asarray(dead_zone, np.float32)
    return a * theta if a.ndim == 0 else _per_channel(a, theta.size, "dead_zone")


def _event_lists(ev: np.ndarray) -> pa.Array:
    """(rows, channels, samples) signed counts -> array<struct<channel, t, n>> of the non-zero ones."""
    r, c, t = np.nonzero(ev)
    ends = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=ev.shape[0]))))
    cols = [pa.array(a.astype(np.int32)) for a in (c, t, ev[r, c, t])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, names=EVENT.names))


def encode_windows(
    df: DataFrame,
    theta,
    dead_zone=0.5,
    init: str = "x0",
    kind: str = "sigma_delta",
    cap: int | None = 15,
    resample: tuple[int, int, str] | None = None,
    trace: bool = False,
    column: str = "x",
) -> DataFrame:
    """Encode every window of ``column`` (array<array<float>>); the other columns are kept.

    Adds ``events`` (signed count per channel and time: up > 0, down < 0), ``n_up``, ``n_down``,
    ``n_events`` (non-zero entries), ``offset`` (first raw sample per channel), ``state`` (last
    reconstruction per channel) and, with ``trace``, the reconstruction ``recon``. ``resample`` =
    (in_len, out_len, method) resamples in the same pass. ``kind`` is ``sigma_delta`` or
    ``level_crossing`` (``theta`` is then the level step and ``cap`` bounds steps per sample).
    """
    if init not in ("x0", "zero"):
        raise ValueError("init must be x0 or zero")
    if kind not in ("sigma_delta", "level_crossing"):
        raise ValueError("kind must be sigma_delta or level_crossing")
    if (np.asarray(theta, np.float32) <= 0).any():
        raise ValueError("steps must be positive")
    if cap is not None and cap < 0:
        raise ValueError("cap must not be negative")
    if dead_zone is not None and (np.asarray(dead_zone, np.float32) < 0).any():
        raise ValueError("dead_zone must not be negative")
    keep = [c for c in df.columns if c != column]
    fields = [df.schema[c] for c in keep] + [
        T.StructField("events", T.ArrayType(EVENT)),
        T.StructField("n_up", T.LongType()),
        T.StructField("n_down", T.LongType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("offset", FLOATS),
        T.StructField("state", FLOATS),
    ]
    if trace:
        fields.append(T.StructField("recon", T.ArrayType(FLOATS)))
    schema = T.StructType(fields)
    grow = (resample[1] / resample[0] if resample else 1.0) * (3.0 if trace else 2.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = K.make_resampler(*resample) if resample else None
        for part, raw in K.window_slices(batches, column, grow):
            x = f(raw) if f else raw
            step = _per_channel(theta, x.shape[1], "theta")
            start = x[..., 0] if init == "x0" else np.zeros(x.shape[:2], np.float32)
            if kind == "sigma_delta":
                ev, state, tr = K.delta_events(x, step, dead_zones(dead_zone, step), start, trace)
            else:
                ev, state, tr = K.crossing_counts(x, step, cap, start, trace)
            cols = [
                _event_lists(ev),
                pa.array(np.maximum(ev, 0).sum((1, 2), dtype=np.int64)),
                pa.array(np.maximum(-ev.astype(np.int32), 0).sum((1, 2), dtype=np.int64)),
                pa.array(np.count_nonzero(ev, axis=(1, 2)).astype(np.int64)),
                K.list_column(raw[..., 0].astype(np.float32)),
                K.list_column(state.astype(np.float32)),
            ]
            if trace:
                cols.append(K.numpy_to_packed(tr))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + cols, names=schema.names)

    ship_package(df.sparkSession)
    return df.select(*keep, column).mapInArrow(run, schema)


def event_table(encoded: DataFrame, *keys: str) -> DataFrame:
    """Long event table: keys, channel, t, n (signed)."""
    return encoded.select(*keys, F.explode("events").alias("__e")).select(*keys, "__e.channel", "__e.t", "__e.n")


def leaky_accumulate(
    df: DataFrame, tau: float, threshold: float, soft_reset: bool = True, column: str = "x"
) -> DataFrame:
    """Run the leaky accumulator over each packed row; adds ``spikes`` (list per channel) and ``rate``."""
    keep = [c for c in df.columns if c != column]
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [
            T.StructField("spikes", T.ArrayType(T.ArrayType(T.ByteType()))),
            T.StructField("membrane", FLOATS),
            T.StructField("rate", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in K.window_slices(batches, column, 2.0):
            s, m = K.leaky_spikes(x, tau, threshold, soft_reset, np.float32(0))
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in keep]
                + [K.numpy_to_packed(s), K.list_column(m), K.list_column(s.mean(axis=2))],
                names=schema.names,
            )

    ship_package(df.sparkSession)
    return df.select(*keep, column).mapInArrow(run, schema)


def signed_current(up: Column, down: Column) -> Column:
    """Merge polarities of one channel: up - down, entry by entry."""
    return F.zip_with(up, down, lambda a, b: a - b)


def polarity_channels(up: Column, down: Column) -> Column:
    """Keep polarities as separate channels: all up channels, then all down channels."""
    return F.concat(up, down)
