"""Window features: base statistics, robust scaling per recording, neighbour context."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.operators import kernels as K
from undula.operators.quantiles import exact_quantiles
from undula.operators.sequence import framed
from undula.session import ship_package, stage

# Frequency bands in Hz, lower edge included.
BANDS = ((0.5, 3.0), (3.0, 8.0), (8.0, 20.0), (20.0, 50.0))
STATS = ("mean", "std", "rms", "range", "iqr")
# Order of the base features; tilt_step compares with the window before and is added after the kernel.
BASE = (
    ["gyr_energy", "jerk_energy", "tilt_travel", "tilt_step"]
    + [f"acc_{s}" for s in STATS]
    + [f"gyr_{s}" for s in STATS]
    + [f"{m}_band{i}" for m in ("acc", "gyr") for i in range(len(BANDS))]
)
EPS = 1e-8


def _magnitude_stats(m: np.ndarray) -> list[np.ndarray]:
    lo, hi = np.quantile(m, [0.25, 0.75], axis=1)
    return [m.mean(1), m.std(1), np.sqrt((m * m).mean(1)), m.max(1) - m.min(1), hi - lo]


def _band_power(m: np.ndarray, fs: float) -> list[np.ndarray]:
    hz = np.arange(m.shape[1] // 2 + 1) * fs / m.shape[1]
    power = np.abs(np.fft.rfft(m, axis=1)) ** 2
    inside = [(hz >= lo) & (hz < hi) for lo, hi in BANDS]
    return [power[:, s].mean(1) if s.any() else np.zeros(len(m)) for s in inside]


def window_features(df: DataFrame, fs: float = 200.0, tilt_every: int = 16, column: str = "x") -> DataFrame:
    """Base features of packed windows with 3 acc and 3 gyro channels.

    Replaces ``column`` by one double column per entry of ``BASE`` but ``tilt_step``, and ``gravity``
    (unit mean acceleration, needed for ``tilt_step``). Map-only: one pass over each batch.
    """
    keep = [c for c in df.columns if c != column]
    names = [b for b in BASE if b != "tilt_step"]
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [T.StructField(n, T.DoubleType()) for n in names]
        + [T.StructField("gravity", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in K.window_slices(batches, column, 8.0):
            x = x.astype(np.float64)
            acc, gyr = x[:, :3], x[:, 3:]
            a2, g2 = (acc * acc).sum(1), (gyr * gyr).sum(1)
            am, gm = np.sqrt(a2 + EPS), np.sqrt(g2 + EPS)
            jerk = np.diff(acc, axis=2) * fs
            unit = (acc / (np.sqrt(a2) + EPS)[:, None])[:, :, ::tilt_every]
            turn = np.arccos(np.clip((unit[:, :, 1:] * unit[:, :, :-1]).sum(1), -1, 1)).sum(1)
            mean = acc.mean(2)
            gravity = mean / (np.sqrt((mean * mean).sum(1)) + EPS)[:, None]
            cols = [g2.mean(1), (jerk * jerk).sum(1).mean(1), turn]
            cols += _magnitude_stats(am) + _magnitude_stats(gm) + _band_power(am, fs) + _band_power(gm, fs)
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in keep] + [pa.array(c) for c in cols] + [K.list_column(gravity)],
                names=schema.names,
            )

    ship_package(df.sparkSession)
    return df.select(*keep, column).mapInArrow(run, schema)


def tilt_step(features: DataFrame, keys: Sequence[str], number: str = "k") -> DataFrame:
    """Angle between the mean acceleration of a window and the one before it; 0 for the first."""
    g = F.col("gravity")

    def angle(w) -> Column:
        dot = F.aggregate(F.zip_with(g, F.lag(g).over(w), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))), F.lit(0.0))

    return framed(features, keys, number, {"tilt_step": angle}, before=1)


def _numbered(values: Column) -> Column:
    return F.posexplode(values).alias("feature", "value")


def robust_scale(df: DataFrame, keys: Sequence[str], column: str = "f") -> DataFrame:
    """(f - median) / (1.4826 * (MAD + 1e-6)) per recording and entry of the array ``column``.

    The two tables of one row per recording are written once, since both are read several times.
    """
    keys = list(keys)

    def per_recording(long: DataFrame, name: str) -> DataFrame:
        q = exact_quantiles(long, [*keys, "feature"], "value", {"q": 0.5})
        lined = F.sort_array(F.collect_list(F.struct("feature", "q")))  # one entry per feature
        return q.groupBy(*keys).agg(lined.alias("__l")).select(*keys, F.col("__l.q").alias(name))

    med = stage(per_recording(df.select(*keys, _numbered(F.col(column))), "__med"), "medians")
    centred = df.join(med, keys).withColumn("__d", F.zip_with(column, "__med", lambda a, m: a - m))
    gaps = centred.select(*keys, _numbered(F.transform("__d", F.abs)))
    mad = stage(per_recording(gaps, "__mad"), "deviations")
    return (
        centred.join(mad, keys)
        .withColumn(column, F.zip_with("__d", "__mad", lambda d, m: d / (1.4826 * (m + 1e-6))))
        .drop("__med", "__mad", "__d")
    )


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def neighbour_context(df: DataFrame, keys: Sequence[str], number: str = "k", column: str = "f") -> DataFrame:
    """Feature vector with its change from the window before and to the window after.

    Result: f, f - prev, next - f, two L1-normalised dot products, two L2 norms of the changes.
    The first and last window of a recording are dropped.
    """
    f = F.col(column)
    w = framed(
        df, keys, number, {"__p": lambda s: F.lag(f).over(s), "__n": lambda s: F.lead(f).over(s)}, before=1, after=1
    ).filter("__p IS NOT NULL AND __n IS NOT NULL")
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    l1 = lambda a: _sum(F.transform(a, F.abs)) + 1e-6
    dot = lambda a, b: _sum(F.zip_with(a, b, lambda x, y: x * y)) / (l1(a) * l1(b))
    l2 = lambda a: F.sqrt(_sum(F.transform(a, lambda x: x * x)) + 1e-6)
    p, n = F.col("__p"), F.col("__n")
    full = w.withColumn("__dp", minus(f, p)).withColumn("__dn", minus(n, f))
    extra = F.array(dot(f, p), dot(f, n), l2(F.col("__dp")), l2(F.col("__dn")))
    clean = lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    return full.withColumn(column, F.transform(F.concat(f, "__dp", "__dn", extra), clean)).drop("__p", "__n", "__dp", "__dn")


def column_moments(df: DataFrame, column: str = "f") -> DataFrame:
    """Mean and population standard deviation per entry of the array ``column``."""
    return (
        df.select(_numbered(F.col(column)))
        .groupBy("feature")
        .agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    )


def standardise(df: DataFrame, mu: Sequence[float], sd: Sequence[float], column: str = "f", name: str = "z") -> DataFrame:
    """(f - mu) / (sd + 1e-6), with NaN and infinities set to 0."""
    ms = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s) + 1e-6).alias("s")) for m, s in zip(mu, sd)])
    z = F.zip_with(column, ms, lambda v, p: (v - p.m) / p.s)
    return df.withColumn(name, F.transform(z, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)))
