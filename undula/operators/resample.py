"""Resampling of packed windows and of long tables at arbitrary times."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.operators import kernels as K
from undula.operators.sequence import Run, explode_range, prefixes
from undula.operators.spline import segment_value, spline_segments
from undula.session import ship_package, stage

METHODS = ("linear", "zoh", "cubic")


def output_length(in_len: Column, factor: float, min_len: int = 2) -> Column:
    """max(in_len * factor rounded half to even, min_len)."""
    if factor <= 0:
        raise ValueError("factor must be positive")
    return F.greatest(F.bround(in_len.cast("double") * factor, 0).cast("bigint"), F.lit(min_len).cast("bigint"))


def resample_windows(df: DataFrame, in_len: int, out_len: int, method: str = "linear", column: str = "x") -> DataFrame:
    """Replace ``column`` (array<array<float>>, ``in_len`` samples) by its ``out_len``-sample version."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if in_len < 2 or out_len < 1:
        raise ValueError("in_len must be >= 2 and out_len >= 1")
    keep = [c for c in df.columns if c != column]
    fields = [df.schema[c] for c in keep] + [T.StructField(column, T.ArrayType(T.ArrayType(T.FloatType())))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = K.make_resampler(in_len, out_len, method)
        for part, x in K.window_slices(batches, column, out_len / in_len):
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in keep] + [K.numpy_to_packed(f(x))], names=[*keep, column]
            )

    ship_package(df.sparkSession)
    return df.select(*keep, column).mapInArrow(run, T.StructType(fields))


def at_times(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    t: str,
    value: str,
    seq: str,
    width: float,
    method: str = "linear",
) -> DataFrame:
    """Value of ``source`` at the times of ``target``; ``target``'s columns plus ``value``.

    ``linear`` interpolates between the neighbours and holds the ends; ``zoh`` takes the last sample
    at or before t and the first sample for earlier times. Ties are ordered by ``seq``. ``cubic`` follows the
    spline through a key's samples, also outside them (straight lines under four samples), and needs times
    that differ. Times are cut into spans of ``width``, so one key's timeline is spread over many tasks.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    point = F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v"))
    if method == "cubic":
        # written once: the lookup reads it twice, and it must not be solved twice
        source, point = stage(spline_segments(source, keys, t, value, seq, width), "spline"), F.col("segment")
    src = source.select(*keys, F.col(t), F.lit(0).alias("__kind"), F.col(seq).cast("bigint").alias("__seq"), point.alias("__pt"))
    extra = [c for c in target.columns if c not in {*keys, t}]
    dst = target.select(
        *keys, F.col(t), F.lit(1).alias("__kind"), F.lit(0).cast("bigint").alias("__seq"),
        F.lit(None).cast(src.schema["__pt"].dataType).alias("__pt"), *extra,
    )
    line = src.unionByName(dst, allowMissingColumns=True)
    order = [t, "__kind", "__seq"]
    runs = {
        "__a": Run("last", F.col("__pt"), inclusive=False),
        "__b": Run("last", F.col("__pt"), inclusive=False, descending=True),
    }
    line = prefixes(line, keys, order, F.floor(F.col(t) / width), runs)
    if method == "cubic":
        at = segment_value(F.coalesce("__a", "__b"), F.col(t).cast("double"))
        return line.filter("__kind = 1").select(*keys, t, *extra, at.alias(value))
    held = F.coalesce(F.col("__a.v"), F.col("__b.v"))
    if method == "linear":
        slope = (F.col("__b.v") - F.col("__a.v")) / (F.col("__b.t") - F.col("__a.t"))
        held = F.coalesce(slope * (F.col(t) - F.col("__a.t")) + F.col("__a.v"), held)
    return line.filter("__kind = 1").select(*keys, t, *extra, held.alias(value))


def resample_error(df: DataFrame, ref: str, got: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute, mean squared and relative energy error (energy floor 1e-12)."""
    e = F.col(ref) - F.col(got)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        (F.sum(e * e) / F.greatest(F.sum(F.col(ref) * F.col(ref)), F.lit(1e-12))).alias("rel_err"),
    )


def rebin_events(events: DataFrame, keys: Sequence[str], steps: int, target: int, t: str = "t", value: str = "n") -> DataFrame:
    """Bring sparse event counts from ``steps`` to ``target`` time steps: columns keys, ``bin``, value.

    A whole ratio sums; other shrinking averages over overlapping bins and scales by steps/target;
    growing repeats the nearest earlier step. Bins without events stay absent.
    """
    if target <= 0:
        raise ValueError("target must be positive")
    if steps % target == 0:
        return (
            events.withColumn("bin", F.expr(f"{t} div {steps // target}"))
            .groupBy(*keys, "bin")
            .agg(F.sum(value).alias(value))
        )
    tc = F.col(t)
    if steps > target:
        first = F.floor(tc * target / steps)
        last = F.ceil((tc + 1) * target / steps) - 1
        width = F.expr(f"ceil((bin + 1) * {steps} / {target}) - floor(bin * {steps} / {target})")
        return (
            explode_range(events, first, last, "bin")
            .groupBy(*keys, "bin")
            .agg(F.sum(value).alias("__v"))
            .select(*keys, "bin", (F.col("__v") / width * (steps / target)).alias(value))
        )
    first = F.ceil(tc * target / steps)
    last = F.ceil((tc + 1) * target / steps) - 1
    return explode_range(events, first, last, "bin").select(*keys, "bin", value)
