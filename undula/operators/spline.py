"""Cubic splines through the samples of timelines of any length.

The second derivatives of a spline solve a tridiagonal system over all samples of a key. Every row of it is
dominated by its diagonal by a factor of two, so a sample's influence at least halves with each sample in
between. A timeline is therefore cut into chunks which also hold the HALO samples on either side: what lies
beyond changes nothing that a double can show (2**-HALO of the largest second derivative near by). Only the two
ends of a timeline have end conditions of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.operators.sequence import _CHUNK, sequence_number, with_halo
from undula.session import ship_package

HALO = 64
SIZE = 16_384  # samples of a chunk
_SEGMENT = ("t0", "v0", "t1", "v1", "m0", "m1")


def tridiagonal(a: np.ndarray, b: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x with a[i] x[i-1] + b[i] x[i] + c[i] x[i+1] = r[i], by cyclic reduction of all rows at once."""
    n, step = len(b), 1
    a, c = np.where(np.arange(n) > 0, a, 0.0), np.where(np.arange(n) < n - 1, c, 0.0)
    while step < n and (a.any() or c.any()):
        pad = lambda x, fill: np.concatenate((np.full(step, fill), x, np.full(step, fill)))
        pa_, pb, pc_, pr = pad(a, 0.0), pad(b, 1.0), pad(c, 0.0), pad(r, 0.0)
        down, up = slice(0, n), slice(2 * step, 2 * step + n)  # the rows step before and step behind
        f, g = -a / pb[down], -c / pb[up]
        a, b, c, r = f * pa_[down], b + f * pc_[down] + g * pa_[up], g * pc_[up], r + f * pr[down] + g * pr[up]
        step *= 2
    return r / b


def second_derivatives(t: np.ndarray, v: np.ndarray, at_start: bool = True, at_end: bool = True) -> np.ndarray:
    """Of the spline through (t, v), whose third derivative is continuous at the second and second-last sample.

    An end that is not the timeline's own (``at_start``, ``at_end``) has 0; under four samples give straight lines.
    """
    n = len(t)
    m = np.zeros(n)
    if n < 3 or (n < 4 and at_start and at_end):
        return m
    h = np.diff(t)
    if (h <= 0).any():
        raise ValueError("the times of a key must differ for the cubic method")
    d = np.diff(v) / h
    a, b, c, r = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(d)
    if at_start:
        b[0] += h[0] + h[0] ** 2 / h[1]
        c[0] -= h[0] ** 2 / h[1]
    if at_end:
        b[-1] += h[-1] + h[-1] ** 2 / h[-2]
        a[-1] -= h[-1] ** 2 / h[-2]
    m[1:-1] = tridiagonal(a, b, c, r)
    if at_start:
        m[0] = m[1] + h[0] / h[1] * (m[1] - m[2])
    if at_end:
        m[-1] = m[-2] + h[-1] / h[-2] * (m[-2] - m[-3])
    return m


def spline_segments(source: DataFrame, keys: Sequence[str], t: str, value: str, seq: str, width: float, size: int = SIZE) -> DataFrame:
    """Every sample with the piece of the spline that begins there: ``keys``, ``t``, ``seq`` and the struct ``segment``.

    The last sample of a key has the last piece. Null times and values are left out. Times of a key must differ; the
    timeline is cut into spans of ``width`` for numbering and into chunks of ``size`` samples for solving.
    """
    keys = list(keys)
    src = source.select(*keys, F.col(t).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"), F.col(seq).cast("bigint").alias("__seq"))
    src = src.filter("__t IS NOT NULL AND __v IS NOT NULL")
    line = sequence_number(src, keys, ["__t", "__seq"], F.floor(F.col("__t") / width), "__i", "__n")
    cut = with_halo(line, "__i", size, HALO, HALO)
    kept = [cut.schema[k] for k in keys]
    schema = T.StructType([*kept, T.StructField("__seq", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("__t", *_SEGMENT)]])

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__i")
        i, n = rows.column("__i").to_numpy(), rows.column("__n")[0].as_py()
        at, v = rows.column("__t").to_numpy(), rows.column("__v").to_numpy()
        m = second_derivatives(at, v, i[0] == 0, i[-1] == n - 1)
        own = np.flatnonzero(rows.column("__own").to_numpy(zero_copy_only=False))
        left = np.maximum(np.minimum(own, len(at) - 2), 0)
        right = np.minimum(left + 1, len(at) - 1)
        segment = [at[left], v[left], at[right], v[right], m[left], m[right]]
        own = pa.array(own)
        columns = [rows.column(k).take(own).combine_chunks() for k in [*keys, "__seq", "__t"]] + [pa.array(x) for x in segment]
        return pa.Table.from_arrays(columns, names=schema.names)

    ship_package(source.sparkSession)
    out = cut.groupBy(*keys, _CHUNK).applyInArrow(solve, schema)
    return out.select(*keys, F.col("__t").alias(t), F.col("__seq").alias(seq), F.struct(*_SEGMENT).alias("segment"))


def segment_value(segment: Column, t: Column) -> Column:
    """The piece's value at ``t``, also outside its samples."""
    h = segment["t1"] - segment["t0"]
    b = F.when(h > 0, (t - segment["t0"]) / h).otherwise(0.0)
    a = 1 - b
    bend = ((a * a * a - a) * segment["m0"] + (b * b * b - b) * segment["m1"]) * h * h / 6
    return a * segment["v0"] + b * segment["v1"] + bend
