"""Sliding windows over long sample tables ``(keys, idx, channel columns)``."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.operators import kernels as K
from undula.operators.sequence import _CHUNK, explode_range, with_halo
from undula.session import ship_package, stage

# Class ids and default strides in samples per class.
FALL, DYNAMIC, STATIC = 0, 1, 2
DEFAULT_STRIDES = {FALL: 160, DYNAMIC: 410, STATIC: 205}


def class_stride(y: Column, strides: dict[int, int]) -> Column:
    """Stride per class; null for a class without one (such recordings give no windows)."""
    if any(s <= 0 for s in strides.values()):
        raise ValueError("strides must be positive")
    out = F.lit(None).cast("bigint")
    for k, s in strides.items():
        out = F.when(y == k, F.lit(s).cast("bigint")).otherwise(out)
    return out


def recording_lengths(samples: DataFrame, keys: Sequence[str], *carry: str) -> DataFrame:
    """One row per recording with its length ``n`` (samples are numbered 0..n-1)."""
    return samples.groupBy(*keys, *carry).agg(F.count(F.lit(1)).alias("n"))


def long_enough(recordings: DataFrame, win: int) -> DataFrame:
    return recordings.filter(F.col("n") >= win)


def window_count(n: Column, win: int, stride: Column) -> Column:
    """Windows of a recording of length ``n`` in closed form (0 when too short or no stride)."""
    return F.when((n >= win) & stride.isNotNull(), F.floor((n - win) / stride) + 1).otherwise(0).cast("bigint")


def window_starts(recordings: DataFrame, keys: Sequence[str], win: int, stride: Column) -> DataFrame:
    """Adds ``start`` = 0, stride, 2*stride, ... <= n - win."""
    r = recordings.withColumn("__s", stride).filter(F.col("__s").isNotNull() & (F.col("n") >= win))
    return explode_range(r, F.lit(0), F.col("n") - win, "start", F.col("__s"), spread=keys).drop("__s")


def _covering_starts(at: DataFrame, win: int) -> DataFrame:
    """From rows with ``peak``, ``n`` and ``__s``: the regular starts whose window covers the peak."""
    first = F.greatest(F.floor((F.col("peak") - win) / F.col("__s")) + 1, F.lit(0))
    last = F.floor(F.least(F.col("peak"), F.col("n") - win) / F.col("__s"))
    return explode_range(at, first, last, "__k").withColumn("start", (F.col("__k") * F.col("__s")).cast("bigint")).drop("__k")


def window_statistics(samples: DataFrame, keys: Sequence[str], value: str, win: int, hop: int) -> DataFrame:
    """Mean, population deviation and maximum of ``value`` in every full window [k * hop, k * hop + win).

    Samples are sent straight to the windows that hold them, and the aggregates combine before the shuffle.
    """
    first = F.greatest(F.floor((F.col("idx") - win) / hop) + 1, F.lit(0))
    hit = samples.select(*keys, value, F.explode(F.sequence(first, F.floor(F.col("idx") / hop))).alias("__k"))
    c = F.col(value).cast("double")
    stats = hit.groupBy(*keys, (F.col("__k") * hop).cast("bigint").alias("start")).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.max(value).alias("top")
    )
    return stats.filter(F.col("__n") == win).drop("__n")


def _amplitude(channels: Sequence[str]) -> Column:
    """Largest |value| of the channels; one channel is enough."""
    a = [F.abs(F.col(c)) for c in channels]
    return F.greatest(*a) if len(a) > 1 else a[0]


def peak_grid(win: int, strides: dict[int, int] = DEFAULT_STRIDES) -> int:
    """The longest blocks that every window is made up of."""
    return math.gcd(win, *strides.values())


def global_peak_starts(
    samples: DataFrame, recordings: DataFrame, keys: Sequence[str], channels: Sequence[str], win: int, stride: Column, grid: int = 1
) -> DataFrame:
    """Starts whose window covers any sample that attains the largest |value| of the recording.

    Ties all count; a recording whose peaks lie behind the last window keeps none. Windows are made up of whole
    blocks of ``grid`` samples, which divides ``win`` and every stride, so the blocks' maxima say all: they
    combine before the only shuffle of samples, and only blocks that reach the top are looked at again.
    """
    if win % grid:
        raise ValueError("grid must divide win")
    keys = list(keys)
    amp = samples.select(*keys, F.floor(F.col("idx") / grid).alias("__block"), _amplitude(channels).alias("__amp"))
    blocks = stage(amp.groupBy(*keys, "__block").agg(F.max("__amp").alias("__amp")), "peaks")
    top = blocks.groupBy(*keys).agg(F.max("__amp").alias("__top"))
    peaks = blocks.join(top, keys).filter("__amp = __top").select(*keys, (F.col("__block") * grid).alias("peak"))
    fits = F.when(F.col("__s") % grid == 0, F.col("__s")).otherwise(F.raise_error(F.lit("grid must divide every stride")).cast("bigint"))
    rec = recordings.withColumn("__s", stride).filter(F.col("__s").isNotNull() & (F.col("n") >= win)).withColumn("__s", fits)
    return _covering_starts(peaks.join(rec, keys), win).drop("peak", "__s").distinct()


def first_peak_starts(
    samples: DataFrame, recordings: DataFrame, keys: Sequence[str], acc: Sequence[str], win: int, stride: Column
) -> DataFrame:
    """Starts whose window covers the first largest |acc|; one centred start where there is none."""
    amp = _amplitude(acc)
    peaks = samples.groupBy(*keys).agg((-F.max(F.struct(amp.alias("a"), (-F.col("idx")).alias("i")))["i"]).alias("peak"))
    at = (
        recordings.withColumn("__s", stride)
        .filter(F.col("__s").isNotNull() & (F.col("n") >= win))
        .join(peaks, list(keys))
    )
    covers = F.floor(F.least(F.col("peak"), F.col("n") - win) / F.col("__s")) * F.col("__s") + win > F.col("peak")
    centred = F.greatest(F.lit(0), F.least(F.col("peak") - win // 2, F.col("n") - win)).cast("bigint")
    return (
        _covering_starts(at.filter(covers), win)
        .unionByName(at.filter(~covers).withColumn("start", centred))
        .drop("peak", "__s")
    )


def _packed(samples: DataFrame, keys: Sequence[str], channels: Sequence[str], win: int, size: int, carry: Sequence[str] = ()) -> DataFrame:
    """Samples as one row per (keys, chunk) of ``size`` samples plus a border of ``win - 1``.

    A packed row starts at sample ``chunk * size``, so positions follow without a search, and it never
    grows with the recording. The shuffle moves each sample about once.
    """
    packed = (
        with_halo(samples.select(*keys, "idx", *carry, *channels), "idx", size, after=win - 1)
        .groupBy(*keys, _CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct("idx", *channels))).alias("__rows"), *[F.first(c).alias(c) for c in carry])
    )
    return packed.select(*keys, _CHUNK, *carry, *[F.col(f"__rows.{c}").cast("array<float>").alias(f"__{c}") for c in channels])


def _cut(channels: Sequence[str], start: Column, win: int, size: int) -> Column:
    at = (start - F.col(_CHUNK) * size + 1).cast("int")
    return F.array(*[F.slice(F.col(f"__{c}"), at, win) for c in channels])


def regular_windows(
    samples: DataFrame, keys: Sequence[str], channels: Sequence[str], win: int, stride: Column, carry: Sequence[str] = (),
    chunk_windows: int = 16,
) -> DataFrame:
    """All windows at 0, stride, 2*stride, ... with ``x``, from a single shuffle of the samples.

    Neither recording lengths nor a table of starts is needed: a chunk knows which of its windows are
    complete. ``carry`` columns are constant per recording; ``stride`` may use them.
    """
    keys, size = list(keys), win * chunk_windows
    base = F.col(_CHUNK) * size
    p = _packed(samples, keys, channels, win, size, carry).withColumn("__s", stride.cast("bigint")).filter("__s > 0")
    p = p.withColumn("__lo", (F.ceil(base / F.col("__s")) * F.col("__s")).cast("bigint"))
    p = p.withColumn("__hi", F.least(base + size - 1, base + F.size(f"__{channels[0]}") - win).cast("bigint")).filter("__hi >= __lo")
    out = p.withColumn("start", F.explode(F.sequence("__lo", "__hi", "__s")))
    return out.select(*keys, *carry, "start", _cut(channels, F.col("start"), win, size).alias("x"))


def materialise(
    samples: DataFrame, starts: DataFrame, keys: Sequence[str], channels: Sequence[str], win: int, chunk_windows: int = 16
) -> DataFrame:
    """Attach ``x`` = array<array<float>> (channel-major, ``win`` samples) to every (keys, start).

    For selected or irregular starts. The starts of a chunk are joined on the chunk's own keys, which
    keeps the packed side in place. Incomplete windows are left out.
    """
    keys, size = list(keys), win * chunk_windows
    extra = [c for c in starts.columns if c not in {*keys, "start"}]
    per_chunk = (
        starts.withColumn(_CHUNK, F.floor(F.col("start") / size))
        .groupBy(*keys, _CHUNK)
        .agg(F.collect_list(F.struct("start", *extra)).alias("__starts"))
    )
    out = _packed(samples, keys, channels, win, size).join(per_chunk, [*keys, _CHUNK]).withColumn("__st", F.explode("__starts"))
    start = F.col("__st.start")
    complete = F.size(f"__{channels[0]}") >= start - F.col(_CHUNK) * size + win
    return out.filter(complete).select(*keys, "__st.*", _cut(channels, start, win, size).alias("x"))


def pad_edges(
    samples: DataFrame, recordings: DataFrame, keys: Sequence[str], pad_hop: int, pad_rep: int
) -> DataFrame:
    """Repeat the first and last ``pad_hop`` samples ``pad_rep`` times at both ends.

    ``idx`` becomes the position in the padded recording (offset ``pad_hop * pad_rep``). One pass: each
    sample gives all its positions. Samples of keys that ``recordings`` lacks are left out.
    """
    off = pad_hop * pad_rep
    idx, reps = F.col("idx"), F.array(*[F.lit(r * pad_hop) for r in range(pad_rep)])
    none = F.array().cast("array<bigint>")
    head = F.when(idx < pad_hop, F.transform(reps, lambda r: idx + r)).otherwise(none)
    tail = F.when(idx >= F.col("__n") - pad_hop, F.transform(reps, lambda r: idx + pad_hop + off + r)).otherwise(none)
    at = F.explode(F.concat(F.array(idx + off), head, tail))
    rows = samples.join(recordings.select(*keys, F.col("n").alias("__n")), list(keys))
    return rows.withColumn("__p", at).drop("idx", "__n").withColumn("idx", F.col("__p").cast("bigint")).drop("__p")


def _whole_groups(batches: Iterator[pa.RecordBatch], group: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Sorted batches cut where groups end, with the bounds of their groups."""
    held = None
    for b in batches:
        if b.num_rows == 0:
            continue
        rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        new = np.zeros(rows.num_rows, bool)
        for c in group:
            v = rows.column(c)
            new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(new).tolist()
        if ends:
            yield rows.slice(0, ends[-1]), [0, *ends]
        held = rows.slice(ends[-1] if ends else 0)
    if held is not None:
        yield held, [0, held.num_rows]


def padded_windows(
    samples: DataFrame, recordings: DataFrame, keys: Sequence[str], channels: Sequence[str], win: int, hop: int, pad_hop: int, pad_rep: int,
    carry: Sequence[str] = (), chunk_windows: int = 16,
) -> DataFrame:
    """The windows that ``regular_windows`` cuts from the result of ``pad_edges``, without a row per padded sample.

    Samples are shuffled and sorted once by chunk, with few rows twice at the borders of chunks, and the edges are repeated
    while windows are cut. A task holds one batch and one chunk at a time, however long a recording is.
    """
    keys, carry, off, size = list(keys), list(carry), pad_hop * pad_rep, win * chunk_windows
    idx, n, reps = F.col("idx"), F.col("__n"), [r * pad_hop for r in range(pad_rep)]
    chunks = lambda p: F.sequence(F.greatest(F.floor((p - win + 1) / size), F.lit(0)), F.floor(p / size))
    none = F.array().cast("array<bigint>")
    head = [F.when(idx < pad_hop, chunks(idx + r)).otherwise(none) for r in reps]
    tail = [F.when(idx >= n - pad_hop, chunks(idx + pad_hop + off + r)).otherwise(none) for r in reps]
    edge = (idx < pad_hop) | (idx >= n - pad_hop)
    at = F.when(edge, F.array_distinct(F.concat(chunks(idx + off), *head, *tail))).otherwise(chunks(idx + off))
    rows = samples.select(*keys, *carry, "idx", *[F.col(c).cast("float").alias(c) for c in channels])
    rows = rows.join(recordings.select(*keys, F.col("n").alias("__n")), keys).withColumn(_CHUNK, F.explode(at))
    rows = rows.repartition(*keys, _CHUNK).sortWithinPartitions(*keys, _CHUNK, "idx")
    kept = [*keys, *carry]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("start", T.LongType()), T.StructField("x", T.ArrayType(T.ArrayType(T.FloatType())))])

    def cut(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Starts and windows of one chunk."""
        begin, total = part.column(_CHUNK)[0].as_py() * size, part.column("__n")[0].as_py()
        i = part.column("idx").to_numpy()
        first, last = np.flatnonzero(i < pad_hop), np.flatnonzero(i >= total - pad_hop)
        of = np.concatenate([first] * pad_rep + [np.arange(len(i))] + [last] * pad_rep)
        p = np.concatenate([i[first] + r for r in reps] + [i + off] + [i[last] + pad_hop + off + r for r in reps])
        here = (p >= begin) & (p <= begin + size + win - 2)
        of, p = of[here], p[here]
        x = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.float32, copy=False) for c in channels])
        if (np.diff(p) <= 0).any():  # positions that are missing or taken twice: in order, equal ones by value, nulls first
            ties = [k for c, v in zip(channels, x, strict=True) for k in (part.column(c).is_valid().to_numpy(zero_copy_only=False)[of], v[of])]
            of = of[np.lexsort((*ties[::-1], p))]
        starts = np.arange(-(-begin // hop) * hop, begin + min(size - 1, len(of) - win) + 1, hop)
        if not len(starts):
            return starts, np.empty((0, len(channels), win), np.float32)
        return starts, np.lib.stride_tricks.sliding_window_view(x[:, of], win, axis=1)[:, starts - begin].transpose(1, 0, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_groups(batches, [*keys, _CHUNK]):
            found = [cut(rows.slice(a, b - a)) for a, b in zip(bounds, bounds[1:], strict=False)]
            at = pa.array(np.repeat(bounds[:-1], [len(s) for s, _ in found]), pa.int64())
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c).take(at) for c in kept]
                    + [pa.array(np.concatenate([s for s, _ in found]), pa.int64()), K.numpy_to_packed(np.concatenate([x for _, x in found]))],
                    names=schema.names,
                )

    ship_package(samples.sparkSession)
    return rows.mapInArrow(run, schema)


def inside_signal(windows: DataFrame, win: int, n: Column) -> DataFrame:
    """Keep windows that lie in the unpadded signal."""
    return windows.filter((F.col("start") >= 0) & (F.col("start") + win <= n))
