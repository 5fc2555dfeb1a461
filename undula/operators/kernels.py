"""NumPy kernels used inside Arrow batches; one call handles all windows of a slice of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

F32 = np.float32
SLICE_FLOATS = 4_000_000  # work on at most this many samples at a time


def packed_to_numpy(col: pa.Array) -> np.ndarray:
    """array<array<float>> of equal shape per row -> (rows, channels, samples)."""
    n = len(col)
    rows = col.flatten()
    flat = rows.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(F32, copy=False).reshape(n, len(rows) // n, -1)


def numpy_to_packed(a: np.ndarray, dtype: pa.DataType | None = None) -> pa.Array:
    """(rows, channels, samples) -> array<array<...>>."""
    n, c, t = a.shape
    values = pa.array(np.ascontiguousarray(a).reshape(-1), type=dtype)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, n * c * t + 1, t), pa.int32()), values)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * c + 1, c), pa.int32()), inner)


def list_column(a: np.ndarray) -> pa.Array:
    """(rows, k) -> array<...>."""
    n, k = a.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(np.ascontiguousarray(a).reshape(-1))
    )


def window_slices(
    batches: Iterator[pa.RecordBatch], column: str, expansion: float = 1.0
) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Cut batches so that windows of one slice, grown by ``expansion``, fit the sample budget."""
    for b in batches:
        if b.num_rows == 0:
            continue
        first = b.column(column)[0].as_py()
        per_row = max(1, sum(len(r) for r in first))
        step = max(1, int(SLICE_FLOATS / (per_row * max(expansion, 1.0))))
        for s in range(0, b.num_rows, step):
            part = b.slice(s, step)
            yield part, packed_to_numpy(part.column(column))


# -- resampling ---------------------------------------------------------------------------------


def output_grid(in_len: int, out_len: int) -> np.ndarray:
    """Evenly spaced positions over [0, in_len-1]: computed in double, then float32."""
    if out_len == 1:
        return np.zeros(1, F32)
    return (np.arange(out_len) * ((in_len - 1.0) / (out_len - 1.0))).astype(F32)


def spline_matrix(in_len: int, at: np.ndarray) -> np.ndarray:
    """Matrix that maps samples at 0..in_len-1 to the not-a-knot cubic spline's values at ``at``.

    With unit spacing and second derivatives M, inner rows state M[i-1]+4M[i]+M[i+1] = 6*d2y and the
    end rows state that the third derivative is continuous at the second and second-last sample.
    """
    n = in_len
    a = np.zeros((n, n))
    r = np.zeros((n, n))
    i = np.arange(1, n - 1)
    a[i, i - 1], a[i, i], a[i, i + 1] = 1, 4, 1
    r[i, i - 1], r[i, i], r[i, i + 1] = 6, -12, 6
    a[0, :3] = 1, -2, 1
    a[-1, -3:] = 1, -2, 1
    m = np.linalg.solve(a, r)
    k = np.clip(np.floor(at.astype(np.float64)).astype(int), 0, n - 2)
    u = at.astype(np.float64) - k
    eye = np.eye(n)
    q0, q1 = (1 - u)[:, None], u[:, None]
    return q0 * eye[k] + q1 * eye[k + 1] + ((q0**3 - q0) * m[k] + (q1**3 - q1) * m[k + 1]) / 6.0


def make_resampler(in_len: int, out_len: int, method: str) -> Callable[[np.ndarray], np.ndarray]:
    """Function (rows, channels, in_len) -> (rows, channels, out_len) in float32."""
    t = output_grid(in_len, out_len)
    left = np.floor(t).astype(np.int64)
    if method == "zoh":
        hold = np.clip(left, 0, in_len - 1)
        return lambda x: x[..., hold]
    if method == "cubic" and in_len >= 4:
        mt = spline_matrix(in_len, t).T
        return lambda x: (x.astype(np.float64) @ mt).astype(F32)
    right = np.minimum(left + 1, in_len - 1)
    alpha = (t - left).astype(F32)

    def linear(x: np.ndarray) -> np.ndarray:
        y0 = x[..., left]
        return y0 + alpha * (x[..., right] - y0)

    return linear


def make_back_resampler(in_len: int, out_len: int, method: str) -> Callable[[np.ndarray], np.ndarray]:
    """Function that reads an upsampled trace back at the sample positions 0..in_len-1."""
    src = output_grid(in_len, out_len)
    dst = np.arange(in_len, dtype=F32)
    j = np.clip(np.searchsorted(src, dst, side="right") - 1, 0, out_len - 1)
    if method == "zoh":
        return lambda y: y[..., j]
    if method == "cubic" and out_len >= 4:
        mt = spline_matrix(out_len, dst.astype(np.float64) * (out_len - 1) / (in_len - 1)).T
        return lambda y: (y.astype(np.float64) @ mt).astype(F32)
    k = np.minimum(j + 1, out_len - 1)
    gap = (src[k].astype(np.float64) - src[j]) + (k == j)
    u = dst.astype(np.float64) - src[j]

    def linear(y: np.ndarray) -> np.ndarray:
        y0 = y[..., j].astype(np.float64)
        return ((y[..., k].astype(np.float64) - y0) / gap * u + y0).astype(F32)

    return linear


# -- recurrences along time ---------------------------------------------------------------------


def delta_events(x, theta, dead, start, trace=False):
    """Sigma-delta recurrence over the last axis of ``x``; leading axes are independent.

    Returns signed events (int8), the last state and, on request, the state after every sample.
    """
    lead = np.broadcast_shapes(x.shape[:-1], theta.shape, start.shape)
    n = x.shape[-1]
    xs = np.ascontiguousarray(np.moveaxis(x, -1, 0))
    ev = np.empty((n, *lead), np.int8)
    tr = np.empty((n, *lead), F32) if trace else None
    state = np.broadcast_to(start, lead).astype(F32)
    for t in range(n):
        d = xs[t] - state
        s = ((d > dead).astype(np.int8) - (d < -dead)).astype(np.int8)
        state = state + s.astype(F32) * theta
        ev[t] = s
        if trace:
            tr[t] = state
    return np.moveaxis(ev, 0, -1), state, None if tr is None else np.moveaxis(tr, 0, -1)


def crossing_counts(x, delta, cap, start, trace=False):
    """Level-crossing recurrence: counts of whole steps up and down per sample, capped."""
    n = x.shape[-1]
    xs = np.ascontiguousarray(np.moveaxis(x, -1, 0))
    net = np.empty(xs.shape, np.int32)
    tr = np.empty(xs.shape, F32) if trace else None
    level = np.broadcast_to(start, xs.shape[1:]).astype(F32)
    for t in range(n):
        d = xs[t] - level
        steps = np.floor(np.abs(d) / delta)
        if cap is not None:
            steps = np.minimum(steps, F32(cap))
        steps = np.where(d < 0, -steps, steps).astype(F32)
        level = level + steps * delta
        net[t] = steps
        if trace:
            tr[t] = level
    return np.moveaxis(net, 0, -1), level, None if tr is None else np.moveaxis(tr, 0, -1)


def leaky_spikes(x, tau, threshold, soft_reset, start):
    """Leaky accumulator: m = tau*m + x, spike when m > threshold, then subtract or clear."""
    n = x.shape[-1]
    xs = np.ascontiguousarray(np.moveaxis(x, -1, 0))
    out = np.empty(xs.shape, np.int8)
    m = np.broadcast_to(start, xs.shape[1:]).astype(F32)
    tau, threshold = F32(tau), F32(threshold)
    for t in range(n):
        m = m * tau + xs[t]
        s = m > threshold
        m = np.where(s, m - threshold if soft_reset else F32(0), m).astype(F32)
        out[t] = s
    return np.moveaxis(out, 0, -1), m
