"""Binary codes of vectors under randomised rotations, with correction factors.

A unit vector x is rotated; the signs of its coordinates, over sqrt(dim), are a unit vector s, which the code stores
in one bit a dimension. With f = <s, x> and the rest s - f x, which is orthogonal to x, the estimate <s, y> / f
of another unit vector's inner product <x, y> is unbiased over rotations, and it is off by at most
sqrt(1 - <x, y>^2) * sqrt(1 - f^2) / f. For pairs at a cosine c or above, that is a bound which always holds.
y is rounded to PLANES bits a coordinate, so that <s, y> needs counts of common bits only; what rounding takes
away is stored as well and widens the bound.

Further rotations give more sign bits, from which the keys of hash tables are drawn. Two vectors agree in a bit
with probability 1 - angle / pi.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

PLANES = 4
POOL_BITS = 256  # at least so many sign bits a vector
SEED = 20


def unit(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled by a power of two first, so that no square overflows or vanishes."""
    _, e = np.frexp(np.abs(v).max(1, initial=0))
    v = np.ldexp(v, -e[:, None])
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


@lru_cache(maxsize=4)
def rotations(dim: int) -> np.ndarray:
    """Orthogonal matrices below each other, enough for POOL_BITS rows; the same ones everywhere."""
    rng = np.random.default_rng([SEED, dim])
    out = []
    for _ in range(-(-POOL_BITS // dim)):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        out.append((q * np.where(np.diag(r) < 0, -1, 1)).T)
    return np.concatenate(out)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, the last one filled with zeros."""
    n, m = bits.shape
    wide = np.zeros((n, -(-m // 64) * 64), np.uint8)
    wide[:, :m] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def _layout(dim: int) -> np.dtype:
    words, pool = -(-dim // 64), -(-dim * -(-POOL_BITS // dim) // 64)
    return np.dtype([("pool", np.uint64, (pool,)), ("code", np.uint64, (words,)), ("planes", np.uint64, (PLANES, words)), ("factor", "f4"), ("low", "f4"), ("step", "f4"), ("total", "i4"), ("lost", "f4")])


@lru_cache(maxsize=4)
def layout(dim: int) -> np.dtype:
    """What is stored of a vector: all sign bits, the code (the first rotation's), the rounded coordinates by
    bit, f, the smallest coordinate, the rounding step, the sum of the rounded coordinates, and the length of
    what rounding takes away."""
    return _layout(dim)


def encoded(v: np.ndarray) -> np.ndarray:
    """One record of ``layout`` for each row of ``v`` (finite, not zero)."""
    n, dim = v.shape
    x = unit(v)
    r = x @ rotations(dim).T
    y = r[:, :dim]
    out = np.zeros(n, layout(dim))
    out["pool"], out["code"] = _words(r >= 0), _words(y >= 0)
    out["factor"] = np.abs(y).sum(1) / math.sqrt(dim)
    low = y.min(1)
    step = np.maximum((y.max(1) - low) / (2**PLANES - 1), 1e-30)
    low, step = low.astype(np.float32).astype(float), step.astype(np.float32).astype(float)
    u = np.clip(np.rint((y - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.uint8)
    for k in range(PLANES):
        out["planes"][:, k] = _words(u >> k & 1)
    out["low"], out["step"], out["total"] = low, step, u.sum(1)
    out["lost"] = np.linalg.norm(y - low[:, None] - step[:, None] * u, axis=1)
    return out


def estimates(a: np.ndarray, b: np.ndarray, dim: int) -> np.ndarray:
    """Of each pair of rows the inner product, from the code of ``a`` and the rounded coordinates of ``b``."""
    ones = np.bitwise_count(a["code"]).sum(1, dtype=np.int64)
    both = np.zeros(len(a), np.int64)
    for k in range(PLANES):
        both += np.bitwise_count(a["code"] & b["planes"][:, k]).sum(1, dtype=np.int64) << k
    s = b["low"].astype(float) * (2 * ones - dim) + b["step"].astype(float) * (2 * both - b["total"])
    return s / (math.sqrt(dim) * a["factor"].astype(float))


def slack(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """By how much an estimate can be below the inner product of a pair at ``least`` or above."""
    f = a["factor"].astype(float)
    return (math.sqrt(1 - least * least) * np.sqrt(np.maximum(1 - f * f, 0)) + b["lost"]) / f + 1e-5


def may_link(a: np.ndarray, b: np.ndarray, dim: int, least: float) -> np.ndarray:
    """False only for pairs whose cosine is certainly below ``least``, by the codes of either side."""
    keep = estimates(a, b, dim) + slack(a, b, least) >= least
    i = np.flatnonzero(keep)
    keep[i] = estimates(b[i], a[i], dim) + slack(b[i], a[i], least) >= least
    return keep


def tables(rows: int, least: float, recall: float, mean: int) -> tuple[int, int]:
    """(bits of a key, number of tables): some ``mean`` rows a key, and a pair at ``least`` shares a key with
    probability ``recall``; one at a higher cosine more often."""
    bits = max(1, math.ceil(math.log2(max(2, rows / mean))))
    one = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - one))) if one < 1 else 1


@lru_cache(maxsize=8)
def masks(dim: int, bits: int, number: int) -> np.ndarray:
    """The places in the pool that each table's key is made of: (number, bits) places."""
    pool = dim * -(-POOL_BITS // dim)
    rng = np.random.default_rng([SEED, dim, bits])
    return np.stack([rng.permutation(pool)[: min(bits, pool)] for _ in range(number)])


@lru_cache(maxsize=8)
def mask_words(dim: int, bits: int, number: int) -> np.ndarray:
    """The same as words to compare whole keys with."""
    places = masks(dim, bits, number)
    flags = np.zeros((number, dim * -(-POOL_BITS // dim)), np.uint8)
    flags[np.arange(number)[:, None], places] = 1
    return _words(flags)


def keys(records: np.ndarray, dim: int, bits: int, number: int) -> np.ndarray:
    """(rows, number): the key of each row in each table."""
    out = np.zeros((len(records), number), np.int64)
    for j in range(masks(dim, bits, number).shape[1]):
        at = masks(dim, bits, number)[:, j]
        out |= ((records["pool"][:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << j
    return out


def earlier(a: np.ndarray, b: np.ndarray, table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether a pair of rows has a common key in a table before ``table``."""
    x = a["pool"] ^ b["pool"]
    out = np.zeros(len(a), bool)
    for t in range(int(table.max(initial=0))):
        out |= (t < table) & ~(x & words[t]).any(1)
    return out
