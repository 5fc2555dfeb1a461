import numpy as np
import pyarrow as pa
import pytest

from undula.operators import kernels as K

F32 = np.float32


@pytest.mark.parametrize("n,m", [(410, 2048), (128, 640), (64, 320), (10, 3), (5, 1)])
def test_grid_is_the_float32_line(n, m):
    assert np.array_equal(K.output_grid(n, m), np.linspace(0.0, n - 1, m, dtype=F32))


@pytest.mark.parametrize("degree", [0, 1, 2, 3])
def test_cubic_is_exact_for_polynomials(degree):
    f = np.polynomial.Polynomial([1.0, -0.5, 0.02, -0.001][: degree + 1])
    x = np.arange(30.0)
    got = K.make_resampler(30, 101, "cubic")(f(x)[None, None])
    assert np.allclose(got[0, 0], f(K.output_grid(30, 101).astype(float)), rtol=1e-5, atol=1e-4)


def test_cubic_passes_through_samples_and_needs_four():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 3, 20)).astype(F32)
    assert np.allclose(K.make_resampler(20, 39, "cubic")(x)[..., ::2], x, atol=1e-5)
    y = rng.normal(size=(1, 1, 3)).astype(F32)
    assert np.array_equal(K.make_resampler(3, 9, "cubic")(y), K.make_resampler(3, 9, "linear")(y))


def test_hold_and_back():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 2, 64)).astype(F32)
    up = K.make_resampler(64, 320, "linear")(x)
    t = K.output_grid(64, 320)
    back = K.make_back_resampler(64, 320, "linear")(up)
    for i in range(4):
        for c in range(2):
            assert np.array_equal(back[i, c], np.interp(np.arange(64, dtype=F32), t, up[i, c]).astype(F32))
    assert np.array_equal(K.make_resampler(64, 320, "zoh")(x), x[..., np.floor(t).astype(int)])


def loop(x, th, dz, start):
    s, ev, tr = F32(start), [], []
    for v in x:
        d = F32(v - s)
        e = 0 if not abs(d) > dz else (1 if d >= 0 else -1)
        s = F32(s + F32(e) * th)
        ev.append(e)
        tr.append(s)
    return ev, tr


def test_delta_events_against_a_loop():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=(5, 3, 200)), axis=2).astype(F32)
    x[0, 0] = 1.0  # constant
    x[1, 0, 1:] = x[1, 0, 0] + F32(0.25)  # exactly at the dead zone: must not fire
    th = np.array([0.5, 0.3, 1.7], F32)
    dz = np.array([0.25, 0.0, 0.9], F32)
    ev, st, tr = K.delta_events(x, th, dz, x[..., 0], True)
    for i in range(5):
        for c in range(3):
            e, t = loop(x[i, c], th[c], dz[c], x[i, c, 0])
            assert list(ev[i, c]) == e and np.array_equal(tr[i, c], t) and st[i, c] == t[-1]
    assert not ev[0, 0].any() and not ev[1, 0].any()


def test_level_crossing_cap():
    x = np.array([[[0.0, 100.0, 100.0, -100.0, 0.4]]], F32)
    net, level, tr = K.crossing_counts(x, np.array([1.0], F32), 15, np.array([[0.0]], F32), True)
    assert net[0, 0].tolist() == [0, 15, 15, -15, -14]
    free, *_ = K.crossing_counts(x, np.array([1.0], F32), None, np.array([[0.0]], F32))
    assert free[0, 0].tolist() == [0, 100, 0, -200, 100]
    assert level[0, 0] == tr[0, 0, -1]


@pytest.mark.parametrize("soft", [True, False])
def test_leaky(soft):
    x = np.array([[0.6, 0.6, 2.5, 0.0, 1.0]], F32)
    s, m = K.leaky_spikes(x, 0.5, 1.0, soft, F32(0))
    mem, want = F32(0), []
    for v in x[0]:
        mem = F32(mem * F32(0.5) + v)
        k = mem > 1.0
        want.append(int(k))
        mem = F32(mem - 1.0) if k and soft else (F32(0) if k else mem)
    assert s[0].tolist() == want and m[0] == mem


def test_packed_round_trip():
    a = np.arange(24, dtype=F32).reshape(2, 3, 4)
    packed = K.numpy_to_packed(a)
    assert np.array_equal(K.packed_to_numpy(packed), a)
    assert np.array_equal(K.packed_to_numpy(packed.slice(1, 1)), a[1:])
    assert packed.type == pa.list_(pa.list_(pa.float32()))
