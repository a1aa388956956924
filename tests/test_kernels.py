"""Numpy kernels against slow definitions and properties."""

import numpy as np
import pytest

from pulseforge.functions import kernels as k


def test_bounds():
    x = np.zeros((3, 10))
    x[0, :3], x[1, 4:7], x[2, 8:] = 1, 1, 1
    assert k.bounds(x, 1e-6) == (0, 10)
    y = np.zeros((2, 20))
    y[0, 5:15], y[1, 8:10] = 1, 1
    assert k.bounds(y, 1e-6) == (5, 15)
    assert k.bounds(np.zeros((12, 50)), 1e-6) == (0, 0)


@pytest.mark.parametrize("width", [100, 400])
def test_baseline_is_the_direct_average(width):
    x = np.random.default_rng(1).standard_normal((2, 100)) + 1
    padded = np.concatenate([x, np.zeros((2, width - 100))], axis=1)
    half = (int(width * 0.05) | 1) // 2
    want = np.array([[row[t] - row[max(t - half, 0) : min(t + half + 1, width)].mean() for t in range(100)] for row in padded])
    got, end = k.remove_baseline(x, width)
    assert end == 100
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_baseline_depends_on_the_source_width():
    x = np.random.default_rng(1).standard_normal((1, 100))
    assert not np.allclose(k.remove_baseline(x, 100)[0], k.remove_baseline(x, 400)[0])


@pytest.mark.parametrize("rate", [1000, 500, 257, 250, 128])
def test_resample_keeps_level_and_sine(rate):
    n = 2 * rate
    t, u = np.arange(n) / rate, np.arange(-(-n * 400 // rate)) / 400
    y = k.resample(np.stack([np.ones(n), np.sin(2 * np.pi * 5 * t)]), rate)
    assert y.shape[1] == -(-n * 400 // rate)
    inner = slice(60, len(u) - 60)
    np.testing.assert_allclose(y[0, inner], 1, atol=2e-2)
    np.testing.assert_allclose(y[1, inner], np.sin(2 * np.pi * 5 * u)[inner], atol=3e-2)


def test_resample_stops_what_the_new_rate_cannot_hold():
    t = np.arange(2000) / 1000
    y = k.resample(np.sin(2 * np.pi * 330 * t)[None], 1000)
    assert np.abs(y[0, 60:-60]).max() < 0.05


def test_z_norm_and_flat():
    x = np.random.default_rng(2).standard_normal((3, 200)) * 5 + 7
    x[:, :20] = 0
    z = k.z_norm(x)
    np.testing.assert_allclose(z[:, 20:].mean(axis=1), 0, atol=1e-9)
    np.testing.assert_allclose(z[:, 20:].std(axis=1), 1, atol=1e-9)
    assert (z[:, :20] == 0).all() and (k.z_norm(np.zeros((2, 9))) == 0).all()


@pytest.mark.parametrize("n_fft, hop, size, frames", [(16, 8, 64, 9), (128, 64, 400, 7), (256, 64, 4000, 63), (128, 64, 40, 1)])
def test_stft_is_the_direct_transform(n_fft, hop, size, frames):
    x = np.random.default_rng(3).standard_normal((1, size))
    s = k.stft(x, n_fft, hop)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    p = np.pad(x[0], n_fft // 2, mode="reflect" if size > n_fft // 2 else "constant")
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n_fft // 2 + 1), np.arange(n_fft)) / n_fft)
    for m in range(frames):
        np.testing.assert_allclose(s[0, :, m], turn @ (p[m * hop : m * hop + n_fft] * window), atol=1e-9)
    assert s.shape == (1, n_fft // 2 + 1, frames)


def test_normalize_null_rate_and_d2():
    x = np.random.default_rng(4).standard_normal((2, 500))
    assert k.normalize(x, 500, None, "D1")[1:] == (0, 0)
    assert k.normalize(x, 500, None, "D2")[1] == 500


def test_chunks_need_a_valid_first_sample():
    assert [c for c, _ in k.chunk_stft(np.ones((1, 90)), 45, 16, 8, 40)] == [0, 1]
