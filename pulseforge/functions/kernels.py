"""Numpy kernels for one recording, a float64 array of leads by samples. No Spark here."""

from functools import lru_cache
from math import ceil, gcd

import numpy as np

from .draws import mix

#: Fixed values of the resampler: filter half-width in periods, share of the band that passes, window shape.
LOWPASS_WIDTH, ROLLOFF, KAISER_BETA = 6, 0.99, 14.769656459379492


def bounds(x: np.ndarray, threshold: float) -> tuple[int, int]:
    """First and one past the last sample where any lead exceeds the threshold; (0, 0) if none does."""
    on = np.flatnonzero((np.abs(x) > threshold).any(axis=0)) if x.size else np.zeros(0, int)
    return (int(on[0]), int(on[-1]) + 1) if len(on) else (0, 0)


def remove_baseline(x: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Subtract the centred moving average over the padded width of the source; also the active end before that.

    Samples from the recording's end to `width` count as zeros; positions outside [0, width) do not count.
    """
    n = x.shape[1]
    half = (int(width * 0.05) | 1) // 2
    start, end = bounds(x, 1e-6)
    sums = np.concatenate([np.zeros((x.shape[0], 1)), np.cumsum(x, axis=1)], axis=1)
    t = np.arange(n)
    lo, hi = np.maximum(t - half, 0), np.minimum(t + half + 1, width)
    mean = (sums[:, np.minimum(hi, n)] - sums[:, np.minimum(lo, n)]) / (hi - lo)
    out = x - mean
    out[:, :start], out[:, end:] = 0, 0
    return out, end


@lru_cache(maxsize=64)
def sinc_kernels(old: int, new: int) -> tuple[np.ndarray, int]:
    """A windowed-sinc filter for each of the `new` phases (rates without common factor), and its reach in samples."""
    cut = min(old, new) * ROLLOFF
    reach = ceil(LOWPASS_WIDTH * old / cut)
    t = (np.arange(-reach, reach + old)[None, :] / old - np.arange(new)[:, None] / new) * cut
    t = np.clip(t, -LOWPASS_WIDTH, LOWPASS_WIDTH)
    window = np.i0(KAISER_BETA * np.sqrt(1 - (t / LOWPASS_WIDTH) ** 2)) / np.i0(KAISER_BETA)
    return np.sinc(t) * window * cut / old, reach


def resample(x: np.ndarray, rate: int, new_rate: int = 400) -> np.ndarray:
    """Band-limited resampling to ceil(n * new / old) samples."""
    n = x.shape[1]
    g = gcd(int(rate), int(new_rate))
    old, new = int(rate) // g, int(new_rate) // g
    if old == new or not n:
        return x.copy()
    kernels, reach = sinc_kernels(old, new)
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (reach, reach + old))), kernels.shape[1], axis=1)[:, ::old]
    return (frames @ kernels.T).reshape(x.shape[0], -1)[:, : ceil(new * n / old)]


def z_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Zero mean and unit deviation of each lead over the active window, zero outside."""
    start, end = bounds(x, eps)
    part, out = x[:, start:end], np.zeros_like(x)
    n = max(end - start, 1)
    mean = part.sum(axis=1, keepdims=True) / n
    var = (part**2).sum(axis=1, keepdims=True) / n - mean**2
    out[:, start:end] = (part - mean) / np.maximum(np.sqrt(np.maximum(var, 1e-8)), eps)
    return out


def normalize(x: np.ndarray, width: int, rate: float | None, collection: str) -> tuple[np.ndarray, int, int]:
    """Baseline, resampling (D1 alone), z-norm and bounds in order: signal, length, start."""
    clean, end = remove_baseline(x, width)
    if collection == "D1":
        known = rate is not None and rate == rate and int(rate) > 0
        clean = resample(clean[:, :end], int(rate)) if known else np.zeros((x.shape[0], 0))
    out = z_norm(clean)
    start, stop = bounds(out, 1e-5)
    return out, stop - start, start


def stft(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """Complex frames of the last axis (leads, frequency, time): periodic Hann window, centred, reflected at the edges."""
    half = n_fft // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    padded = np.pad(x, ((0, 0), (half, half)), mode="reflect" if x.shape[1] > half else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft, axis=1)[:, ::hop]
    return np.swapaxes(np.fft.rfft(frames * window, axis=-1), 1, 2)


def log_spectrogram(x: np.ndarray, n_fft: int = 128, hop: int = 64) -> np.ndarray:
    """Log power, each lead with zero mean and unit sample deviation over all its bins."""
    s = np.log(np.maximum(np.abs(stft(x, n_fft, hop)) ** 2, 1e-10))
    mean = s.mean(axis=(1, 2), keepdims=True)
    std = s.std(axis=(1, 2), ddof=1, keepdims=True) if s[0].size > 1 else np.ones_like(mean)
    return (s - mean) / np.maximum(std, 1e-8)


def chunk_stft(x: np.ndarray, valid: int, n_fft: int = 256, hop: int = 64, chunk: int = 4000) -> list[tuple[int, np.ndarray]]:
    """(chunk number, log(1 + magnitude)) of the chunks whose first sample is valid."""
    n = -(-x.shape[1] // chunk)
    padded = np.pad(x, ((0, 0), (0, n * chunk - x.shape[1])))
    return [(k, np.log1p(np.abs(stft(padded[:, k * chunk : (k + 1) * chunk], n_fft, hop)))) for k in range(n) if k * chunk < valid]


def _shares(starts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """0 to 1, float64, of a congruential hash of every start and step; whole numbers of 31 bits, as mix takes them."""
    h = (starts[:, None] + steps) & np.uint32((1 << 31) - 1)
    for _ in range(3):
        h = mix(h)
    return (h + 0.5) * 2.0**-31


def sinusoids(starts: np.ndarray, a: np.ndarray, o: np.ndarray, f: np.ndarray, p: np.ndarray, rate: int, samples: int) -> np.ndarray:
    """float32, leads by samples: amplitude a, offset o, frequency f and phase p by lead, with normal noise of a tenth of a.

    starts: uint32, two by leads; from each pair the noise of all samples follows.
    """
    t = np.arange(samples)
    steps = (t * 15485863 % (1 << 31)).astype(np.uint32)
    normal = np.sqrt(-2 * np.log(_shares(starts[0], steps))) * np.cos(2 * np.pi * _shares(starts[1], steps))
    angle = (2 * np.pi * f)[:, None] * (t / rate) + p[:, None]
    x = a[:, None] * np.sin(angle) + o[:, None] + normal * 0.1 * np.abs(a)[:, None]
    return x.astype(np.float32)
