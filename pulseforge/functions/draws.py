"""Keyed random draws with numpy: 31-bit hashes, binomials by inversion, a splitting tree, and md5 of many texts at once. No Spark here."""

from hashlib import md5
from math import sin

import numpy as np

#: A linear congruential step of 31 bits.
_STEP, _ADD, _BITS = 1103515245, 12345, 31
#: Standard deviations to either side of the mean that an inversion looks at, and as many whole numbers more.
REACH = 12
#: md5's rotations by round, constants and first state; texts hashed at once, so that the columns stay in a core's
#: cache, and bytes of a key that is hashed alone.
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
TEXTS, LONG = 1 << 14, 200


def mix(x: np.ndarray) -> np.ndarray:
    """31 bits to 31 bits, no two alike."""
    x = (x * _STEP + _ADD) & ((1 << _BITS) - 1)
    return x ^ x >> 15


def keyed(seed: int, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """31 bits for each pair of whole numbers."""
    return mix(mix(mix(np.asarray(a, dtype=np.int64) + seed) ^ b))


def log_factorial(k: np.ndarray) -> np.ndarray:
    """By Stirling's series, of which four terms are exact to rounding from 16 on; below by sums."""
    small = np.concatenate([[0.0], np.log(np.arange(1, 16)).cumsum()])
    x = np.maximum(k, 16).astype(np.float64)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(k < 16, small[np.minimum(k, 15)], series)


def binomial(m: int, p: float, u: float) -> int:
    """The least k that a binomial of m trials does not exceed with probability u."""
    if m == 0 or p <= 0:
        return 0
    if p >= 1:
        return m
    mean, sd = m * p, np.sqrt(m * p * (1 - p))
    low, high = max(int(np.floor(mean - REACH * sd)) - REACH, 0), min(int(np.ceil(mean + REACH * sd)) + REACH, m)
    k = np.arange(low, high + 1)
    logs = log_factorial(np.array([m])) - log_factorial(k) - log_factorial(m - k) + k * np.log(p) + (m - k) * np.log1p(-p)
    return min(low + int(np.searchsorted(np.exp(logs).cumsum(), u, side="left")), high)


def draws_of_leaf(counts: np.ndarray, leaf: int, n: int, seed: int) -> np.ndarray:
    """How many of the N = sum(counts) draws of each of n resamples fall into a leaf of the binary tree over counts.

    From the root on, a node's draws are split by a binomial of the left side's share, keyed by resample and node, so the leaves'
    numbers are multinomial and add up to N, and whoever asks for a leaf walks down one path.
    """
    sums = np.concatenate([[0], counts.cumsum()])
    draws, low, high, node = np.full(n, sums[-1], dtype=np.int64), 0, len(counts), 1
    while high - low > 1:
        half = (low + high) // 2
        left, whole = sums[half] - sums[low], sums[high] - sums[low]
        u = (keyed(seed, np.arange(n), node) + 0.5) / (1 << _BITS)
        taken = np.array([binomial(int(m), left / whole if whole else 0.0, x) for m, x in zip(draws, u, strict=True)], dtype=np.int64)
        if leaf < half:
            draws, high, node = taken, half, 2 * node
        else:
            draws, low, node = draws - taken, half, 2 * node + 1
    return draws


def local_counts(draws: np.ndarray, leaf: int, leaves: int, records: int, seed: int) -> np.ndarray:
    """float64, resamples by records: how often each of a leaf's records is drawn, by keyed hashes of the draws' numbers."""
    out = np.zeros((len(draws), records))
    if not records:
        return out
    first = mix(np.arange(int(draws.max(initial=0)), dtype=np.int64))
    bases = keyed(seed, np.arange(len(draws)), leaves + leaf)
    for it, (m, base) in enumerate(zip(draws, bases, strict=True)):
        out[it] = np.bincount(mix(mix(first[:m] ^ base)) * records >> _BITS, minlength=records)
    return out


def _md5_block(state: list[np.ndarray], words: list[np.ndarray | int]) -> list[np.ndarray]:
    """The state after a block of 16 words, each a column or one number for all texts."""
    a, b, c, d = (x.copy() for x in state)
    t, u = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        w = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
        t += a
        if isinstance(w, int):
            t += np.uint32((_SINES[i] + w) & 0xFFFFFFFF)
        else:
            t += w
            t += np.uint32(_SINES[i])
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(t, np.uint32(turn), out=u)
        t >>= np.uint32(32 - turn)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def md5_heads(texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 32 bits of each text's md5. texts: uint8, a row each, of which the first `sizes` bytes count and the others are 0."""
    n, used = len(texts), texts.shape[1] // 4 + 1
    padded = np.zeros((n, 4 * used), dtype=np.uint8)
    padded[:, : texts.shape[1]] = texts
    padded[np.arange(n), sizes] = 128
    columns = np.ascontiguousarray(padded.view("<u4").T)
    blocks = (sizes + 8) // 64 + 1
    state = [np.full(n, x, dtype=np.uint32) for x in _STATE]
    for k in range(int(blocks.max(initial=0))):
        words = [columns[j] if j < used else 0 for j in range(16 * k, 16 * k + 16)]
        last = blocks == k + 1
        for j, bits in ((14, sizes * 8 & 0xFFFFFFFF), (15, sizes * 8 >> 32)):
            words[j] = words[j] + np.where(last, bits, 0).astype(np.uint32)
        new = _md5_block(state, words)
        state = [np.where(k < blocks, x, y) for x, y in zip(new, state, strict=True)]
    return state[0].byteswap()


def _keyed_heads(heads: list[bytes], keys: list[bytes]) -> np.ndarray:
    """md5_heads of each head followed by each key, heads by keys; TEXTS at once or so."""
    out = np.empty((len(heads), len(keys)), dtype=np.uint32)
    room, most = max(map(len, heads)), max(map(len, keys))
    flat = np.zeros((len(keys), most), dtype=np.uint8)
    for row, key in zip(flat, keys, strict=True):
        row[: len(key)] = np.frombuffer(key, dtype=np.uint8)
    sizes = np.array([len(x) for x in keys])
    for low in range(0, len(keys), TEXTS):
        some, of = flat[low : low + TEXTS], sizes[low : low + TEXTS]
        step = max(TEXTS // len(some), 1)
        for k in range(0, len(heads), step):
            texts = np.zeros((len(heads[k : k + step]), len(some), room + most), dtype=np.uint8)
            for text, head in zip(texts, heads[k : k + step], strict=True):
                text[:, : len(head)] = np.frombuffer(head, dtype=np.uint8)
                text[:, len(head) : len(head) + most] = some
            lengths = np.array([len(x) for x in heads[k : k + step]])[:, None] + of
            out[k : k + step, low : low + TEXTS] = md5_heads(texts.reshape(-1, room + most), lengths.ravel()).reshape(lengths.shape)
    return out


def poisson_counts(keys: list[bytes], n: int, seed: int, cdf: list[float]) -> np.ndarray:
    """uint8, n resamples by keys: how often each is drawn. A uniform number, the md5 of seed, resample and key, is looked up in cdf:
    (h + 0.5) / 2^32 exceeds c where h reaches a whole number, without rounding. Long keys are hashed one by one.
    """
    heads = [f"{seed}|{it}|".encode() for it in range(n)]
    h = np.empty((n, len(keys)), dtype=np.uint32)
    short = [i for i, key in enumerate(keys) if len(key) <= LONG]
    if short and heads:
        h[:, short] = _keyed_heads(heads, [keys[i] for i in short])
    for i in set(range(len(keys))).difference(short):
        h[:, i] = [int.from_bytes(md5(head + keys[i]).digest()[:4], "big") for head in heads]
    out = np.zeros(h.shape, dtype=np.uint8)
    for c in cdf:
        out += h >= np.uint32(int(np.floor(c * 2.0**32 - 0.5)) + 1)
    return out
