"""Vectorised hashes of words and word sequences over whole blocks of text."""

from __future__ import annotations

import numpy as np

from lintlake.llm import workers

#: Odd multiplier of the polynomial, and the most positions hashed from one base.
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20
_U = np.uint64
_powers = (np.ones(1, _U), np.ones(1, _U))
#: A random 64-bit value for each byte.
BYTE_VALUES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
BLANK_BYTES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK)
        inverse = pow(BASE, -1, 1 << 64)
        tables = []
        for b in (BASE, inverse):
            steps = np.full(size, b, _U)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=_U))
        _powers = (tables[0], tables[1])
    return _powers[0][:n], _powers[1][:n]


def _forget_powers() -> None:
    global _powers
    _powers = (np.ones(1, _U), np.ones(1, _U))


workers.on_change(_forget_powers)


def spans(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``blank`` is false."""
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; the same values give the same hash anywhere."""
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        part = values[base : int(ends[stop - 1])]
        up, down = powers(len(part) + 1)
        total = np.concatenate((np.zeros(1, _U), np.cumsum(part * up[:-1], dtype=_U)))
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (total[e] - total[s]) * down[s]
        at = stop
    return mix(out)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ASCII-lower-cased blank-separated words of all texts in order, and each text's count."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = spans(BLANK_BYTES[data])
    hashes = np.empty(len(starts), _U)
    for at in range(0, len(starts), 1 << 18):  # bounds the 64-bit copy of the bytes
        s, e = starts[at : at + (1 << 18)], ends[at : at + (1 << 18)]
        low = int(s[0])
        hashes[at : at + len(s)] = span_hashes(BYTE_VALUES[LOWER[data[low : int(e[-1])]]], s - low, e - low)
    lasts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    bounds = np.searchsorted(starts, lasts)
    return hashes, np.diff(np.concatenate(([0], bounds)))


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` neighbouring ones."""
    if len(hashes) < n:
        return np.empty(0, _U)
    total = np.zeros(len(hashes) - n + 1, _U)
    for j in range(n):
        total = total * _U(BASE) + hashes[j : len(hashes) - n + 1 + j]
    return mix(total ^ _U(n))
