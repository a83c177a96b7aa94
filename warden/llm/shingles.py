"""Word shingles of many texts at a time, as 64-bit hashes in numpy.

Words are runs of anything but ASCII white space, with A-Z in lower case. A word's hash is a polynomial over its bytes,
read off running sums over the whole buffer; a shingle's hash combines those of its words. Equal words and shingles have
equal hashes in every process.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BLOCK = 1 << 20  # bytes hashed together; a longer word makes a longer block
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _letters() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    codes[65:91] += _U(32)
    return mix(codes * _U(0x9E3779B97F4A7C15) + _U(1))


_ROOT = 0x5851F42D4C957F2D  # odd, so it has an inverse
_LETTERS = _letters()
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_COMBINE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | _U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_ROOT, pow(_ROOT, -1, 1 << 64))):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=np.uint64)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in ``data`` and the byte each starts at."""
    raw = np.frombuffer(data, np.uint8)
    edges = np.diff(np.concatenate([[True], _WHITE[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    hashes = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        base = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        size = int(ends[b - 1] - base)
        power, inverse = _power_tables(max(size + 1, _BLOCK + 1))
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[raw[base : base + size]] * power[:size], out=sums[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        hashes[a:b] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        a = b
    return hashes, starts


def combine(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(words) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total += mix(words[j : j + n] ^ _COMBINE[j]) * _COMBINE[j]
    return mix(total)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle, no word gives none."""
    data = [t.encode() for t in texts]
    joined = b" ".join(data)
    hashes, starts = word_hashes(joined)
    ends = np.cumsum([len(d) + 1 for d in data])
    stops = np.searchsorted(starts, ends).tolist()
    runs = combine(hashes, size) if len(hashes) >= size else hashes[:0]
    out, a = [], 0
    for b in stops:
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(combine(hashes[a:b], b - a) ^ _U(b - a))
        else:
            out.append(runs[:0])
        a = b
    return out
