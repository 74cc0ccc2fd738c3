"""Rolling hashes of byte windows and the content-defined sample that represents them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# A worker keeps two tables of this many powers for each of three seeds.
BUFFER = 1 << 17
_POSITION = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=4)
def _letters(seed: int) -> np.ndarray:
    """A random 64-bit number for every byte."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, for positions of one buffer."""
    base = int(np.random.default_rng(seed + 1).integers(1 << 62, 1 << 63)) | 5
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        factors = np.full(BUFFER + 4096, b, np.uint64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return out[0], out[1]


class Rolling:
    """Hashes of any substring of a buffer of at most ``BUFFER`` bytes and a margin."""

    def __init__(self, data: np.ndarray, seed: int):
        power, self.inverse = _powers(seed)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters(seed)[data] * power[: len(data)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """The hash of each substring of this size."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:-size]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] ^ (end - start).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def window_samples(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` neighbouring hashes the position of its least, the leftmost of equals."""
    ordered = (mixed(hashes) & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    return (sliding_minimum(ordered, width) & _POSITION).astype(np.int64)
