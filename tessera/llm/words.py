"""Words of many texts at once: numpy over the joined UTF-8 bytes."""

from __future__ import annotations

import functools

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def _computed(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    p, q = np.full(n, _B, np.uint64), np.full(n, _INV, np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


_kept = functools.lru_cache(maxsize=1)(_computed)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers for n places; those of a usual chunk are kept, those of a very long text are not."""
    return _kept(1 << 21) if n <= 1 << 21 else _computed(n)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of any substrings of a byte array: values depend on the bytes alone, not on their place."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.pow, self.inv = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= self.pow[:n]
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])


def _letters() -> np.ndarray:
    lut = np.zeros(256, np.uint8)
    for c in range(256):
        if chr(c).isalnum() and c < 128:
            lut[c] = ord(chr(c).lower())
        elif c >= 128:
            lut[c] = c
    return lut


_LUT = _letters()


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cases ASCII and Latin-1 letters of UTF-8 bytes; what is neither letter, digit nor non-ASCII becomes 0."""
    out = _LUT[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[up] += 0x20
    return out


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, index of the text) of all words: runs of letters, digits and non-ASCII bytes."""
    data = fold(np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8))
    inside = data != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    firsts = np.cumsum([1] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(firsts, starts, side="right") - 1
    return data, starts, ends, owner
