"""Hashes of byte strings in numpy."""

from __future__ import annotations

import numpy as np

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class PrefixHashes:
    """Polynomial prefix hashes modulo 2**64 of a byte buffer: the hash of any part in constant time."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: np.uint64 = BASES[0]):
        n = len(data)
        power, inverse = self.tables(int(base), n + 1)
        self.inverse = inverse
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.prefix[1:])

    @classmethod
    def tables(cls, base: int, n: int):
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            size = max(1 << 17, 1 << int(n - 1).bit_length())
            mod = 1 << 64
            made = []
            for b in (base, pow(base, -1, mod)):
                p = np.ones(size, np.uint64)
                done = 1
                while done < size:
                    step = min(done, size - done)
                    p[done : done + step] = p[:step] * np.uint64(pow(b, done, mod))
                    done += step
                made.append(p)
            have = cls._powers[base] = (made[0], made[1])
        return have[0][:n], have[1][:n]

    def of(self, start, length) -> np.ndarray:
        """Hashes of the parts that begin at ``start`` (an array, or a slice for parts of one length)."""
        end = slice(start.start + length, start.stop + length) if isinstance(start, slice) else start + length
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash, so that all of them depend on the whole string."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))
