"""Word positions, word hashes and window hashes of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from sigloom.llm.common import WHITE

_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE.encode())] = True
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    """Powers of the base (0) or of its inverse (1) modulo 2^64, at least n of them."""
    if len(_powers[which]) < n:
        out = np.full(max(n, 1 << 16), _BASE if which == 0 else _INVERSE, np.uint64)
        out[0] = 1
        _powers[which] = np.multiply.accumulate(out)
    return _powers[which]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one to one."""
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _STEP
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts, in one sequence."""

    def __init__(self, found: list[bytes]):
        self.data = b"\n".join(found)
        data = np.frombuffer(self.data, np.uint8)
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = _SPACE[data]
        self.starts = np.flatnonzero(space[:-2] & ~space[1:-1])
        self.ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
        firsts = np.cumsum([0, *(len(x) + 1 for x in found)])[:-1]
        self.text = np.searchsorted(firsts, self.starts, "right") - 1
        #: Of each text, the number of its first word in the sequence.
        self.first = np.searchsorted(self.text, np.arange(len(found)))
        # In place: a block's eight bytes for each byte are most of what a worker holds.
        sums = _BYTE[data]
        sums *= _power(0, len(data))[: len(data)]
        np.cumsum(sums, out=sums)
        before = np.where(self.starts > 0, sums[self.starts - 1], np.uint64(0)) if len(data) else 0
        raw = (sums[self.ends - 1] - before) * _power(1, len(data) + 1)[self.starts]
        self.hashes = mixed(raw)

    def window_hashes(self, n: int) -> np.ndarray:
        """A hash of every n words in a row, for the positions where all of them exist."""
        return mixed(self._sums(n))

    def _sums(self, n: int) -> np.ndarray:
        """sum(hash[p + k] * BASE^k), built by doubling."""
        width, sums, done, total = 1, self.hashes, 0, None
        left = n
        while left:
            if left & 1:
                part = sums[done:] * _power(0, 64)[done] if done else sums
                total = part if total is None else total[: len(part)] + part
                done += width
            left >>= 1
            if left:
                if len(sums) <= width:
                    return np.zeros(0, np.uint64)
                sums = sums[:-width] + sums[width:] * _power(0, 64)[width]
                width *= 2
        return total[: max(0, len(self.hashes) - n + 1)]

    def inside(self, n: int) -> np.ndarray:
        """For every n words in a row, whether they belong to one text."""
        if len(self.text) < n:
            return np.zeros(0, bool)
        return self.text[: len(self.text) - n + 1] == self.text[n - 1 :]


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` values in a row, the position of the first smallest one."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        have += step
    return best
