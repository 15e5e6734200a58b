"""Cached token ids of white-space separated units, for tokenizers that never merge across them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Entries a worker keeps before it starts anew, about 200 bytes each besides their text.
CACHE_ENTRIES = 600_000
#: Longest unit that is kept (characters or bytes), so that the text of all entries is bounded too.
LONGEST_KEPT = 64


class Cache(dict):
    """What ``make`` gave for a unit.

    Bounded: it is emptied when full, and long units are made anew each time, which only costs time.
    """

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, unit):
        value = self.make(unit)
        if len(unit) <= LONGEST_KEPT:
            if len(self) >= self.entries:
                self.clear()
            self[unit] = value
        return value

    def learn(self, units: Iterable, values: Iterable) -> None:
        if len(self) >= self.entries:
            self.clear()
        self.update((u, v) for u, v in zip(units, values, strict=True) if len(u) <= LONGEST_KEPT)
