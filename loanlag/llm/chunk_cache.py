"""Encoding texts piece by piece, with what was encoded before kept at hand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pieces that a Python worker keeps; beyond it the cache starts anew.
CACHE_PIECES = 250_000
#: And characters of pieces, as some may be very long.
CACHE_CHARACTERS = 8_000_000


class Numbers(dict):
    """Numbers pieces as they come; ``fresh`` lists those seen for the first time."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, piece) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n

    def taken(self) -> list:
        """The fresh ones, which are fresh no more."""
        fresh, self.fresh = self.fresh, []
        return fresh


class Lists:
    """Lists of integers, numbered as they come."""

    def __init__(self) -> None:
        self.flat, self.starts, self.sizes = (np.array([], dtype=np.int64) for _ in range(3))

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """More lists: their members one after the other, and how many each has."""
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members of the lists of these numbers, and how many each has."""
        n = self.sizes[which]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


def runs(texts: list[str], limit: int = 500_000) -> Iterator[slice]:
    """Runs of texts that hold about ``limit`` characters together, at least one text each."""
    return runs_of([len(t) for t in texts], limit)


def runs_of(sizes: list[int], limit: int) -> Iterator[slice]:
    """Runs of ``sizes`` that add up to ``limit`` at most, or one of them each."""
    at = 0
    while at < len(sizes):
        end, held = at + 1, sizes[at]
        while end < len(sizes) and held + sizes[end] <= limit:
            held += sizes[end]
            end += 1
        yield slice(at, end)
        at = end
