"""Sampled anchors for finding repeated windows without looking at every window.

Every window of `width` units holds `width - gram + 1` grams; the one with the smallest hash (the last of equal ones) is
the window's anchor. Equal windows have equal anchors at equal offsets, so only windows whose anchor recurs can recur.
Neighbouring windows mostly share an anchor: one row for an anchor stands for all windows that it owns, and the units
these cover are its context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

FACTOR = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)
SHIFT = np.uint64(32)


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Powers:
    """FACTOR and its inverse modulo 2^64 to the powers 0..n-1, kept for the largest n seen."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", FACTOR), ("down", np.uint64(pow(int(FACTOR), -1, 1 << 64)))):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                setattr(cls, name, np.multiply.accumulate(out))
        return cls.up[:n], cls.down[:n]


class PrefixHash:
    """Hashes of any span of an array of 64-bit values from one running sum: sum of value * FACTOR^position, taken back
    to position 0 by the inverse power."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.back = Powers.to(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.total[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.total[end] - self.total[begin]) * self.back[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


BYTE_HASH = scramble(np.arange(1, 257, dtype=np.uint64) * FACTOR)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def byte_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each byte of all texts, and where each text begins."""
    starts = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    return BYTE_HASH[np.frombuffer(b"".join(texts), np.uint8)], starts


def word_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of all texts, and the number of the first word of each text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    word = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    starts = np.searchsorted(begin, np.r_[0, np.cumsum([len(t) + 1 for t in texts])])
    if not len(begin):
        return np.zeros(0, np.uint64), starts
    return PrefixHash(BYTE_HASH[data]).spans(begin, end), starts


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each full window, by running minima from both ends of blocks of `width`."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Anchors:
    """Arrays with one entry for each anchor: its row, gram hash, context hash, first and last window start, and how far
    into the context the gram begins."""

    row: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lead: np.ndarray


def anchors(values: np.ndarray, starts: np.ndarray, width: int, gram: int, chunk: int = 1 << 19) -> Iterator[Anchors]:
    """Anchors of all texts laid one after another in `values` (64-bit unit hashes); text i is starts[i]:starts[i + 1].

    Works on `chunk` units at a time; an anchor whose windows lie in two chunks or texts gives two entries.
    """
    for begin in range(0, max(len(values) - width + 1, 0), chunk):
        part = values[begin : begin + chunk + width - 1]
        sums = PrefixHash(part)
        place = np.arange(len(part) - gram + 1)
        grams = sums.spans(place, place + gram)
        order = (grams & ~LOW) | (LOW - place.astype(np.uint64))
        chosen = (LOW - (sliding_min(order, width - gram + 1) & LOW)).astype(np.int64)
        window = np.arange(len(chosen))
        row = np.searchsorted(starts, window + begin, "right") - 1
        fits = window + begin + width <= starts[row + 1]
        window, chosen, row = window[fits], chosen[fits], row[fits]
        if not len(window):
            continue
        new = np.r_[True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])]
        at = np.flatnonzero(new)
        first, last = window[at], window[np.r_[at[1:], len(window)] - 1]
        q = chosen[at]
        context = scramble(sums.spans(first, last + width) + (q - first).astype(np.uint64) * FACTOR)
        own = starts[row[at]]
        yield Anchors(row[at], grams[q], context, first + begin - own, last + begin - own, q - first)
