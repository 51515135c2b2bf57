"""Words of many texts as numpy arrays: where they are and a 64-bit hash of each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def random_u64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd numbers of 64 bits."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes of words hashed at once.
HASHED_BYTES = 1 << 18
_BYTES = random_u64(256, 11)
_POWERS = random_u64(4096, 12)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``data``: bytes of all texts; ``start``, ``end``: byte range of each word; ``first``: a text's first word, and after the last text the number of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes and their places, computed for about ``HASHED_BYTES`` at a time."""
        size = self.end - self.start
        ends = np.cumsum(size)
        out, a = np.empty(len(size), np.uint64), 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HASHED_BYTES)))
            out[a:b] = self._hashed(self.start[a:b], size[a:b])
            a = b
        return out

    def _hashed(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        # only the words' own bytes are gathered
        place = np.arange(int(size.sum()), dtype=np.int64)
        at = np.cumsum(size) - size
        place -= np.repeat(at, size)
        values = _BYTES[self.data[np.repeat(start, size) + place]]
        turn, place = np.divmod(place, len(_POWERS)) if int(size.max()) > len(_POWERS) else (None, place)
        values *= _POWERS[place] if turn is None else _POWERS[place] + turn.astype(np.uint64) * np.uint64(2)
        return mixed(np.add.reduceat(values, at) + size.astype(np.uint64))


def words_of(texts: list[str | None], lower: bool = False, between: np.ndarray = _SPACE) -> Words:
    """Words are runs of bytes other than those that ``between`` marks: space, tab, line feed, vertical tab, form feed and carriage return, or more."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    if lower:
        data = _LOWER[data]
    inside = ~between[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    return Words(data, start, end, np.searchsorted(start, begins))


def windows(hashes: np.ndarray, first: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``width`` words of one text, and the word at which it starts; in order."""
    if len(hashes) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    weights = random_u64(width, seed)
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * weights[k]
    last = np.repeat(first[1:], np.diff(first))[:n]  # where the text of each word ends
    start = np.flatnonzero(np.arange(n) + width <= last)
    return mixed(out[start]), start
