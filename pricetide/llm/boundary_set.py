"""A set of positions in containers of 65,536, as a compressed bitmap keeps it, with cumulative cardinalities for select.

Positions are cut into a key (upper bits) and a 16-bit rest. A container holds the rests of one key in the smallest of three
forms: a sorted array (up to 4,096 values), a bitmap of 1,024 words, or runs (first value, length). ``select`` finds the
container by binary search in the cumulative cardinalities and the value by a local select: an index into an array, a search
in the cumulative bit counts of a bitmap's words and the bit in one word, a search in the cumulative lengths of runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

KEY_BITS = 16
ARRAY_MOST = 4096
WORDS = 1024

ARRAY, BITMAP, RUN = 0, 1, 2


@dataclass
class Container:
    kind: int
    values: np.ndarray  # sorted rests, words of the bitmap, or first values of runs
    before: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # set bits before each word, or values before each run


def container(rest: np.ndarray) -> Container:
    """The smallest form of sorted distinct 16-bit values."""
    heads = np.flatnonzero(np.concatenate(([True], np.diff(rest.astype(np.int64)) != 1)))
    if 4 * len(heads) + 2 < min(2 * len(rest), 8 * WORDS):
        return Container(RUN, rest[heads], heads.astype(np.int64))
    if len(rest) <= ARRAY_MOST:
        return Container(ARRAY, rest)
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[rest] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    counts = np.bitwise_count(words).astype(np.int64)
    return Container(BITMAP, words, np.cumsum(counts) - counts)


def nth_bit(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word, by halving."""
    at, k, rest = np.zeros(len(words), np.int64), k.copy(), words.copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = rest & np.uint64((1 << width) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        up = k >= count
        k -= np.where(up, count, 0)
        at += np.where(up, width, 0)
        rest = np.where(up, rest >> np.uint64(width), low)
    return at


def local_select(c: Container, k: np.ndarray) -> np.ndarray:
    """The k-th values (from 0) of one container."""
    if c.kind == ARRAY:
        return c.values[k].astype(np.int64)
    part = np.searchsorted(c.before, k, side="right") - 1
    if c.kind == RUN:
        return c.values[part].astype(np.int64) + k - c.before[part]
    return 64 * part + nth_bit(c.values[part], k - c.before[part])


class BoundarySet:
    """Sorted distinct positions; ``cumulative[i]`` of them stand before container i, the last entry is the cardinality."""

    def __init__(self, positions: np.ndarray) -> None:
        keys = positions >> KEY_BITS
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate(([0], cuts)) if len(positions) else np.empty(0, np.int64)
        self.keys = keys[starts]
        self.cumulative = np.concatenate((starts, [len(positions)])).astype(np.int64)
        rest = (positions & ((1 << KEY_BITS) - 1)).astype(np.uint16)
        self.containers = [container(rest[a:b]) for a, b in zip(self.cumulative[:-1], self.cumulative[1:], strict=True)]

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: np.ndarray) -> np.ndarray:
        """The k-th positions (from 0), for k in any order."""
        where = np.searchsorted(self.cumulative, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        for i in np.unique(where):
            mine = where == i
            out[mine] = (int(self.keys[i]) << KEY_BITS) + local_select(self.containers[i], k[mine] - self.cumulative[i])
        return out
