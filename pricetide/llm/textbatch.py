"""Whole texts of an Arrow batch as one byte array, cut into words, hashed and grouped with numpy.

Tasks see a batch at a time; a batch is worked off in slices of a few megabytes, or one document if that is longer,
so memory depends on the longest document and not on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1, 2**61)) * 8 + 5
BASE_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as longer slices come."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + (1 << 16)), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def buffers(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the offsets of the rows; null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of at most ``limit`` bytes, or one longer row."""
    data, offsets = buffers(array)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes of the class ``inside`` (256 flags); runs do not cross rows."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    flag = inside[data]
    begins, stops = flag.copy(), flag.copy()
    begins[1:] &= ~flag[:-1]
    stops[:-1] &= ~flag[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = flag[cuts]
    stops[cuts - 1] = flag[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of coded bytes times rising powers; ``span_hash`` reads the hash of any span from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] that depends on the bytes alone."""
    back = powers(BASE_INVERSE, len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def window_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values, one for each place where a run fits."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += values[k : k + n]
    return mixed(out)


def bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's entries begin in a row-sorted array, with the total at the end."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def row_sums(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Exact integer sums by row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    edge = bounds(rows, n_rows)
    return total[edge[1:]] - total[edge[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """1 for each byte that begins a character, else 0."""
    return (data & 0xC0) != 0x80


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator needs, whatever else the table holds."""
    return docs.select(F.col("doc_id"), F.col("text"), *(F.col(c) for c in more))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of the table is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
