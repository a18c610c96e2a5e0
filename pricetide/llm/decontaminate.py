"""Benchmark decontamination: multi-pattern search with block shift tables (Wu and Manber).

A pattern is a window of ten consecutive item words; an item of one to nine words is one window. For all windows of one
length a shift table over blocks of two words says how far a cursor may jump; where it says zero, the suffix-hash bucket
of the block names the windows that may end there, and their words are compared byte by byte.

* Words are runs of ``0-9``, ``a-z`` and everything beyond ASCII, after lower-casing A-Z. Null and empty texts have none.
* Windows never cross documents; overlapping and repeated occurrences hit each word once.
* Rows that repeat a doc_id are judged one by one. An empty benchmark leaves every document clean.
* Items that repeat an id count once; a null item_id is written as ``null``.
* Items are a query set: their texts go to the driver in blocks of at most ``BLOCK_BYTES`` and each block is searched in a
  scan of its own, so neither driver nor executors hold more than one block's tables, however large the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textbatch as tb

WINDOW = 10
BLOCK_WORDS = 2
TABLE_BITS = 20
SEGMENT = 512
BLOCK_BYTES = 8 << 20

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = True
WORD[0x61:0x7B] = True
WORD[0x80:] = True

HITS = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def block_hash(words: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at each of ``ends``."""
    h = words[ends]
    for back in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[ends - back]
    return tb.mixed(h)


class Words:
    """All words of a block of items: one byte buffer, where each word lies in it, its hash and its item."""

    def __init__(self, items: Iterable[tuple[object, str | None]]):
        names: dict[str, int] = {}
        texts, owner = [], []
        for item_id, text in items:
            owner.append(names.setdefault("null" if item_id is None else str(item_id), len(names)))
            texts.append((text or "").encode())
        self.names = list(names)
        data = tb.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.starts, self.ends, rows = tb.spans(data, offsets, WORD)
        self.hashes = tb.span_hash(tb.prefix_hash(data), self.starts, self.ends)
        self.first = tb.bounds(rows, len(texts))
        self.item = np.array(owner, np.int32)[rows]
        self.raw = data.tobytes()


class Patterns:
    """All windows of one length: shift table, suffix buckets, each window's first word, and its items as ranges of ``items``.

    Equal windows, told by 128 bits over their words' hashes, are one pattern. All but the words' bytes are numeric arrays, some
    30 bytes a window beside 28 a word.
    """

    def __init__(self, length: int, words: Words, starts: np.ndarray):
        self.length, self.words = length, words
        self.block = min(BLOCK_WORDS, length)
        low, high = np.zeros(len(starts), np.uint64), np.full(len(starts), 7, np.uint64)
        for q in range(length):
            h = words.hashes[starts + q]
            low, high = tb.mixed(low * np.uint64(0x9E3779B97F4A7C15) + h), tb.mixed((high ^ h) * np.uint64(0xD6E8FEB86659FD93))
        item = words.item[starts]
        order = np.lexsort((item, high, low))
        low, high, item, starts = low[order], high[order], item[order], starts[order]
        other = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        new = other | np.concatenate(([True], item[1:] != item[:-1]))
        self.at = starts[other]
        self.items = item[new]
        self.edge = np.append(np.flatnonzero(other[new]), len(self.items))
        shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.uint8)
        for q in range(self.block - 1, length):
            slot = block_hash(words.hashes, self.at + q, self.block) >> np.uint64(64 - TABLE_BITS)
            np.minimum.at(shift, slot.astype(np.int64), np.uint8(length - 1 - q))
        self.shift = shift
        suffix = block_hash(words.hashes, self.at + length - 1, self.block)
        self.order = np.argsort(suffix, kind="stable").astype(np.int32)
        self.suffix = suffix[self.order]

    def same_words(self, k: int, raw: bytes, starts: np.ndarray, ends: np.ndarray, last: int) -> bool:
        """Do the words that end with word ``last`` of a text equal pattern ``k`` byte by byte?"""
        mine, theirs = int(self.at[k]), last - self.length + 1
        return all(
            raw[starts[theirs + q] : ends[theirs + q]] == self.words.raw[self.words.starts[mine + q] : self.words.ends[mine + q]] for q in range(self.length)
        )

    def names(self, k: int) -> list[str]:
        return [self.words.names[i] for i in self.items[self.edge[k] : self.edge[k + 1]]]


def compile_items(items: Iterable[tuple[object, str | None]]) -> list[Patterns]:
    words = Words(items)
    count = np.diff(words.first)
    starts = {n: words.first[:-1][count == n] for n in range(1, WINDOW)}
    long = count >= WINDOW
    windows = count[long] - WINDOW + 1
    ahead = np.cumsum(windows) - windows
    starts[WINDOW] = np.repeat(words.first[:-1][long] - ahead, windows) + np.arange(windows.sum())
    return [Patterns(n, words, at) for n, at in starts.items() if len(at)]


def occurrences(p: Patterns, words: np.ndarray, first: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last word, pattern) of every occurrence; ``first``: where each document's words begin, with the total at the end.

    Documents are searched side by side, long ones as segments: a segment owns the occurrences that end inside it.
    """
    lo, hi = first[:-1] + p.length - 1, first[1:]
    parts = np.maximum(0, -(-(hi - lo) // SEGMENT))
    at = np.repeat(lo, parts) + SEGMENT * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    stop = np.minimum(at + SEGMENT, np.repeat(hi, parts))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        block = block_hash(words, at, p.block)
        step = p.shift[(block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.int64)
        stand = step == 0
        if stand.any():
            here, key = at[stand], block[stand]
            left, right = np.searchsorted(p.suffix, key, "left"), np.searchsorted(p.suffix, key, "right")
            n = right - left
            where = np.repeat(here, n)
            which = p.order[np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            for q in range(p.length):
                same = p.words.hashes[p.at[which] + q] == words[where - p.length + 1 + q]
                where, which = where[same], which[same]
            if len(where):
                found.append((where, which))
        at = at + np.maximum(step, 1)
        on = at < stop
        at, stop = at[on], stop[on]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    where, which = (np.concatenate(x) for x in zip(*found, strict=True))
    sure = [p.same_words(k, raw, starts, ends, e) for e, k in zip(where.tolist(), which.tolist(), strict=True)]
    return where[sure], which[sure]


def search(patterns: list[Patterns], text: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray], list[set[str]]]]:
    """For each row: number of words, then the hit words as runs (start, end) and the items found."""
    for lo, hi, data, offsets in tb.slices(text):
        data = tb.LOWER[data]
        starts, ends, rows = tb.spans(data, offsets, WORD)
        first = tb.bounds(rows, hi - lo)
        words = tb.span_hash(tb.prefix_hash(data), starts, ends)
        raw = data.tobytes()
        mark = np.zeros(len(words) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for p in patterns:
            where, which = occurrences(p, words, first, raw, starts, ends)
            np.add.at(mark, where - p.length + 1, 1)
            np.add.at(mark, where + 1, -1)
            for row, k in zip(rows[where].tolist(), which.tolist(), strict=True):
                items.setdefault(row, set()).update(p.names(k))
        hit = np.cumsum(mark[:-1]) > 0
        for row in range(hi - lo):
            a, b = int(first[row]), int(first[row + 1])
            if row in items:
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit[a:b], [False]))))
                yield b - a, edge.reshape(-1, 2), items[row]
            else:
                yield b - a, np.empty((0, 2), np.int64), set()


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def item_blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Distinct items with a block number, and how many blocks keep each near ``BLOCK_BYTES``."""
    items = stored(benchmark.select("item_id", "text").distinct())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    return items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def find_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, their digest, and whether anything was hit."""
    spark = docs.sparkSession
    items, n_blocks = item_blocks(benchmark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = HITS.format(id=kind)

    def block(b: int):
        rows = items.where(F.col("_block") == b).select("item_id", "text").collect()
        return spark.sparkContext.broadcast(compile_items((r[0], r[1]) for r in rows))

    if n_blocks == 1:
        tables = block(0)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = list(search(tables.value, batch.column("text")))
                hits = [int((r[:, 1] - r[:, 0]).sum()) for _, r, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([n for n, _, _ in got], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for _, _, i in got], pa.int64()), pa.array([digest(i) for _, _, i in got], pa.string()), pa.array([h > 0 for h in hits], pa.bool_())],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

        return tb.texts(docs).mapInArrow(whole, schema)

    # Larger query sets: one scan for each block; what the blocks found meets by document. Hits are sparse and bounded by the text.
    def part(tables):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = list(search(tables.value, batch.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("_text"), pa.array([n for n, _, _ in got], pa.int64()), pa.array([r.ravel().tolist() for _, r, _ in got], pa.list_(pa.int64())), pa.array([sorted(i) for _, _, i in got], pa.list_(pa.string()))],
                    ["doc_id", "_text", "n_words", "runs", "items"],
                )

        return f

    keyed = tb.texts(docs).withColumn("_text", F.xxhash64("text"))
    found = None
    for b in range(n_blocks):
        one = keyed.mapInArrow(part(block(b)), f"doc_id {kind}, _text long, n_words long, runs array<long>, items array<string>")
        one = one.withColumn("_block", F.lit(b))
        found = one if found is None else found.unionByName(one)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, runs, items, copies in zip(*(batch.column(c).to_pylist() for c in ("n_words", "runs", "items", "copies")), strict=True):
                mark = np.zeros(n + 1, np.int64)
                for run in runs:
                    pair = np.array(run, np.int64).reshape(-1, 2)
                    np.add.at(mark, pair[:, 0], 1)
                    np.add.at(mark, pair[:, 1], -1)
                every = {x for group in items for x in group}
                out.append((int((np.cumsum(mark)[:-1] > 0).sum()), len(every), digest(every), copies))
            hits = [o[0] for o in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string()), pa.array([h > 0 for h in hits], pa.bool_()), batch.column("copies")],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "copies"],
            )

    merged = found.groupBy("doc_id", "_text").agg(
        F.first("n_words").alias("n_words"), F.collect_set("runs").alias("runs"), F.collect_set("items").alias("items"), (F.count("*") / n_blocks).cast("long").alias("copies")
    )
    out = merged.select("doc_id", "n_words", "runs", "items", "copies").mapInArrow(merge, schema + ", copies long")
    return out.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("copies", "_copy")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window, with all their columns; only texts go to Python, and nothing is shuffled."""
    items, n_blocks = item_blocks(benchmark)
    for b in range(n_blocks):
        rows = items.where(F.col("_block") == b).select("item_id", "text").collect()
        tables = docs.sparkSession.sparkContext.broadcast(compile_items((r[0], r[1]) for r in rows))
        docs = docs.where(_free_of(tables)(F.col("text")))
    return docs


def _free_of(tables):
    @F.arrow_udf("boolean")
    def free(text: pa.Array) -> pa.Array:
        return pa.array([not found for _, _, found in search(tables.value, text)], pa.bool_())

    return free
