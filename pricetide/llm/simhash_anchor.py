"""SimHash near-duplicates by anchor-point covering.

Fingerprint: for every shingle of four words (repeats included, words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, joined by
spaces; fewer words: the whole sequence) its XXH64 with seed 42; a bit is 1 if it is set in more than half of them. Texts
without words, null and empty ones included, have fingerprint 0 and are linked like any other.

Fingerprints link at ``DISTANCE`` = 4 or fewer differing bits. If two differ in at most 4 of 64 bits, they differ in at most
2 bits of the upper half or at most 1 bit of the lower half. Each half is covered by a code: 31 bits by the Hamming (31, 26)
code, which has a code word within one bit of everything, and the 32nd bit as it is. The code words are the anchors. A
fingerprint's home is its nearest anchor; it is replicated to every anchor within the covering radius plus the half's
threshold, so whatever it links to has its home there, and each anchor compares homes with replicas only.

* Only distinct fingerprints are covered and compared; documents join their fingerprint's component at the end, so copies
  are never expanded into pairs. A crowded anchor is a skewed join, which Spark splits.
* component_id is the smallest doc_id reachable, itself included; null ids count as a document but are never the smallest
  unless a component has no other. Repeated rows are documents like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textbatch as tb
from .components import components

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: (shift of the half, differing bits it must find); the thresholds plus one add up to more than DISTANCE.
HALVES = ((32, 2), (0, 1))

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per document of a slice."""
    n = len(offsets) - 1
    data = tb.LOWER[data]
    starts, ends, rows = tb.spans(data, offsets, tb.NOT_SPACE)
    # All words joined by single spaces: shingles are then plain byte ranges.
    length = ends - starts
    new_ends = np.cumsum(length + 1) - 1
    new_starts = new_ends - length
    joined = np.full(int(new_ends[-1]) + 1 if len(new_ends) else 0, 0x20, np.uint8)
    if len(joined):
        words = np.repeat(starts - new_starts, length) + np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)
        inside = np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)
        joined[inside] = data[words]
    raw = joined.tobytes()
    edge = tb.bounds(rows, n)
    count = np.diff(edge)
    first = edge[:-1]
    many = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n), many)
    at = first[owner] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    last = np.minimum(at + SHINGLE, edge[1:][owner]) - 1
    xxh = xxhash.xxh64_intdigest
    h = np.fromiter((xxh(raw[s:e], SEED) for s, e in zip(new_starts[at].tolist(), new_ends[last].tolist(), strict=True)), np.uint64, len(at))
    octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.empty((n, 64), np.int64)
    for lo in range(0, n, 2048):
        hi = min(lo + 2048, n)
        a, b = np.searchsorted(owner, [lo, hi])
        for k in range(8):
            table = np.bincount((owner[a:b] - lo) * 256 + octets[a:b, k], minlength=(hi - lo) * 256).reshape(hi - lo, 256)
            ones[lo:hi, 8 * k : 8 * k + 8] = table @ BITS
    return np.packbits(2 * ones > many[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text that tells rows of one id apart, and the fingerprint as a signed 64-bit number."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.slices(batch.column("text")):
                given = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "mark")]
                yield pa.RecordBatch.from_arrays([*given, pa.array(fingerprints(data, offsets).view(np.int64))], ["doc_id", "mark", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(sketch, f"doc_id {kind}, mark long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Hamming syndrome of the low 31 bits: the exclusive or of the positions (1 to 31) of the set bits; 0 for code words."""
    s = np.zeros(len(words), np.int64)
    for bit in range(31):
        s ^= np.where((words >> np.uint64(bit)) & np.uint64(1), bit + 1, 0)
    return s


def _patterns(radius: int) -> list[np.ndarray]:
    """For each syndrome, what turns a half with it into each anchor within ``radius``; bit 31 is not coded."""
    out: list[list[int]] = [[] for _ in range(32)]
    for size in range(radius + 1):
        for bits in combinations(range(32), size):
            s = 0
            for b in bits:
                s ^= b + 1 if b < 31 else 0
            out[s].append(sum(1 << b for b in bits))
    return [np.array(x, np.uint64) for x in out]


def homes(half: np.ndarray) -> np.ndarray:
    """The nearest anchor of each 32-bit half."""
    s = _syndromes(half)
    return np.where(s > 0, half ^ (np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64)), half)


def covered(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(homes, replicas) of the distinct fingerprints ``fp``: half, anchor, fp."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k, (shift, _) in enumerate(HALVES):
                anchor = homes((fp >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.int64) * 2 + k
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp.view(np.int64))], ["anchor", "fp"])

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [_patterns(1 + threshold) for _, threshold in HALVES]
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for k, (shift, _) in enumerate(HALVES):
                for lo in range(0, len(every), 1024):
                    fp = every[lo : lo + 1024]
                    half = (fp >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
                    s = _syndromes(half)
                    for value in np.unique(s):
                        mine, way = np.flatnonzero(s == value), patterns[k][value]
                        anchor = (half[mine][:, None] ^ way[None, :]).ravel().astype(np.int64) * 2 + k
                        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.repeat(fp[mine], len(way)).view(np.int64))], ["anchor", "fp"])

    return fps.mapInArrow(home, "anchor long, fp long"), fps.mapInArrow(replicas, "anchor long, fp long")


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``DISTANCE``."""
    home, replica = covered(fps)
    home = home.select(F.col("anchor").alias("_home"), F.col("fp").alias("a"))
    near = (F.col("_home") == F.col("anchor")) & (F.col("a") != F.col("fp")) & (differing(F.col("a"), F.col("fp")) <= DISTANCE)
    return replica.join(home, near).select("a", F.col("fp").alias("b"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, mark, fp, root (one fingerprint per component) and component_id of every document."""
    sketched = stored(with_fingerprint(docs))
    reps = stored(sketched.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    nodes = components(links(reps.select("fp")), "a", "b")
    members = nodes.join(reps, F.col("u") == F.col("fp"))
    groups = members.groupBy("v").agg(F.min("rep").alias("component_id")).withColumnRenamed("v", "_root")
    linked = nodes.join(groups, F.col("v") == F.col("_root")).select(F.col("u").alias("_fp"), "_root", "component_id")
    # Written out, so that the join below has plain exchanges on both sides and a hot fingerprint can be split.
    group_of = reps.join(linked, F.col("fp") == F.col("_fp"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("_root", "fp").alias("root"), F.when(F.col("_root").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id")
    )
    return sketched.join(stored(group_of), F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every document."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component, with all columns; of equal rows, one.

    What goes is looked up, not what stays: the list of documents to drop is the shorter one.
    """
    found = stored(grouped(docs).select("doc_id", "mark", "root"))
    this = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    keepers = stored(found.groupBy(F.col("root").alias("_root")).agg(F.min(this).alias("_keeper"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    drop = stored(found.join(keepers, F.col("root") == F.col("_root")).where(this != F.col("_keeper")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct())
    listed = lambda rows: docs["doc_id"].eqNullSafe(rows["_id"]) & (F.xxhash64(docs["text"]) == rows["_mark"])
    kept = docs.join(drop, listed(drop), "left_anti")
    again = found.groupBy("doc_id", "mark").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    again = stored(again)
    if again.isEmpty():
        return kept
    return kept.join(again, listed(again), "left_anti").unionByName(kept.join(again, listed(again), "left_semi").dropDuplicates(["doc_id", "text"]))
