"""Exact substring deduplication: every byte covered by a 400-byte string that also starts anywhere else goes.

Texts are UTF-8 bytes; strings do not cross documents, may overlap, and are judged on the input. Passages of some 50 words are
often a little shorter than that: bytes covered by a 256-byte string that also starts anywhere else are counted beside, and stay.

1. Each window of 256 bytes picks an anchor: the 64-byte gram with the smallest hash inside it (the leftmost of equals).
   Equal windows pick the same gram at the same place, so a window whose anchor's hash is unique has no equal.
2. Windows with repeated anchors are dealt to shards, with the bytes up to the end of the 400-byte string that begins with each. All anchors whose first holder is the same document form one group, so
   copies of a document meet as whole segments and not as many overlapping pieces; a position is in a shard once. Segments
   equal in all bytes enter a shard twice at most, which is all that is needed to see that they repeat.
3. A task sorts the suffixes of some megabytes of groups by induced sorting and computes permuted common prefixes
   (``suffix_array``); places with a neighbour that shares 256 or 400 bytes are repeats of that length.
4. Groups with more than ``GROUP_BYTES`` of segments, copies counted twice at most (a hot passage with many surroundings), never meet in one task:
   the different pieces around their anchors are cut into windows, which are counted by 128-bit hash over all tasks.
5. Repeats travel back to documents as runs of positions.

* Null and empty texts have 0 bytes. Texts below 400 bytes stay as they are.
* Rows that repeat a doc_id and its text are copies of each other: one of them goes through the steps above, and all of them lose
  the whole text if it is long enough. Rows that repeat an id with another text are documents of their own. A null id is an id. An empty table gives an empty result; other columns are not looked at.
* Texts longer than a slice are worked off in slices that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textbatch as tb
from .suffix_array import repeats, suffix_array

LENGTH = 400
SHORT = 256
GRAM = 64
CHUNK = 1 << 20
GROUP_BYTES = 4 << 20
BLOCK_BYTES = 2 << 20
PLACE_BITS = 28


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts of windows of ``length`` bytes that share an anchor: row, hash of the anchor's gram, its place, first and last start."""
    n, width = len(data), length - GRAM + 1
    size = np.diff(offsets)
    none = np.empty(0, np.int64)
    if not (size >= length).any():
        return none, none.astype(np.uint64), none, none, none
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(n) - offsets[row]
    prefix = tb.prefix_hash(data)
    back = tb.powers(tb.BASE_INVERSE, n + 1)
    gram = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    hashes = tb.mixed((prefix[GRAM:] - prefix[:-GRAM]) * back[: n + 1 - GRAM])
    gram[: n + 1 - GRAM] = (hashes >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | (place[: n + 1 - GRAM] & ((1 << PLACE_BITS) - 1)).astype(np.uint64)
    gram[place > size[row] - GRAM] = np.iinfo(np.uint64).max
    whole = -(-n // width) * width
    padded = np.full(whole + width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = gram
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[:n], left[width - 1 : width - 1 + n])
    starts = np.flatnonzero(place <= size[row] - length)
    low, rows = low[starts], row[starts]
    cut = np.flatnonzero((low[1:] != low[:-1]) | (rows[1:] != rows[:-1])) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(starts)])) - 1
    rows = rows[first]
    at = (low[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    return rows, hashes[offsets[rows] + at], at, place[starts[first]], place[starts[last]]


def long_rows(array: pa.Array, length: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the slice in it, bytes, offsets): slices of rows; a longer row in overlapping parts."""
    for lo, _, data, offsets in tb.slices(array, CHUNK):
        if len(offsets) > 2 or len(data) <= 2 * CHUNK:
            yield lo, 0, data, offsets
            continue
        for at in range(0, len(data) - length + 1, CHUNK):
            part = data[at : at + CHUNK + length - 1]
            yield lo, at, part, np.array([0, len(part)])


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, at, data, offsets in long_rows(batch.column("text"), SHORT):
            rows, h, _, first, last = anchors(data, offsets, SHORT)
            take = pa.array(rows + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("_text").take(take), pa.array(h.view(np.int64)), pa.array((first + at).astype(np.int32)), pa.array((last + at).astype(np.int32))],
                ["doc_id", "_text", "h", "first", "last"],
            )


def split_id(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


UNIT = ("g", "u1", "u2", "start", "own", "bytes")
GIVEN = ("doc_id", "_text", "_row")


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of a document by group ``g``: its windows' bytes, merged where they overlap if ``merge`` is set.

    ``own`` counts the starts that belong to a unit; the bytes after them only complete longer strings. Bytes come along for a unit's first two occurrences in a task.
    """
    seen: Counter[tuple[int, int]] = Counter()
    for batch in batches:
        out: dict[str, list] = {c: [] for c in UNIT}
        rows: list[int] = []

        def flush(batch=batch) -> pa.RecordBatch:
            take = pa.array(rows, pa.int64())
            given = [batch.column(c).take(take) for c in GIVEN]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            done = pa.RecordBatch.from_arrays([*given, *(pa.array(out[c], k) for c, k in zip(UNIT, kinds, strict=True))], [*GIVEN, *UNIT])
            rows.clear()
            for c in UNIT:
                out[c].clear()
            return done

        size = 0
        for row, (text, found, merge) in enumerate(zip(batch.column("text"), batch.column("anchors"), batch.column("merge").to_pylist(), strict=True)):
            raw = text.as_py().encode()
            spots: dict[int, list[tuple[int, int, int]]] = {}
            for a in found.as_py():
                spots.setdefault(a["g"], []).append((a["first"], min(a["last"] + LENGTH, len(raw)), a["last"] + 1))
            for g, parts in spots.items():
                merged: list[list[int]] = []
                for first, end, stop in sorted(set(parts)):
                    if merge and merged and first <= merged[-1][1]:
                        merged[-1][1:] = max(merged[-1][1], end), max(merged[-1][2], stop)
                    else:
                        merged.append([first, end, stop])
                for first, end, stop in merged:
                    content = raw[first:end]
                    unit = split_id(xxhash.xxh3_128_digest(content, seed=g & (2**64 - 1)))
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[unit] += 1
                    send = content if seen[unit] <= 2 else None
                    size += len(send or b"")
                    rows.append(row)
                    for c, v in zip(UNIT, (g, *unit, first, stop - first, send), strict=True):
                        out[c].append(v)
            if size > CHUNK:
                yield flush()
                size = 0
        yield flush()


def flat_runs(flag: np.ndarray) -> list[int]:
    """Start and end of each run of set flags, one after another."""
    return np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).astype(np.int8))).tolist()


def repeats_in(units: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, list[int], list[int]]]:
    """(unit, runs of starts of 400 and of 256 bytes that repeat inside the shard); units: two halves of the id, row and place, bytes.

    A unit may be given twice, from different rows. Segments of several groups may overlap; the row and place of a byte tell
    that it is the same one.
    """
    sizes = np.array([len(u[4]) for u in units])
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(int(sizes.sum() + len(units)) + 1, np.uint16)
    raw = np.frombuffer(b"\0".join(u[4] for u in units), np.uint8)
    text[: len(raw)] = raw.astype(np.uint16) + 2
    text[starts + sizes] = 1
    text[-1] = 0
    place = np.arange(len(text), dtype=np.uint64)
    for (_, _, row, start, content), at in zip(units, starts.tolist(), strict=True):
        where = np.uint64(tb.mixed(np.array([row], np.int64).view(np.uint64))[0])
        place[at : at + len(content)] = where + np.arange(start, start + len(content), dtype=np.uint64)
    sa = suffix_array(text, LENGTH)
    flags = [(size, repeats(text, sa, size, place)) for size in (LENGTH, SHORT)]
    out, done = [], set()
    for (u1, u2, _, _, content), at in zip(units, starts.tolist(), strict=True):
        if (u1, u2) not in done:
            done.add((u1, u2))
            runs, short = (flat_runs(flag[at : at + max(0, len(content) - size + 1)]) for size, flag in flags)
            if short:
                out.append((u1, u2, runs, short))
    return out


RUN_NAMES = ["u1", "u2", "runs", "short"]
RUN_KINDS = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
RUN_SCHEMA = "u1 long, u2 long, runs array<int>, short array<int>"


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Works off rows sorted by group and unit in blocks of whole groups."""
    block: list[tuple[int, int, int, int, bytes]] = []
    group: list[tuple[int, int, int, int, bytes]] = []
    size, group_size, current, copies, last = 0, 0, None, 0, None

    def work() -> pa.RecordBatch:
        found = repeats_in(block)
        block.clear()
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(RUN_KINDS)], RUN_NAMES)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal size, group_size
        if block and size + group_size > BLOCK_BYTES:
            yield work()
            size = 0
        block.extend(group)
        size += group_size
        group.clear()
        group_size = 0

    for batch in batches:
        for g, u1, u2, row, start, content in zip(*(batch.column(c).to_pylist() for c in ("g", "u1", "u2", "_row", "start")), batch.column("bytes"), strict=True):
            if g != current:
                yield from close()
            copies = copies + 1 if (g, u1, u2) == last else 1
            current, last = g, (g, u1, u2)
            if copies <= 2:
                group.append((u1, u2, row, start, content.as_py()))
                group_size += len(group[-1][4])
    yield from close()
    if block:
        yield work()


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each string of 400 and of 256 bytes that begins at an own start of a piece: 128-bit hash, piece, place, length."""
    for batch in batches:
        for u1, u2, own, content in zip(*(batch.column(c).to_pylist() for c in ("u1", "u2", "own")), batch.column("bytes"), strict=True):
            raw = content.as_py()
            for size in (LENGTH, SHORT):
                n = min(own, len(raw) - size + 1)
                if n <= 0:
                    continue
                hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[p : p + size], seed=size) for p in range(n)), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(np.full(n, u1)), pa.array(np.full(n, u2)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, size, np.int32))],
                    ["w1", "w2", "u1", "u2", "at", "size"],
                )


def place_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def runs(places: list[int]) -> list[int]:
        flag = np.zeros(max(places, default=-1) + 1, bool)
        flag[places] = True
        return flat_runs(flag)

    for batch in batches:
        found = [[runs(x) for x in batch.column(c).to_pylist()] for c in ("places", "short_places")]
        yield pa.RecordBatch.from_arrays([batch.column("u1"), batch.column("u2"), *(pa.array(x, pa.list_(pa.int32())) for x in found)], RUN_NAMES)


def covered(n: int, marks: list[tuple[int, list[int]]], length: int) -> np.ndarray:
    """Flags the bytes of a text of ``n`` inside strings of ``length``; marks: place of a unit and its runs of starts."""
    edge = np.zeros(n + 1, np.int64)
    for start, runs in marks:
        pair = np.array(runs, np.int64).reshape(-1, 2) + start
        np.add.at(edge, pair[:, 0], 1)
        np.add.at(edge, pair[:, 1] - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def kept_bytes(raw: bytes, marks: list[tuple[int, list[int]]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what stays); marks: place of a unit and its runs of repeated window starts."""
    gone = covered(len(raw), marks, LENGTH)
    return int(gone.sum()), len(flat_runs(gone)) // 2, np.frombuffer(raw, np.uint8)[~gone].tobytes()


CHANGED = "n_removed long, n_spans long, kept_sha256 string, n_repeated long"


def result_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = []
        for text, marks in zip(batch.column("text"), batch.column("marks"), strict=True):
            raw, marks = text.as_py().encode(), marks.as_py()
            removed, spans, kept = kept_bytes(raw, [(m["start"], m["runs"]) for m in marks])
            got.append((removed, spans, hashlib.sha256(kept).hexdigest(), int(covered(len(raw), [(m["start"], m["short"]) for m in marks], SHORT).sum())))
        columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text"), *columns], ["doc_id", "_text", "n_removed", "n_spans", "kept_sha256", "n_repeated"])


def same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["_id"]) & (a["_text"] == b["_mark"])


def renamed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("doc_id", "_id").withColumnRenamed("_text", "_mark")


def heavy_groups(given: DataFrame) -> DataFrame:
    """Groups whose segments, each as often as it enters a shard (twice at most), exceed ``GROUP_BYTES``; tasks may send more copies."""
    each = given.groupBy("g", "u1", "u2").agg((F.least(F.count("*"), F.lit(2)) * F.first(F.length("bytes"))).alias("_size"))
    return each.groupBy(F.col("g").alias("_g")).agg(F.sum("_size").alias("_size")).where(F.col("_size") > GROUP_BYTES).drop("_size")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Documents that hold repeated windows: doc_id, _text (hash), text, marks (place of a unit, runs of starts in it)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = tb.texts(docs).withColumn("_text", F.xxhash64("text"))
    anchored = stored(keyed.mapInArrow(anchor_rows, f"doc_id {kind}, _text long, h long, first int, last int"))
    # A hash's group is its smallest holder; the anchors of one document at most share a group, whatever the number of copies.
    counts = anchored.groupBy("h").agg(F.count("*").alias("_n"), F.min(F.xxhash64("doc_id", "_text")).alias("key")).where("_n > 1").drop("_n")
    flagged = anchored.join(stored(counts), "h").groupBy("doc_id", "_text").agg(F.collect_set(F.struct("first", "last", F.col("key").alias("g"), "h")).alias("anchors"))
    flagged = renamed(flagged)
    # Equal rows with one id stand for each other from here on: one of them goes through the shards.
    once = keyed.join(flagged, same_row(keyed, flagged)).select("doc_id", "_text", "text", "anchors").dropDuplicates(["doc_id", "_text"])
    holders = stored(once.withColumn("_row", F.monotonically_increasing_id()))

    schema = f"doc_id {kind}, _text long, _row long, g long, u1 long, u2 long, start int, own int, bytes binary"
    units = stored(holders.withColumn("merge", F.lit(True)).mapInArrow(unit_rows, schema))
    given = units.where("bytes IS NOT NULL")
    heavy = stored(heavy_groups(given))
    crowded = not heavy.isEmpty()
    light = given.join(heavy, F.col("g") == F.col("_g"), "left_anti") if crowded else given
    light = light.select("g", "u1", "u2", "_row", "start", "bytes").repartition("g").sortWithinPartitions("g", "u1", "u2")
    found = light.mapInArrow(shard_rows, RUN_SCHEMA)
    if crowded:
        each = holders.select("_row", F.explode("anchors").alias("a")).select("_row", "a.*").join(heavy, F.col("g") == F.col("_g"))
        each = each.groupBy(F.col("_row").alias("_r")).agg(F.collect_list(F.struct("first", "last", F.col("h").alias("g"))).alias("anchors"))
        cut = holders.drop("anchors").join(each, F.col("_row") == F.col("_r")).drop("_r").withColumn("merge", F.lit(False))
        pieces = stored(cut.mapInArrow(unit_rows, schema))
        units = units.unionByName(pieces)
        windows = pieces.where("bytes IS NOT NULL").select("u1", "u2", "own", "bytes").mapInArrow(window_rows, "w1 long, w2 long, u1 long, u2 long, at int, size int")
        twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        sets = [F.collect_set(F.when(F.col("size") == n, F.col("at"))).alias(c) for n, c in ((LENGTH, "places"), (SHORT, "short_places"))]
        places = windows.join(twice, ["w1", "w2"]).groupBy("u1", "u2").agg(*sets)
        found = found.unionByName(places.mapInArrow(place_runs, RUN_SCHEMA))
    found = stored(found)

    members = units.select("doc_id", "_text", "u1", "u2", "start").distinct()
    marks = members.join(found, ["u1", "u2"]).groupBy("doc_id", "_text").agg(F.collect_list(F.struct("start", "runs", "short")).alias("marks"))
    marks = renamed(marks)
    return holders.join(marks, same_row(holders, marks)).select("doc_id", "_text", "text", "marks")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, digest of the remaining bytes, bytes in repeats of 256 bytes or more."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    changed = renamed(repeated_windows(docs).mapInArrow(result_rows, f"doc_id {kind}, _text long, {CHANGED}"))
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("_whole"))
    out = base.join(changed, same_row(base, changed), "left").drop("_id", "_mark")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text")).groupBy("doc_id", "_text").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = renamed(rows)
    out = out.join(rows, same_row(out, rows), "left")

    def either(length: int, whole, part):
        """Rows that other rows equal lose or count all of a text that is long enough."""
        return F.when((F.col("_n") > 1) & (F.col("n_bytes") >= length), whole).otherwise(part)

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        either(LENGTH, F.col("n_bytes"), F.coalesce("n_removed", zero)).alias("n_removed"),
        either(LENGTH, one, F.coalesce("n_spans", zero)).alias("n_spans"),
        either(LENGTH, F.sha2(F.lit(""), 256), F.coalesce("kept_sha256", "_whole")).alias("kept_sha256"),
        either(SHORT, F.col("n_bytes"), F.coalesce("n_repeated", zero)).alias("n_repeated"),
    )
