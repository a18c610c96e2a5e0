"""Substring deduplication by seed and extend: words inside a 20-word sequence that also starts earlier go.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``WINDOW`` consecutive words of one document; it is a repeat if its
word sequence also starts earlier (smaller doc_id, or same document and earlier start). Windows are judged on the input.

1. Seeds: every window winnows the gram of ``GRAM`` words with the smallest hash inside it (the leftmost of equals), so equal
   windows carry the same seed at the same place. Each seed brings the hash of its surroundings, the words from the first to the
   last window that chose it.
2. Join on seeds: one shuffle brings equal seeds together, sorted by surroundings and place. A scan that keeps one row of state
   sees which places have the surroundings of an earlier one: there the match extends over the whole reach of the seed.
3. Seeds with several surroundings (a passage in different contexts: a match ends inside the reach) are extended word by word:
   every window through the first place of each surroundings is held against the other such windows, in a second scan. Equal
   windows at other places belong to matches of step 2, whose first place comes earlier, so the first places are enough.
4. Matches of a document that touch are joined to maximal repeats (``maximal_repeats``), one window long at least. They go.

No pairs are formed: every place is compared with the first place of its content. Surroundings (with their seed) and windows are
compared by 128-bit hashes. Skew: inside a slice only the first place of a content travels by its seed; the others are settled
on the spot and travel by a hash of their own, so a hot seed brings a row per slice at most.

* Null and empty texts have no words; texts below 20 words stay as they are (words joined by one space).
* Rows that repeat an id and its text are one document and get equal results. Rows that repeat an id with other texts are
  documents of their own, ordered by a hash of the text. A null id is the smallest. An empty table gives an empty result;
  other columns are not looked at.
* Very long texts are a slice of their own; memory depends on the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textbatch as tb

WINDOW = 20
GRAM = 5
SECOND = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of every word of a slice."""
    starts, ends, rows = tb.spans(data, offsets, tb.NOT_SPACE)
    return tb.span_hash(tb.prefix_hash(data), starts, ends), rows, starts, ends


def seeds(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that winnow the same gram: its hash and place, first and last start of the windows (places in ``words``)."""
    none = np.empty(0, np.int64)
    n = len(words) - WINDOW + 1
    whole = np.flatnonzero(rows[:n] == rows[WINDOW - 1 :]) if n > 0 else none
    if not len(whole):
        return none.astype(np.uint64), none, none, none
    grams = tb.window_hash(words, GRAM)
    low, place = grams[:n].copy(), np.arange(n)
    for k in range(1, WINDOW - GRAM + 1):
        smaller = grams[k : k + n] < low
        low[smaller] = grams[k : k + n][smaller]
        place[smaller] = np.flatnonzero(smaller) + k
    place = place[whole]
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(whole) != 1)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(whole)])) - 1
    return grams[place[first]], place[first], whole[first], whole[last]


def prefix_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two prefix sums over words, from which ``run_hashes`` reads a 128-bit hash of any run of words."""
    codes = tb.mixed(words), tb.mixed(words * SECOND + np.uint64(1))
    out = []
    for code in codes:
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(code * tb.powers(tb.BASE, len(words)), out=sums[1:])
        out.append(sums)
    return out[0], out[1]


def run_hashes(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray, more: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of words[start:end], with ``more`` (a place inside) mixed in."""
    back = tb.powers(tb.BASE_INVERSE, len(prefix[0]))[starts]
    extra = np.asarray((ends - starts) * 64 + more).astype(np.uint64)
    return tuple(tb.mixed((p[ends] - p[starts]) * back + extra * (np.uint64(1) + SECOND * np.uint64(k))).view(np.int64) for k, p in enumerate(prefix))


ROWS = ("sure", "h", "c", "doc_id", "_text", "first", "shape")
SURE_ROWS = "sure boolean, h long, c long, doc_id {id}, _text long, first int, shape int"


def _ranks(ids: list, marks: list) -> np.ndarray:
    """Place of each row of a slice in the order of documents; equal rows share one."""
    keys = [(i is not None, i if i is not None else 0, m) for i, m in zip(ids, marks, strict=True)]
    order = {k: n for n, k in enumerate(sorted(set(keys)))}
    return np.array([order[k] for k in keys], np.int64)


def settled(batch: pa.RecordBatch, lo: int, hi: int, rows: np.ndarray, h: np.ndarray, c: np.ndarray, first: np.ndarray, shape: np.ndarray) -> pa.RecordBatch:
    """Rows of a slice for ``judge_rows``: ``sure`` if an earlier place of the slice has the same content; equal rows once."""
    rank = _ranks(*(batch.column(n).slice(lo, hi - lo).to_pylist() for n in ("doc_id", "_text")))[rows]
    order = np.lexsort((first, rank, c, h))
    rows, h, c, first, shape, rank = (x[order] for x in (rows, h, c, first, shape, rank))
    new = np.ones(len(rows), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    place = new.copy()
    place[1:] |= (rank[1:] != rank[:-1]) | (first[1:] != first[:-1])
    rows, h, c, first, shape, sure = (x[place] for x in (rows, h, c, first, shape, ~new))
    take = pa.array(rows + lo)
    given = [batch.column(n).take(take) for n in ("doc_id", "_text")]
    return pa.RecordBatch.from_arrays([pa.array(sure), pa.array(h), pa.array(c), *given, pa.array(first.astype(np.int32)), pa.array(shape.astype(np.int32))], list(ROWS))


def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each seed: its hash, the hash of its surroundings, the first window's start, and the two lengths after it
    (32 times the further windows, plus the words up to the gram)."""
    for batch in batches:
        for lo, hi, data, offsets in tb.slices(batch.column("text")):
            words, rows, _, _ = word_hashes(data, offsets)
            h, at, first, last = seeds(words, rows)
            c, _ = run_hashes(prefix_sums(words), first, last + WINDOW, at - first)
            of = rows[at]
            yield settled(batch, lo, hi, of, h.view(np.int64), c, first - tb.bounds(rows, hi - lo)[of], 32 * (last - first) + at - first)


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window through an open seed (negative marks): both hashes, its start."""
    for batch in batches:
        listed = batch.column("marks")
        for lo, hi, data, offsets in tb.slices(batch.column("text")):
            words, rows, _, _ = word_hashes(data, offsets)
            begin = tb.bounds(rows, hi - lo)
            _, at, first, last = seeds(words, rows)
            part = listed.slice(lo, hi - lo)
            marks = part.flatten().to_numpy(zero_copy_only=False)
            base = np.repeat(begin[:-1], part.value_lengths().to_numpy(zero_copy_only=False))
            wanted = np.zeros(len(words) + 1, bool)
            wanted[(base - 1 - marks)[marks < 0]] = True
            first, last = first[wanted[at]], last[wanted[at]]
            count = last - first + 1
            starts = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            w1, w2 = run_hashes(prefix_sums(words), starts, starts + WINDOW)
            of = rows[starts]
            yield settled(batch, lo, hi, of, w1, w2, starts - begin[of], np.zeros(len(starts), np.int64))


def _changes(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Whether each row but the first differs from the one before it; nulls are equal."""
    out = np.zeros(batch.num_rows - 1, bool)
    for n in names:
        column = batch.column(n)
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        out |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out |= a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
    return out


def judge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of places, from rows sorted by h, c and place: a repeated span as start * 2**32 + stop; -1 - place of the seed if it
    is open, that is the first of its content while its seed has other contents too.

    State: the last row, whether it stands at its content's first place, and a first place whose seed has no second content yet.
    """
    tail = pending = None
    tail_first, tail_h = True, None

    def marked(rows: pa.RecordBatch, marks: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("_text"), pa.array(marks, pa.int64())], ["doc_id", "_text", "mark"])

    def spans(rows: pa.RecordBatch) -> pa.RecordBatch:
        first, shape = (rows.column(n).to_numpy().astype(np.int64) for n in ("first", "shape"))
        return marked(rows, (first << 32) + first + shape // 32 + WINDOW)

    def opened(rows: pa.RecordBatch) -> pa.RecordBatch:
        return marked(rows, -1 - (rows.column("first").to_numpy().astype(np.int64) + rows.column("shape").to_numpy() % 32))

    for batch in batches:
        sure = batch.column("sure")
        if pc.any(sure).as_py():
            yield spans(batch.filter(sure))
            batch = batch.filter(pc.invert(sure))
        if not batch.num_rows:
            continue
        joined = pa.concat_batches([tail, batch]) if tail is not None else batch
        skip = 1 if tail is not None else 0
        new = np.concatenate(([not skip], _changes(joined, ("h", "c"))))
        moved = new | np.concatenate(([False], _changes(joined, ("doc_id", "_text", "first"))))
        # At the first place of its content: no move since the content began.
        begun = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        moves = np.cumsum(moved & ~new)
        at_first = moves == moves[begun]
        if skip and not tail_first:
            at_first &= begun > 0
        yield spans(joined.filter(pa.array(~at_first & (np.arange(len(new)) >= skip))))
        leaders = joined.filter(pa.array(new))
        if leaders.num_rows:
            h = leaders.column("h").to_numpy()
            before = np.concatenate(([tail_h is not None and h[0] == tail_h], h[1:] == h[:-1]))
            after = np.concatenate((h[1:] == h[:-1], [False]))
            if before[0] and pending is not None:
                yield opened(pending)
            yield opened(leaders.filter(pa.array(before | after)))
            pending = None if before[-1] else leaders.slice(leaders.num_rows - 1)
            tail_h = h[-1]
        tail, tail_first = joined.slice(joined.num_rows - 1), bool(at_first[-1])


def judged(rows: DataFrame, kind: str) -> DataFrame:
    """Equal contents side by side: by seed, but for rows that are settled."""
    dealt = rows.repartition(F.when(F.col("sure"), F.xxhash64("c", "doc_id", "first")).otherwise(F.col("h")))
    return dealt.sortWithinPartitions("h", "c", "doc_id", "_text", "first").mapInArrow(judge_rows, f"doc_id {kind}, _text long, mark long")


def by_document(marks: DataFrame, name: str) -> DataFrame:
    """Marks of each document, under names that don't clash in a join."""
    return marks.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_mark")).agg(F.collect_set("mark").alias(name))


def same_document(df: DataFrame, other: DataFrame):
    return df["doc_id"].eqNullSafe(other["_id"]) & (df["_text"] == other["_mark"])


def keyed(docs: DataFrame) -> DataFrame:
    return tb.texts(docs).withColumn("_text", F.xxhash64("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the text), text and marks (start * 2**32 + stop of repeated spans of words, perhaps none) of the
    documents that may hold repeats."""
    given = keyed(docs)
    kind = given.schema["doc_id"].dataType.simpleString()
    rows = SURE_ROWS.format(id=kind)
    found = by_document(judged(given.mapInArrow(seed_rows, rows), kind), "marks")
    holders = stored(given.join(found, same_document(given, found)).select("doc_id", "_text", "text", "marks"), compression="zstd")
    is_open = F.exists("marks", lambda m: m < 0)
    partly = holders.where(is_open)
    windows = partly.mapInArrow(window_rows, rows)
    met = by_document(judged(windows, kind).where("mark >= 0"), "more")
    partly = partly.join(met, same_document(partly, met), "left")
    partly = partly.select("doc_id", "_text", "text", F.concat("marks", F.coalesce("more", F.array().cast("array<long>"))).alias("marks"))
    both = holders.where(~is_open).unionByName(partly)
    return both.withColumn("marks", F.filter("marks", lambda m: m >= 0))


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop (words) of the maximal repeated spans; rows that repeat an id and text give theirs once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, marks in enumerate(batch.column("marks").to_pylist()):
                reach = -1
                for start, stop in sorted((m >> 32, m & (2**32 - 1)) for m in marks):
                    if start > reach:
                        out.append([row, start, stop])
                    reach = out[-1][2] = max(out[-1][2], stop)
            columns = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(columns[0]), *columns[1:]], ["doc_id", "start", "stop"])

    found = repeats(docs).select("doc_id", "_text", F.array_sort("marks").alias("marks")).dropDuplicates(["doc_id", "_text"])
    return found.mapInArrow(joined, f"doc_id {kind}, start long, stop long")


def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, removed words and the digest of the kept words of every document."""
    for batch in batches:
        listed = batch.column("marks")
        for lo, hi, data, offsets in tb.slices(batch.column("text")):
            starts, ends, rows = tb.spans(data, offsets, tb.NOT_SPACE)
            begin = tb.bounds(rows, hi - lo)
            part = listed.slice(lo, hi - lo)
            marks = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            base = np.repeat(begin[:-1], part.value_lengths().to_numpy(zero_copy_only=False))
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, base + (marks >> 32), 1)
            np.add.at(edge, base + (marks & (2**32 - 1)), -1)
            kept = np.cumsum(edge[:-1]) <= 0
            left = tb.row_sums(kept, rows, hi - lo)
            raw, digests = data.tobytes(), []
            a, z, flag = starts.tolist(), ends.tolist(), kept.tolist()
            for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                digests.append(hashlib.sha256(b" ".join([raw[a[i] : z[i]] for i in range(x, y) if flag[i]])).hexdigest())
            n = np.diff(begin)
            given = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "_text")]
            yield pa.RecordBatch.from_arrays([*given, pa.array(n), pa.array(n - left), pa.array(digests)], ["doc_id", "_text", "n_words", "n_removed", "kept_sha256"])


def seed_extend_dedup(docs: DataFrame) -> DataFrame:
    """Per document: words, words removed, digest of the kept words joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _text long, n_words long, n_removed long, kept_sha256 string"
    changed = repeats(docs).mapInArrow(kept_rows, schema).dropDuplicates(["doc_id", "_text"])
    changed = changed.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_mark"), F.col("n_removed").alias("_gone"), F.col("kept_sha256").alias("_kept"))
    whole = keyed(docs).withColumn("marks", F.array().cast("array<long>")).mapInArrow(kept_rows, schema)
    out = whole.join(changed, same_document(whole, changed), "left")
    return out.select("doc_id", "n_words", F.coalesce("_gone", "n_removed").alias("n_removed"), F.coalesce("_kept", "kept_sha256").alias("kept_sha256"))
