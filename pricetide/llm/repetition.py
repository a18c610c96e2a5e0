"""Quality rules on repetition: which share of a text's characters lies inside repeated n-grams and lines.

Rolling hashes of word n-grams of several lengths are compared inside each document, in numpy over Arrow batches; no
shuffle. Words are runs of anything but ``[\\x20\\x09-\\x0D]``; null and empty texts have none and fail the base rule.

``kept`` is the base rule (at least ten words, at most a fifth of them inside repeated five-word windows) and then the
coverage rules: characters inside n-grams found twice or more (first included) and inside lines equal to an earlier line,
each as a share of the characters in words, may not exceed ``MAX_COVERAGE`` and ``MAX_LINE_COVERAGE``. A line or sentence
that a short text says twice stays below them. A text whose repeated five-word windows form ``MANY_RUNS`` runs or more
repeats several passages, or one more than twice: ``MANY_COVERAGE``, below the base rule, holds for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb

BASE_WINDOW = 5
MIN_WORDS = 10
# Highest share of characters inside repeated n-grams of so many words.
MAX_COVERAGE = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
MAX_LINE_COVERAGE = 0.20
# The same for texts of so many repeated runs. One passage said twice makes two runs.
MANY_RUNS = 3
MANY_COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LINE = np.ones(256, bool)
LINE[0x0A] = False

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (*(f"coverage_{n}" for n in MAX_COVERAGE), "line_coverage")
SCHEMA = "doc_id {id}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in SHARES) + ", n_repeat_runs long"


def repeated(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Flags entries whose (row, value) occurs twice or more."""
    if not len(values):
        return np.empty(0, bool)
    key = tb.mixed(values ^ tb.mixed(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    line = key[order]
    same = line[1:] == line[:-1]
    flag = np.zeros(len(values), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def later(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Flags entries whose (row, value) occurred before."""
    if not len(values):
        return np.empty(0, bool)
    key = tb.mixed(values ^ tb.mixed(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    flag = np.zeros(len(values), bool)
    flag[order[1:][key[order][1:] == key[order][:-1]]] = True
    return flag


def covered(words: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Flags words inside a window of ``size`` words that its document holds twice or more."""
    mark = np.zeros(len(words) + 1, np.int64)
    if len(words) >= size:
        whole = np.flatnonzero(rows[: len(words) - size + 1] == rows[size - 1 :])
        at = whole[repeated(tb.window_hash(words, size)[whole], rows[whole])]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + size, -1)
    return np.cumsum(mark[:-1]) > 0


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and shares of each document of a slice."""
    n = len(offsets) - 1
    prefix = tb.prefix_hash(data)
    starts, ends, rows = tb.spans(data, offsets, tb.NOT_SPACE)
    words = tb.span_hash(prefix, starts, ends)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(tb.code_points(data), out=letters[1:])
    chars = letters[ends] - letters[starts]
    out = {"n_words": np.diff(tb.bounds(rows, n)), "word_chars": tb.row_sums(chars, rows, n)}
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOL[data], out=symbols[1:])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    l_starts, l_ends, l_rows = tb.spans(data, offsets, LINE)
    inside = np.zeros(len(words) + 1, np.int64)
    np.cumsum(chars, out=inside[1:])
    a, b = np.searchsorted(starts, l_starts), np.searchsorted(starts, l_ends)
    full = b > a
    l_starts, l_ends, l_rows, l_chars = l_starts[full], l_ends[full], l_rows[full], (inside[b] - inside[a])[full]
    again = later(tb.span_hash(prefix, l_starts, l_ends), l_rows)
    out["n_dup_lines"] = tb.row_sums(again, l_rows, n)
    of = np.maximum(out["word_chars"], 1)
    shares = {"line_coverage": tb.row_sums(l_chars * again, l_rows, n) / of}
    for size in sorted({BASE_WINDOW, *MAX_COVERAGE}):
        hit = covered(words, rows, size)
        if size == BASE_WINDOW:
            out["n_repeat_words"] = tb.row_sums(hit, rows, n)
            begins = hit.copy()
            begins[1:] &= ~hit[:-1] | (rows[1:] != rows[:-1])
            runs = tb.row_sums(begins, rows, n)
        if size in MAX_COVERAGE:
            shares[f"coverage_{size}"] = tb.row_sums(chars * hit, rows, n) / of
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    good = ~out["base_failed"] & (shares["line_coverage"] <= MAX_LINE_COVERAGE)
    for size, most in MAX_COVERAGE.items():
        good &= shares[f"coverage_{size}"] <= np.where(runs >= MANY_RUNS, MANY_COVERAGE[size], most)
    return out | {"kept": good} | shares | {"n_repeat_runs": runs}


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, coverage shares and verdict."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.slices(batch.column("text")):
                got = measures(data, offsets)
                kinds = [pa.int64()] * len(COUNTS) + [pa.bool_()] * 2 + [pa.float64()] * len(SHARES) + [pa.int64()]
                names = (*COUNTS, "base_failed", "kept", *SHARES, "n_repeat_runs")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(got[c], k) for c, k in zip(names, kinds, strict=True))], ["doc_id", *names]
                )

    return tb.texts(docs).mapInArrow(judge, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))
