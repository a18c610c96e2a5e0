"""Fill-in-middle transformation: a text is cut at two of its line ends and written as prefix, suffix and middle.

The line ends of a slice of texts form one boundary set (``boundary_set``): array, bitmap and run containers with cumulative
cardinalities. A cut after k lines of a document is the select of its first line's rank plus k - 1, so both cuts of all
documents of a slice come from one search over the containers and a select inside each.

A text's lines are ``[^\\n]*\\n|[^\\n]+``. Four numbers h1 to h4 are the first 8-digit groups of the hex sha256 of
``<seed>:<doc_id>``: the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) lines, the middle after the larger.
h3 % 100 decides whether a text is cut at all (``rate`` percent are), h4 % 100 between the two orders (``spm`` percent):

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* plain: the text itself, if it is empty, holds one of the marks, or is not among the ``rate`` percent.

``restore`` gives the exact text back. It is exact because a cut text holds no mark, and no mark can arise across a seam:
it would have to begin inside the text and end inside a mark, but no proper beginning of a mark is followed by its rest there.

* Null text: empty, form plain. Null doc_id: the digits are empty. Rows that repeat an id are cut by the same numbers, each in
  its own text. An empty table gives an empty result. Other columns stay, those of the result's own names are replaced.
* Only the longest text bounds a task's memory: slices of 1 MB, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .boundary_set import BoundarySet

SEED = 7
RATE = 100
SPM = 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEWLINE = 0x0A


def line_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions after each line of each row: after a newline, and at the end of a row that does not end with one."""
    ends = np.flatnonzero(data == NEWLINE) + 1
    rows = offsets[1:][np.diff(offsets) > 0]
    return np.union1d(ends, rows)


def draws(ids: list, seed: int) -> np.ndarray:
    """h1 to h4 of every id, one row each."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def cuts(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each row, and where its prefix and its middle end."""
    ends = line_ends(data, offsets)
    first = np.searchsorted(ends, offsets, side="right")  # line ends up to the start of a row stand before its own
    n = np.diff(first)
    lower, upper = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
    lines = BoundarySet(ends)
    rank = np.concatenate((first[:-1] + lower, first[:-1] + upper)) - 1
    inside = np.concatenate((lower, upper)) > 0
    at = np.concatenate((offsets[:-1], offsets[:-1]))
    at[inside] = lines.select(rank[inside])
    return n, at[: len(n)], at[len(n) :]


RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Every document with its lines n, form, prefix_chars, middle_chars (null if plain) and output."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    others = [c for c in docs.columns if c.lower() not in RESULT]
    given = docs.select(*(docs[c] for c in others))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.slices(batch.column("text")):
                h = draws(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), seed)
                n, first, second = cuts(data, offsets, h)
                letters = np.concatenate(([0], np.cumsum(tb.code_points(data))))
                raw = data.tobytes()
                rows: list[tuple] = []
                for k, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), strict=True)):
                    text = raw[a:d]
                    if not text or any(x in text for x in marks) or h[k, 2] % 100 >= rate:
                        rows.append((int(n[k]), "plain", None, None, text))
                        continue
                    prefix, middle, suffix = raw[a:b], raw[b:c], raw[c:d]
                    form = "spm" if h[k, 3] % 100 < spm else "psm"
                    out = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
                    rows.append((int(n[k]), form, int(letters[b] - letters[a]), int(letters[c] - letters[b]), out))
                columns = [pa.array(list(x), pa.binary() if kind == pa.string() else kind).cast(kind) for x, kind in zip(zip(*rows, strict=True), KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in others), *columns], [*others, *RESULT])

    return given.mapInArrow(transform, f"{kinds}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text a row was made of, from its output and form alone."""
    middle = F.instr(output, MIDDLE)
    lead, back = len(PREFIX), len(MIDDLE)

    def between(begin: Column, end: Column) -> Column:
        return F.substring(output, begin, F.greatest(end - begin, F.lit(0)))

    def parts(second: str) -> tuple[Column, Column]:
        at = F.instr(output, second)
        return between(F.lit(lead + 1), at), between(at + len(second), middle)

    tail = F.substring(output, middle + back, F.length(output))
    prefix, suffix = parts(SUFFIX)
    psm = F.concat(prefix, tail, suffix)
    suffix, prefix = parts(PREFIX)
    spm = F.concat(prefix, tail, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
