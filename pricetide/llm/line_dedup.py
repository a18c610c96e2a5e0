"""Line deduplication across documents.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. Keys of at least 20 code points
found in at least three documents lose all their lines except in the document with the largest doc_id that holds them.

One row per (key hash, document) goes through a range partitioning by hash and document, sorted inside each partition by
hash and descending document; a scan keeps the first document of each key and tells the others what they lose. Ranges cut
through keys, so a key that a third of all documents share is spread over many tasks: the first and last key of each
range are left open and settled afterwards from one summary row for each range. What travels back is one packed bitmap of
kept lines per document, not text.

* Keys are compared by 128-bit hash.
* Null and empty texts are one empty line; nothing is dropped from them.
* Rows that repeat a doc_id and its text count as one document and get equal results; rows that repeat an id with other
  texts count as one document too (all or none of them keep a line), each with its own bitmap. A null id is the smallest.
* An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textbatch as tb

MIN_CHARS = 20
MIN_DOCUMENTS = 3
STRIP = b" \t\n\x0b\x0c\r"
LOWER = bytes(tb.LOWER)


def keyed_lines(docs: DataFrame) -> DataFrame:
    """One row per document and distinct key: two hash halves, doc_id, text hash, number of lines, positions of the key."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist()
            for lo, hi, data, offsets in tb.slices(batch.column("text")):
                raw = data.tobytes()
                out: dict[str, list] = {c: [] for c in ("h1", "h2", "doc_id", "_text", "at")}
                for row in range(hi - lo):
                    seen: dict[bytes, list[int]] = {}
                    for k, line in enumerate(raw[offsets[row] : offsets[row + 1]].split(b"\n")):
                        if len(line) < MIN_CHARS:
                            continue
                        key = line.strip(STRIP).translate(LOWER)
                        if len(key) >= MIN_CHARS and (key.isascii() or len(key.decode()) >= MIN_CHARS):
                            seen.setdefault(xxhash.xxh3_128_digest(key), []).append(k)
                    out["h1"].extend(int.from_bytes(h[:8], "big", signed=True) for h in seen)
                    out["h2"].extend(int.from_bytes(h[8:], "big", signed=True) for h in seen)
                    out["doc_id"].extend([ids[lo + row]] * len(seen))
                    out["_text"].extend([marks[lo + row]] * len(seen))
                    out["at"].extend(seen.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["h1"], pa.int64()), pa.array(out["h2"], pa.int64()), pa.array(out["doc_id"], batch.schema.field("doc_id").type), pa.array(out["_text"], pa.int64()), pa.array(out["at"], pa.list_(pa.int32()))], list(out)
                )

    return docs.mapInArrow(cut, f"h1 long, h2 long, doc_id {kind}, _text long, at array<int>")


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows one sorted range and returns the rows that lose their lines (docs 0).

    Of the range's first key all rows are returned, and of its last key the first document's rows and those not settled, for
    the ranges may share them (docs: how many documents the row stands for at least). State: one key's first two documents.
    """
    key = first = last_doc = None
    docs, held, pending, out, kinds = 0, [], [], [], []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(FOUND)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], list(FOUND))

    for batch in batches:
        kinds = [*(batch.schema.field(n).type for n in FOUND[:-1]), pa.int64()]
        for row in zip(*(batch.column(n).to_pylist() for n in FOUND[:-1]), strict=True):
            if row[:2] != key:
                key = row[:2]
                first = first or key
                docs, last_doc, held, pending = 1, row[2], [], []
            elif row[2] != last_doc:
                docs, last_doc = docs + 1, row[2]
            if key == first:
                out.append((*row, 1))
            elif docs == 1:
                held.append(row)
            elif docs < MIN_DOCUMENTS:
                pending.append(row)
            else:
                out.extend((*r, 0) for r in (*pending, row))
                pending = []
        if len(out) > 20_000:
            yield flush()
    if kinds:
        if key != first:
            out.extend((*r, docs) for r in held)
            out.extend((*r, 1) for r in pending)
        yield flush()


FOUND = ("h1", "h2", "doc_id", "_text", "at", "docs")


def losses(docs: DataFrame) -> DataFrame:
    """doc_id, text hash and positions of the lines that go; ``docs`` has doc_id, text and _text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = stored(keyed_lines(docs))  # the range partitioning reads its input twice
    ranged = lines.repartitionByRange("h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "_text")
    found = stored(ranged.mapInArrow(scan, f"h1 long, h2 long, doc_id {kind}, _text long, at array<int>, docs long"))
    shared = found.where("docs > 0")
    # At most two keys for each range, so the summary is as small as the number of partitions.
    keys = shared.groupBy("h1", "h2").agg(F.count_distinct(F.struct("doc_id")).alias("_n"), F.max("docs").alias("_most"), F.max("doc_id").alias("_keeper"))
    keys = keys.where(F.greatest("_n", "_most") >= MIN_DOCUMENTS).drop("_n", "_most")
    late = shared.join(F.broadcast(keys), ["h1", "h2"]).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("_keeper")))
    return found.where("docs = 0").select("doc_id", "_text", "at").unionByName(late.select("doc_id", "_text", "at"))


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """For each document that loses lines: doc_id, text hash and the packed bitmap of kept lines (lines past its end stay)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for at in batch.column("at").to_pylist():
                keep = np.ones(-(-(max(at) + 1) // 8) * 8, bool)
                keep[at] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text"), pa.array(maps, pa.binary())], ["doc_id", "_text", "keep"])

    per_doc = losses(docs).groupBy("doc_id", "_text").agg(F.flatten(F.collect_set("at")).alias("at"))
    return per_doc.mapInArrow(pack, f"doc_id {kind}, _text long, keep binary")


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[int, list[str]]:
    """Number of lines, and those that stay."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return len(lines), [line for k, line in enumerate(lines) if k >= len(keep) or keep[k]]


def with_bitmaps(docs: DataFrame, keep: str) -> DataFrame:
    """Documents with their bitmap in the column ``keep``, null where every line stays."""
    mark, row_id = tb.fresh(docs, "_mark"), tb.fresh(docs, "_id")
    maps = keep_bitmaps(docs.select("doc_id", "text", F.xxhash64("text").alias("_text")))
    maps = maps.select(F.col("doc_id").alias(row_id), F.col("_text").alias(mark), F.col("keep").alias(keep))
    return docs.join(maps, docs["doc_id"].eqNullSafe(maps[row_id]) & (F.xxhash64(docs["text"]) == maps[mark]), "left").drop(row_id, mark)


def line_dedup(docs: DataFrame) -> DataFrame:
    """Per document: number of lines, number dropped, digest of what stays, and the packed bitmap of kept lines."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, dropped, digests = [], [], []
            for text, keep in zip(batch.column("text"), batch.column("keep"), strict=True):
                n, lines = kept_lines(text.as_py(), keep.as_py())
                counts.append(n)
                dropped.append(n - len(lines))
                digests.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string()), batch.column("keep")],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_bitmaps(tb.texts(docs), "keep").mapInArrow(apply, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string, keep binary")


def drop_lines(docs: DataFrame) -> DataFrame:
    """Documents with the repeated lines gone from their text (n_chars follows); all columns and rows stay."""
    schema, bitmap = docs.schema, tb.fresh(docs, "keep")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, keep in zip(batch.column("text"), batch.column(bitmap), strict=True):
                texts.append(text.as_py() if keep.as_py() is None else "\n".join(kept_lines(text.as_py(), keep.as_py())[1]))
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select(schema.names)

    out = with_bitmaps(docs, bitmap).mapInArrow(apply, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out
