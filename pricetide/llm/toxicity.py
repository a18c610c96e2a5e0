"""Toxicity from class-conditional Kneser-Ney models of the letters in words.

A word is a run of letters (a-z after lower-casing A-Z, and everything beyond ASCII); its model predicts each byte, the end
included, from the five before it, blanks standing before the word. Three levels of Kneser-Ney counts over *all* documents
(raw counts at the top, numbers of different continuations below) give the shared model; a toxic and an ordinary model put
their own discounted counts on top and back off to the shared one, so expressions that a class has hardly seen say little.
A text is judged by the log-likelihood ratio of its most telling word, by that ratio per letter, and by the ratio of the
whole text per letter; a logistic curve fitted on labelled rows that gave no counts turns the three into a score.

* Labels are learned from rows whose crc32(doc_id) mod 5 is not 0: about ``SAMPLE`` of each class, by a hash of the id (all
  if there are fewer). The sample is broadcast; its bound is the parameter. Remainder 1 fits the curve, the others count.
  Rows of ``labels`` that repeat an id count once (toxic if any of them is); null ids and null labels are left out.
* The shared counts cover every document, labelled or not, held out or not; they carry no labels.
* The ratio of each six bytes goes into ``1 << SLOTS`` slots, so what is broadcast has one size for every corpus; six-byte
  strings that share a slot share their weighted mean.
* Null and empty texts, and texts without letters, have ratios of 0 and get the curve's value there. If either class is
  missing, every score is the share of toxic labels (0 without labels).
* Whole texts count. Repeated rows are scored alike; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textbatch as tb
from .language_id import LETTERS

SAMPLE = 20_000
SLOTS = 21
DISCOUNT = 0.75
CLASS_DISCOUNT = 2.0
BACKOFF = 5.0
ORDER = 6

IN_WORD = LETTERS != 0x20


def remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5


def letter_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(six-byte strings as numbers, where each word's begin, row of each word); one string per letter and one per word end."""
    text = LETTERS[data]
    starts, ends, rows = tb.spans(data, offsets, IN_WORD)
    length = ends - starts + 1
    first = np.cumsum(length) - length
    total = int(length.sum())
    at = np.arange(total) - np.repeat(first, length)
    joined = np.full(total, 0x20, np.uint8)
    letter = np.ones(total, bool)
    letter[first + length - 1] = False
    joined[letter] = text[(np.repeat(starts, length) + at)[letter]]
    value = np.zeros(total, np.int64)
    for back in range(ORDER - 1, -1, -1):
        byte = np.full(total, 0x20, np.int64)
        if back < total:
            byte[back:] = joined[: total - back]
        value = value << 8 | np.where(at >= back, byte, 0x20)
    return value, first, rows


def slots(grams: np.ndarray) -> np.ndarray:
    return (tb.mixed(grams.view(np.uint64)) >> np.uint64(64 - SLOTS)).astype(np.int64)


def sampled_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic and fold of the bounded sample that labels are learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder() != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = dict(known.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect())
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, SAMPLE / max(1, sizes.get(1, 0))).when(F.col("toxic") == 0, SAMPLE / max(1, sizes.get(0, 0)))
    return known.where(place < share).select("doc_id", "toxic", (remainder() == 1).alias("fits"))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in tb.slices(batch.column("text")):
            grams, first, rows = letter_grams(data, offsets)
            label = np.repeat(toxic[lo:hi][rows], np.diff(np.append(first, len(grams))))
            order = np.argsort(grams, kind="stable")
            line = grams[order]
            heads = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.empty(0, np.int64)
            counts = [np.add.reduceat(x[order].astype(np.int64), heads) if len(heads) else heads for x in (label == 1, label == 0, np.ones(len(label), bool))]
            yield pa.RecordBatch.from_arrays([pa.array(line[heads]), *map(pa.array, counts)], ["gram", "t", "o", "n"])


def ratios(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """gram, n, ratio: log of the toxic over the ordinary probability of the last byte after the first five."""
    counted = sample.where("NOT fits").select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(counted), F.col("doc_id") == F.col("_id"), "left").select("text", "toxic")
    grams = rows.mapInArrow(count_grams, "gram long, t long, o long, n long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.sum("n").alias("n"))
    grams = stored(grams)
    kept = lambda c: F.greatest(F.col(c) - CLASS_DISCOUNT, F.lit(0.0))
    tops = grams.groupBy(F.shiftright("gram", 8).alias("h6")).agg(
        F.sum("n").alias("n6"), F.count("*").alias("k6"), *(F.sum(c).alias(f"all_{c}") for c in "to"), *(F.sum(kept(c)).alias(f"kept_{c}") for c in "to")
    )
    fours = grams.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)).alias("g4")).agg(F.count("*").alias("c4"))
    over = fours.groupBy(F.shiftright("g4", 8).alias("h4")).agg(F.sum("c4").alias("n4"), F.count("*").alias("k4"))
    twos = fours.groupBy(F.col("g4").bitwiseAND(F.lit(0xFFFF)).alias("g2")).agg(F.sum("c4").alias("c2"))
    under = twos.groupBy(F.shiftright("g2", 8).alias("h2")).agg(F.sum("c2").alias("n2"), F.count("*").alias("k2"))
    twos = twos.join(under, F.shiftright("g2", 8) == F.col("h2"))
    p2 = (F.greatest(F.col("c2") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("k2") / 256) / F.col("n2")
    twos = twos.select("g2", p2.alias("p2"))
    p4 = (F.greatest(F.col("c4") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("k4") * F.col("p2")) / F.col("n4")
    fours = fours.join(over, F.shiftright("g4", 8) == F.col("h4")).join(twos, F.col("g4").bitwiseAND(F.lit(0xFFFF)) == F.col("g2")).select("g4", p4.alias("p4"))
    full = grams.join(tops.where("all_t + all_o > 0"), F.shiftright("gram", 8) == F.col("h6"))
    full = full.join(fours, F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("g4"))
    shared = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("k6") * F.col("p4")) / F.col("n6")
    full = full.withColumn("p", shared)
    p = {c: (kept(c) + (F.col(f"all_{c}") - F.col(f"kept_{c}") + BACKOFF) * F.col("p")) / (F.col(f"all_{c}") + BACKOFF) for c in "to"}
    return full.select("gram", "n", F.log(p["t"] / p["o"]).alias("ratio"))


def slot_table(ratio: DataFrame) -> np.ndarray:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slots(batch.column("gram").to_numpy())), batch.column("n"), batch.column("ratio")], ["slot", "n", "ratio"])

    placed = ratio.mapInArrow(place, "slot long, n long, ratio double").groupBy("slot")
    got = placed.agg((F.sum(F.col("ratio") * F.col("n")) / F.sum("n")).cast("float").alias("ratio")).toArrow()
    table = np.zeros(1 << SLOTS, np.float32)
    table[got.column("slot").to_numpy()] = got.column("ratio").to_numpy()
    return table


def features(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: ratio of the most telling word, that ratio per letter, ratio of the whole text per letter."""
    n = len(offsets) - 1
    out = np.zeros((n, 3))
    grams, first, rows = letter_grams(data, offsets)
    if len(first):
        value = table[slots(grams)]
        word = np.add.reduceat(value, first, dtype=np.float64)
        size = np.diff(np.append(first, len(grams)))
        edge = tb.bounds(rows, n)
        full = np.flatnonzero(np.diff(edge))
        out[full, 0] = np.maximum.reduceat(word, edge[full])
        out[full, 1] = np.maximum.reduceat(word / size, edge[full])
        out[full, 2] = np.add.reduceat(word, edge[full]) / np.add.reduceat(size, edge[full])
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic curve: Newton steps with a small penalty, both classes weighing the same."""
    x = np.column_stack((x, np.ones(len(x))))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-2 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, table: np.ndarray, curve: np.ndarray):
        self.table, self.curve = table, curve

    def score(self, array: pa.Array) -> np.ndarray:
        got = [features(self.table, data, offsets) for _, _, data, offsets in tb.slices(array)]
        x = np.concatenate(got) if got else np.zeros((0, 3))
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model, or the share of toxic labels if a class has none."""
    sample = stored(sampled_labels(labels))
    sizes = dict(sample.groupBy("toxic").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return float(bool(sizes.get(1)))
    table = slot_table(ratios(docs, sample))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(shared.value, data, offsets) for _, _, data, offsets in tb.slices(batch.column("text"))]
            x = np.concatenate(got) if got else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(x[:, k]) for k in range(3)), batch.column("toxic")], ["_id", "a", "b", "c", "toxic"])

    fits = sample.where("fits").select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(fits), F.col("doc_id") == F.col("_id")).select("_id", "text", "toxic")
    # One row per sampled label, whatever the number of documents that carry its id.
    kind = docs.schema["doc_id"].dataType.simpleString()
    per = rows.mapInArrow(measure, f"_id {kind}, a double, b double, c double, toxic int").groupBy("_id", "toxic").agg(*(F.avg(c).alias(c) for c in "abc"))
    got = per.orderBy("_id", "toxic").toArrow()
    x = np.column_stack([got.column(c).to_numpy() for c in "abc"])
    return Model(table, fit_curve(x, got.column("toxic").to_numpy()))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (remainder() == 0).alias("held_out"), "text")
    if isinstance(model, float):
        return rows.select("doc_id", "held_out", F.lit(model).alias("score"), F.lit(int(model >= 0.5)).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")
