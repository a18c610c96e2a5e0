"""Language identification with error-correcting output codes.

Every language gets a codeword; for each bit a linear classifier over hashed byte n-grams tells the languages with bit 1
from those with bit 0. A classifier's weights are log ratios of the n-gram shares on either side, every language counting
alike. Decoding weighs each bit's logistic loss by how far the bit keeps its languages apart and picks the codeword with
the smallest loss. ``score`` is the softmax of the negative losses at the chosen language; ``ambiguous`` marks texts whose
second language comes close, ``rejected`` those that are ambiguous or have no letter.

* Learned from rows with text and language whose crc32(doc_id) mod 4 is not 2: about ``SAMPLE`` documents of each language,
  chosen by a hash of the id (all of them if there are fewer). At most ``MAX_LANGUAGES``; more raise.
* A text that is null, empty or without a letter is ``und`` with score 0; so is every text if no language was learned. With
  one language learned, every other text gets it.
* Whole texts count; long ones are summed up slice by slice. A null doc_id counts as the empty text in the checksum.
* Repeated rows are judged alike; columns other than doc_id, text and (for learning) lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

SAMPLE = 4_000
MAX_LANGUAGES = 256
SIZES = (2, 4)
BITS = 16
SHARPNESS = 3.0
AMBIGUOUS = 0.15

LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 256)
BLANK = {2: 0x2020, 4: None}


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def grams(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Feature of each byte position for each n-gram size; -1 where the n-gram is blank or leaves its document."""
    text = LETTERS[data]
    n = len(text)
    out = []
    for size in SIZES:
        value = np.zeros(n, np.uint32)
        blank = np.ones(n, bool)
        for k in range(size):
            value[: n - k or None] = (value[: n - k or None] << np.uint32(8)) | text[k:] if n > k else 0
            if n > k:
                blank[: n - k] &= text[k:] == 0x20
        if size > 2:
            value = (value * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        f = value.astype(np.int32)
        f[blank] = -1
        for back in range(1, size):
            at = offsets[1:] - back
            at = at[at >= 0]
            f[at] = -1
        out.append(f)
    return out


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all two-way splits for up to five languages, else the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = [[1 if s >> k & 1 else -1 for k in range(n)] for s in range(2 ** (n - 1), 2**n - 1)]
        return np.array(splits, np.int8).T
    width = int(np.ceil(6 * np.log2(n)))
    rng = np.random.default_rng(n)
    best, most = None, (-1, -1)
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None].astype(np.int8)
        apart = (code[:, None, :] != code[None, :, :]).sum(2)
        apart = apart[~np.eye(n, dtype=bool)]
        if (score := (apart.min(), apart.mean())) > most:
            best, most = code, score
    return best


class Model:
    """Codewords, one weight table per n-gram size and bit, and each bit's scale and weight."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = [(c + 0.5) / (c + 0.5).sum(1, keepdims=True) for c in counts.transpose(1, 0, 2)] if languages else []
        self.weights = np.zeros((len(SIZES), self.code.shape[1], (1 << BITS) + 1), np.float32)  # the last one is for -1
        margin = np.zeros((len(languages), self.code.shape[1]))
        if len(languages) > 1:
            for k, p in enumerate(share):
                for b in range(self.code.shape[1]):
                    one, zero = p[self.code[:, b] > 0].mean(0), p[self.code[:, b] < 0].mean(0)
                    self.weights[k, b, :-1] = np.log(one / zero)
                    margin[:, b] += p @ self.weights[k, b, :-1]
        apart = np.abs(margin) if languages else np.ones((1, 1))
        self.scale = np.maximum(apart.mean(0), 1e-9)
        self.bit_weight = np.maximum(apart.min(0) / self.scale, 0.05)

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, gap to the second) of each text of a slice."""
        n = len(offsets) - 1
        margin = np.zeros((n, self.code.shape[1]))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full) and len(self.languages) > 1:
            for k, f in enumerate(grams(data, offsets)):
                count = np.maximum(np.add.reduceat(f >= 0, offsets[full]), 1)
                for b in range(self.code.shape[1]):
                    margin[full, b] += np.add.reduceat(self.weights[k, b][f], offsets[full], dtype=np.float64) / count
        x = margin / self.scale
        loss = np.logaddexp(0, -SHARPNESS * self.code[None, :, :] * x[:, None, :]) @ self.bit_weight
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        top = np.sort(share, axis=1)
        gap = top[:, -1] - top[:, -2] if share.shape[1] > 1 else np.ones(n)
        return share.argmax(1), top[:, -1], gap


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate(([0], np.cumsum((LETTERS[data] != 0x20) & (data < 0x80))))
    flag = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for row in np.flatnonzero(~flag & (np.diff(offsets) > 0)):
        flag[row] = any(c.isalpha() for c in data[offsets[row] : offsets[row + 1]].tobytes().decode(errors="replace"))
    return flag


def learn(docs: DataFrame) -> Model:
    """One weight table from the labelled rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), len(SIZES), 1 << BITS)))
    place = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*(x for name in languages for x in (F.lit(name), F.lit(SAMPLE / sizes[name]))))[F.col("lang")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array([languages.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi, data, offsets in tb.slices(batch.column("text")):
                who = np.repeat(names[lo:hi], np.diff(offsets))
                for k, f in enumerate(grams(data, offsets)):
                    for language in np.unique(who):
                        here = f[(who == language) & (f >= 0)]
                        table = total.setdefault(languages[language], np.zeros((len(SIZES), 1 << BITS), np.int64))
                        table[k] += np.bincount(here, minlength=1 << BITS)
        for name, table in total.items():
            at = np.flatnonzero(table.ravel())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(table.ravel()[at])], ["lang", "at", "n"])

    parts = rows.where(place < share).select("lang", "text").mapInArrow(count, "lang string, at int, n long")
    counts = np.zeros((len(languages), len(SIZES) << BITS))
    got = parts.groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    where = np.array([languages.index(x) for x in got.column("lang").to_pylist()], np.int64)
    if len(where):
        counts[where, got.column("at").to_numpy()] = got.column("n").to_numpy()
    return Model(languages, counts.reshape(len(languages), len(SIZES), 1 << BITS))


def _verdicts(model: Model, array: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    names: list[str] = []
    scores, rejected = [], []
    for _, _, data, offsets in tb.slices(array):
        letter = has_letter(data, offsets)
        if not model.languages:
            letter[:] = False
            best, score, gap = np.zeros(len(letter), int), np.zeros(len(letter)), np.zeros(len(letter))
        else:
            best, score, gap = model.judge(data, offsets)
        names.extend(model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True))
        scores.append(np.where(letter, score, 0.0))
        rejected.append(~letter | (gap < AMBIGUOUS))
    return names, np.concatenate(scores) if scores else np.empty(0), np.concatenate(rejected) if rejected else np.empty(0, bool)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rejected = _verdicts(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def known_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Documents that are not rejected, with all their columns; only texts go to Python, and nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    @F.arrow_udf("boolean")
    def stays(text: pa.Array) -> pa.Array:
        return pa.array(~_verdicts(shared.value, text)[2], pa.bool_())

    return docs.where(stays(F.col("text")))
