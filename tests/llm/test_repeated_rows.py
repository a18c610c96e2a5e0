"""Rows that repeat an id and text, by the thousands, and repeats between 256 and 400 bytes."""

from __future__ import annotations

import time
from collections import Counter

from pricetide.llm import line_dedup, suffix_dedup

from . import plain


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_suffix_dedup_of_one_row_two_thousand_times(spark):
    text = " ".join(f"word{k * 7919 % 10007}" for k in range(1000))
    rows = [(7, text)] * 2000 + [(8, text[:5000]), (9, "own " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    start = time.time()
    got = bag(suffix_dedup.suffix_dedup(df).collect())
    assert time.time() - start < 60
    one = plain.suffix_dedup([(7, text), (7, text), (8, text[:5000]), (9, "own " * 3)])
    assert got == Counter({one[0]: 2000, one[2]: 1, one[3]: 1})


def test_passages_of_fifty_words_that_are_too_short_to_go(spark):
    passage = " ".join(f"p{k:03}e" for k in range(52))
    assert 256 < len(passage) < 400
    rows = [(k, f"{k} own beginning {k * 31} {passage} and {k * 17} own end") for k in range(20)] + [(50, "a clean document " + " ".join(map(str, range(300))))]
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["n_removed"] == 0 and len(passage) <= got[k]["n_repeated"] <= len(passage) + 12 for k in range(20))
    assert got[50]["n_repeated"] == 0
    assert bag(got.values()) == bag(plain.suffix_dedup(rows))


def test_line_dedup_of_one_row_many_times(spark):
    line = "a line that several documents share, long enough"
    text = "\n".join([line, *(f"own line number {k} of this document" for k in range(200))])
    rows = [(7, text)] * 2000 + [(8, text), (9, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = line_dedup.keep_bitmaps(df.selectExpr("doc_id", "text", "xxhash64(text) AS _text"))
    assert [r["doc_id"] for r in got.collect()].count(7) == 1
    assert bag(r[:4] for r in line_dedup.line_dedup(df).collect()) == bag(plain.line_dedup(rows))
