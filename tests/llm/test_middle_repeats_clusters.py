"""Fill-in-middle, seed-and-extend dedup and clustering against plain versions, on odd rows, large groups and empty tables."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricetide.llm import boundary_set, fill_middle, heap_clusters, seed_extend
from pricetide.llm import textbatch as tb

from . import plain


def bag(rows):
    return Counter(tuple(r) for r in rows)


# ---------------------------------------------------------------- boundary sets
def test_containers_take_their_smallest_form():
    sparse = boundary_set.container(np.arange(0, 65536, 40, dtype=np.uint16))
    dense = boundary_set.container(np.arange(0, 65536, 3, dtype=np.uint16))
    runs = boundary_set.container(np.concatenate((np.arange(7, 9000), np.arange(20000, 65536))).astype(np.uint16))
    assert [c.kind for c in (sparse, dense, runs)] == [boundary_set.ARRAY, boundary_set.BITMAP, boundary_set.RUN]


@pytest.mark.parametrize("seed", range(12))
def test_select(seed):
    rng = np.random.default_rng(seed)
    parts = [
        rng.choice(65536, int(rng.integers(1, 4000)), replace=False),
        65536 * 3 + rng.choice(65536, int(rng.integers(4097, 60000)), replace=False),
        65536 * 4 + np.arange(int(rng.integers(1, 65537))),
        65536 * 9 + np.array([0, 65535]),
    ]
    positions = np.sort(np.concatenate(parts))
    made = boundary_set.BoundarySet(positions)
    order = rng.permutation(len(positions))
    assert len(made) == len(positions) and (made.select(order) == positions[order]).all()


def test_empty_set():
    made = boundary_set.BoundarySet(np.empty(0, np.int64))
    assert len(made) == 0 and len(made.select(np.empty(0, np.int64))) == 0


def test_nth_bit():
    words = np.array([1, 2**63, 2**64 - 1, 0b1011000], np.uint64)
    assert boundary_set.nth_bit(words, np.array([0, 0, 63, 2])).tolist() == [0, 63, 63, 6]


# ---------------------------------------------------------------- fill in middle
TEXTS = ["", None, "\n", "\n\n\n", "one line", "a\nb\nc", "é\nñ\n\u2028 and 漢字\n" * 40, "has <P> inside\nand more", "<S\n<\nP>\n<M\n>", "\n" * 70_000 + "x", "w\n" * 90_000, "\ud7ff<\nP>" * 9]


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (1, 40, 0), (2, 100, 100)])
def test_fill_in_middle(spark, seed, rate, spm):
    rows = [(i if i % 5 else None, t, "own") for i, t in enumerate(TEXTS * 4)]
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3), seed, rate, spm)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert bag(r[2:7] for r in got) == bag(plain.fill_middle(i, t, seed, rate, spm) for i, t, _ in rows)
    assert all(r["back"] == (r["text"] or "") for r in got)


def test_fill_in_middle_of_odd_and_empty_tables(odd, empty, pairs):
    got = fill_middle.fill_in_middle(odd).select("doc_id", *fill_middle.RESULT).collect()
    assert bag(got) == bag((i, *plain.fill_middle(i, t)) for i, t in pairs)
    assert fill_middle.fill_in_middle(empty).count() == 0


def test_cuts_of_slices():
    texts = pa.array(["a\nb\nc\n", "", "x", "\n"])
    data, offsets = tb.buffers(texts)
    h = np.array([[0, 3, 0, 0], [5, 6, 0, 0], [0, 1, 0, 0], [1, 1, 0, 0]])
    n, first, second = fill_middle.cuts(data, offsets, h)
    assert n.tolist() == [3, 0, 1, 1]
    assert [(a, b) for a, b in zip((first - offsets[:-1]).tolist(), (second - offsets[:-1]).tolist(), strict=True)] == [(0, 6), (0, 0), (0, 1), (1, 1)]


# ---------------------------------------------------------------- seed and extend
def distinct_in_order(spark, pairs):
    """Rows as the operator orders them: id (null first), then hash of the text; equal rows once."""
    df = spark.createDataFrame(sorted(set(pairs), key=repr), "doc_id long, text string")
    return [(r[0], r[1]) for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]


def expected_rows(spark, pairs):
    order = distinct_in_order(spark, pairs)
    by_pair = dict(zip(order, plain.seed_extend(order), strict=True))
    return bag(by_pair[p] for p in pairs)


def test_seed_extend_on_odd_rows(spark, odd, empty, pairs):
    assert bag(seed_extend.seed_extend_dedup(odd).collect()) == expected_rows(spark, pairs)
    assert seed_extend.seed_extend_dedup(empty).count() == 0


def test_seeds_cover_every_window_once():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 4, 3000).astype(np.uint64)
    rows = np.repeat([0, 2, 5], [19, 21, 2960])
    h, at, first, last = seed_extend.seeds(words, rows)
    starts = [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)]
    assert starts == [p for p in range(len(words) - 19) if rows[p] == rows[p + 19]]
    assert ((first <= at) & (at <= last + 20 - seed_extend.GRAM) & (at >= last) & (at + seed_extend.GRAM <= first + 20)).all()


@pytest.mark.parametrize("seed", range(4))
def test_seed_extend_of_random_mosaics(spark, seed):
    """Passages cut and pasted at random, also inside one document, with few different words."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(2 if seed == 0 else 30)]
    pool = [[rng.choice(words) for _ in range(rng.choice((15, 20, 21, 45, 90)))] for _ in range(12)]
    pairs = [(i % 37, " ".join(w for _ in range(rng.randrange(6)) for w in rng.choice(pool)[rng.randrange(9) :])) for i in range(60)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    assert bag(seed_extend.seed_extend_dedup(df).collect()) == expected_rows(spark, pairs)


def judged(rows, size):
    """Marks of sorted rows that come in batches of ``size``."""
    names = list(seed_extend.ROWS)
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    parts = [batch.slice(k, size) for k in range(0, batch.num_rows, size)]
    return Counter((r["doc_id"], r["mark"]) for out in seed_extend.judge_rows(iter(parts)) for r in out.to_pylist())


@pytest.mark.parametrize("size", range(1, 12))
def test_scan_keeps_its_state_between_batches(size):
    rows = [
        (False, 1, 5, 7, 0, 3, 0), (False, 1, 5, 7, 0, 3, 0), (False, 1, 5, 8, 0, 3, 0), (False, 1, 5, 8, 0, 3, 0),  # one content: a copy, each row twice
        (False, 2, 5, None, 0, 1, 34), (False, 2, 5, None, 1, 1, 34), (False, 2, 6, 9, 0, 4, 1), (False, 2, 7, 9, 0, 8, 0), (True, 2, 7, 9, 0, 9, 0),
        (False, 3, 1, 1, 1, 1, 1), (False, 4, 1, 1, 1, 2, 1),
    ]
    span = lambda start, stop: (start << 32) + stop
    assert judged(rows, size) == Counter({(8, span(3, 23)): 2, (None, span(1, 22)): 1, (None, -1 - 3): 1, (9, -1 - 5): 1, (9, -1 - 8): 1, (9, span(9, 29)): 1})


def test_hot_passages_and_repeated_rows(spark):
    """A third of the rows share a passage in different surroundings, a third are one row, the rest are copies of one text."""
    passage = " ".join(f"p{k}" for k in range(60))
    own = [(k, f"{' '.join(f'a{k}x{j}' for j in range(15))} {passage} {' '.join(f'b{k}x{j}' for j in range(15))}") for k in range(300)]
    text = " ".join(f"c{k}" for k in range(500))
    pairs = own + [(1000, "the same row again " * 30)] * 300 + [(2000 + k, text) for k in range(300)]
    got = bag(seed_extend.seed_extend_dedup(spark.createDataFrame(pairs, "doc_id long, text string").repartition(6)).collect())
    assert got == expected_rows(spark, pairs)
    assert sum(n for r, n in got.items() if r[0] < 1000 and r[2] == 60) == 299


def test_maximal_repeats(spark):
    common = [f"c{k}" for k in range(50)]
    rows = [(1, " ".join(["x"] * 3 + common)), (2, " ".join(["y", "z", *common, "q"])), (3, " ".join(common[5:24])), (4, " ".join(common[:30] + ["-"] + common[30:]))]
    got = seed_extend.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert bag(got) == bag([(2, 2, 52), (4, 0, 30), (4, 31, 51)])


# ---------------------------------------------------------------- clusters
SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, _c int"


def vectors(n, seed=0, centres=5, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 64))
    return [(k, [float(np.float32(x)) for x in middle[k % centres] + spread * rng.normal(size=64)]) for k in range(n)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], schema).repartition(3)


def odd_vectors():
    good = vectors(40, 1, 3)
    same = [(100 + k, good[0][1]) for k in range(30)]
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [float("nan")] + [0.0] * 63), (205, [float("inf")] + [0.0] * 63), (206, [None] + [0.0] * 63)]
    return good + same + bad + [(None, good[1][1]), (3, good[5][1]), (3, good[5][1])]


def test_heap_clusters_on_odd_rows(spark):
    rows = odd_vectors()
    assert bag(heap_clusters.heap_clusters(frame(spark, rows)).collect()) == bag(plain.clusters(rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], vectors(1), vectors(5), [(k, [0.5] * 64) for k in range(20)]])
def test_few_or_equal_vectors(spark, rows):
    assert bag(heap_clusters.heap_clusters(frame(spark, rows)).collect()) == bag(plain.clusters(rows))


def test_large_components_stay_exact(spark):
    rows = [(k, [1e6 * x for x in v]) for k, v in vectors(30, 4)] + [(99, [1e9] + [0.0] * 63), (98, [1e30] + [0.0] * 63)]
    schema = SCHEMA.replace("float", "double")
    got = heap_clusters.heap_clusters(frame(spark, rows, schema)).collect()
    expected = plain.clusters([r for r in rows if r[0] != 98])
    fit = {i: (j, d) for i, j, d, *_ in expected}
    assert {r["vec_id"] for r in got} == set(fit)
    assert all((r["cluster"], r["distance"]) == (fit[r["vec_id"]][0], fit[r["vec_id"]][1] if fit[r["vec_id"]][1] < 2**63 else None) for r in got)


def test_blocks_of_any_size_and_popped_vectors_only(spark, monkeypatch):
    """Results don't depend on blocks; later rounds measure a part of the vectors only."""
    monkeypatch.setattr(heap_clusters, "BLOCK", 7)
    rows = vectors(400, 2, 8, 0.4)
    out, centroids, scanned = heap_clusters.cluster(frame(spark, rows))
    assert {r["vec_id"]: r["cluster"] for r in out.collect()} == {r[0]: r[1] for r in plain.clusters(rows)}
    assert len(centroids) == 8 and len(scanned) == 11 and scanned[0] == 400 and min(scanned) < 100


def test_heaps_keep_their_order_and_expire_by_gap():
    heaps = heap_clusters.Heaps([[], []])
    heaps.push(np.arange(6), np.array([0, 1, 0, 1, 0, 1]), np.array([3.0, 1.0, 0.5, 2.0, 4.0, 0.1]), [0.0, 10.0])
    again = heap_clusters.Heaps.load(*heaps.dump())
    assert again.heaps == heaps.heaps and again.clusters(6).tolist() == [0, 1, 0, 1, 0, 1]
    popped, of = again.expired([3.0, 11.0])
    assert sorted(zip(popped.tolist(), of.tolist(), strict=True)) == [(0, 0), (1, 1), (2, 0), (5, 1)]


def test_shrinkage_is_own_drift_and_the_largest_other():
    got = heap_clusters.shrinkage([[0, 0], [0, 0], [0, 0]], [[3, 4], [0, 1], [0, 0]])
    assert got == pytest.approx([6.0, 6.0, 5.0]) and all(a >= b for a, b in zip(got, (6.0, 6.0, 5.0), strict=True))


def test_rounds_do_not_shuffle_vectors(spark):
    """Blocks and heaps are bucketed alike."""
    tables = heap_clusters._Bucketed(spark, 4)
    blocks = tables.write(spark.range(40).select(F.col("id").alias("block"), F.lit(1).alias("n")), "a")
    heaps = tables.write(spark.range(40).select(F.col("id").alias("block"), F.lit(2).alias("m")), "b")
    plan = blocks.join(heaps.hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    tables.drop("a")
    tables.drop("b")
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
