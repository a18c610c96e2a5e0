"""Bounds that hold whatever the rows: long path segments, ids that many documents repeat."""

from __future__ import annotations

import pickle
import random
import time
import tracemalloc

from pricetide.llm import decontaminate, toxicity
from pricetide.llm.queries import URL_RULES
from pricetide.llm.url_filter import Trie


def test_a_long_segment_is_looked_at_once_for_each_length_of_a_rule():
    trie = Trie([*URL_RULES, ("block", "com", "/x/" + "p" * 500), ("allow", "com", "/x/p")])
    start = time.time()
    for _ in range(50):
        assert trie.match("a.com", "/x/" + "p" * 499 + "q" * 400_000) == ("allow", "com/x/p")
        assert trie.match("a.com", "/x/" + "p" * 400_000) == ("block", "com/x/" + "p" * 500)
        assert trie.match("a.com", "/" + "y" * 400_000) is None
    assert time.time() - start < 5


def test_the_driver_gets_one_row_for_each_label(spark, monkeypatch):
    """A labelled id that a third of the documents repeat is one row of the fit."""
    seen = []
    fit = toxicity.fit_curve
    monkeypatch.setattr(toxicity, "fit_curve", lambda x, y: seen.append(len(y)) or fit(x, y))
    calm, foul = "a calm and ordinary text about nothing much ", "vile hateful rubbish you nasty brute "
    docs = [(k, (foul if k % 2 else calm) * 3 + str(k)) for k in range(200)] + [(8, calm + str(k)) for k in range(100)]
    labels = [(k, 1, k % 2) for k in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(*frame).collect()
    assert len(got) == 300 and seen and seen[0] <= 200
    held = [r for r in got if r["held_out"] and r["doc_id"] != 8]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held)


def test_tables_of_a_block_stay_near_its_bytes():
    rng = random.Random(4)
    items = [(k, " ".join(f"word{rng.randrange(50_000)}" for _ in range(400))) for k in range(250)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    patterns = decontaminate.compile_items(items)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    fixed = 40 << 20  # shift table and powers
    assert peak - fixed < 40 * size and len(pickle.dumps(patterns)) < (2 << 20) + 12 * size


def test_a_window_of_many_items_is_one_pattern():
    same = " ".join(f"w{k}" for k in range(10))
    (p,) = decontaminate.compile_items([(k, same) for k in range(50)] + [(3, same), (None, same)])
    assert len(p.at) == 1 and sorted(p.names(0)) == sorted([*map(str, range(50)), "null"])
    assert decontaminate.compile_items([]) == [] and decontaminate.compile_items([(1, None), (2, " -- ")]) == []
