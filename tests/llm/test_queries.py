"""Queries without an SQL twin against their plain versions over the whole small tables; the pipeline stage by stage."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from pricetide.llm import queries, repetition

from . import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_names_and_twins():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_op1(spark, docs):
    got = queries.op1_suffix_dedup(spark, SF)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert bag(got.collect()) == bag(plain.suffix_dedup([(d["doc_id"], d["text"]) for d in docs]))


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in queries.op4_repetition(spark, SF).collect()}
    for d in docs:
        base, failed, share, line = plain.repetition(d["text"])
        r = got[d["doc_id"]]
        assert tuple(r[c] for c in repetition.COUNTS) == base and r["base_failed"] == failed
        assert r["n_repeat_runs"] == plain.repeat_runs(d["text"])
        assert r["line_coverage"] == pytest.approx(line) and all(r[f"coverage_{n}"] == pytest.approx(x) for n, x in share.items())


def test_op7(spark, docs):
    got = {r["doc_id"]: r for r in queries.op7_language_id(spark, SF).collect()}
    held = [d for d in docs if got[d["doc_id"]]["held_out"]]
    assert len(got) == len(docs) and held
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.95 * len(held)


def test_op8(spark, docs):
    assert bag(queries.op8_simhash(spark, SF).collect()) == bag(plain.near_duplicates([(d["doc_id"], d["text"]) for d in docs]))


def test_op9(spark, docs):
    got = queries.op9_toxicity(spark, SF).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert sorted(got) == sorted(queries.op9_toxicity(spark, SF).collect())


def test_op10_reads_back_the_extra_conversation(spark):
    r = queries.op10_chat_windows(spark, SF).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(text), plain.sha(text))
    assert r["turns_sha256"] == plain.sha(f"user\n{text}\nassistant\n{text}\n")


def test_op11(spark, docs):
    got = {r["doc_id"]: r for r in queries.op11_fill_middle(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        *counts, output = plain.fill_middle(d["doc_id"], d["text"])
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], *counts, plain.sha(output), plain.sha(d["text"] or ""))


def test_op12(spark, docs):
    rows = sorted((d["doc_id"], d["text"]) for d in docs)
    assert bag(queries.op12_seed_extend(spark, SF).collect()) == bag(plain.seed_extend(rows))


def test_op13(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert bag(queries.op13_heap_clusters(spark, SF).collect()) == bag(plain.clusters(rows))


def test_pipeline(spark, tmp_path):
    """Every stage on the rows its predecessor wrote."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, seen = given.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, given, SF)
        out.write.parquet(str(tmp_path / f"{k}"))
        out = spark.read.parquet(str(tmp_path / f"{k}"))
        rows, got = given.collect(), out.collect()
        pairs = [(r["doc_id"], r["text"]) for r in rows]
        if name != "mixing":
            assert out.columns == columns
        ids = [r["doc_id"] for r in got]
        if name == "language ID":
            assert len(got) >= 0.97 * len(rows) and bag(got) <= bag(rows)
        elif name == "line dedup":
            assert bag((r["doc_id"], plain.sha(r["text"])) for r in got) == bag((r[0], r[3]) for r in plain.line_dedup(pairs))
        elif name == "SimHash near-dedup":
            assert Counter(ids) == Counter({r[2] for r in plain.near_duplicates(pairs)})
        elif name == "benchmark decontamination":
            assert Counter(ids) == Counter(r[0] for r in plain.decontaminate(pairs, bench) if not r[5])
        else:
            _, total, target = plain.mixture([(r["doc_id"], r["text"], r["source"]) for r in rows])
            taken = Counter()
            for r in got:
                taken[r["source"]] += r["taken"]
                assert 0 < r["taken"] <= 3 * r["size"]
            assert all(abs(taken[s] - target[s]) <= 1 for s in total)
        seen.append(name)
        given = out
    assert len(seen) == 5
    assert bag(corpus_pipeline.run(spark, SF).collect()) == bag(given.collect())
