"""Comparisons train every candidate whole, at the published sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.operators import models as M
from pricetide.operators import trees
from pricetide.plans import catalog, q_models
from pricetide.session import stored


@pytest.mark.parametrize("name", ["cv_leaderboard", "mdape_ensemble", "weighted_ensemble"])
def test_comparisons_on_folds_train_at_published_sizes(spark, sf, monkeypatch, name):
    """20 trees and 10 rounds were trained of 400 and 500."""
    seen = []

    class Enough(Exception):
        pass

    def sizes(train, candidates, factories, **_):
        made = [make() for make in factories.values()]
        seen.append([e.getNumTrees() if e.hasParam("numTrees") else e.getMaxIter() for e in made if e.hasParam("maxDepth")])
        assert len(candidates) == 10
        raise Enough

    monkeypatch.setattr(q_models, "prepared", lambda *_: spark.createDataFrame([("train", "k", 0)], "part string, kind string, fold int"))
    monkeypatch.setattr(M, "out_of_fold", sizes)
    with pytest.raises(Enough):
        catalog.queries()[name](spark, sf)
    assert seen == [[400, 500]]


def test_an_ensemble_is_refitted_at_published_sizes(spark, sf, monkeypatch):
    """the members of the weighted ensemble, too."""
    rows = spark.createDataFrame([("train", "k", 0)], "part string, kind string, fold int")
    seen = []

    def fitted(train, weights, candidates, factories):
        seen.append([factories["forest"]().getNumTrees(), factories["boosting"]().getMaxIter()])
        return []

    monkeypatch.setattr(q_models, "_ensemble", lambda *_: (rows, rows, {}))
    monkeypatch.setattr(M, "fit_ensemble", fitted)
    monkeypatch.setattr(M, "predict_weighted", lambda test, members: test)
    monkeypatch.setattr(q_models, "scores", lambda df, keys: df)
    catalog.queries()["weighted_ensemble"](spark, sf)
    assert seen == [[400, 500]]


def _listings(spark, n):
    df = spark.range(n).select(
        F.col("id").alias("entity"),
        (50.0 + F.col("id") % 80).alias("area_total"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(45.0 + F.col("id") % 80).alias("area_private"),
        (F.col("id") % 4).cast("int").alias("rooms"),
        F.lit(1).alias("baths"),
        (F.col("id") % 2).cast("int").alias("parking"),
        F.concat(F.lit("d"), (F.col("id") % 6).cast("string")).alias("district"),
        F.lit("house").alias("kind"),
        (F.col("id") % 2).cast("int").alias("fold"),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("part"),
    )
    price = 2000.0 * F.col("area_total") + 10000.0 * F.col("rooms") + 900.0 * (F.col("entity") * 37 % 11)
    return df.withColumn("price", price).withColumn("typical", F.col("entity") % 7 > 0)


def test_every_ranked_candidate_is_tested(spark, sf, monkeypatch):
    """test errors were known of the three members of the ensemble only."""
    rows = stored(_listings(spark, 120))
    monkeypatch.setattr(q_models, "prepared", lambda *_: rows)
    monkeypatch.setattr(q_models, "PUBLISHED", M.regressors(trees=3, rounds=2))
    monkeypatch.setattr(q_models, "CANDIDATES", [M.Candidate(m, t) for t in ("price", "log") for m in ("ridge", "forest")] + [M.Candidate("boosting")])
    board = catalog.queries()["leaderboard_table"](spark, sf).collect()
    assert len(board) == 5 and sum(r["chosen"] for r in board) == 3
    assert all(r[c] is not None for r in board for c in board[0].asDict())


@pytest.mark.parametrize("blocks", [1, 3])
def test_forests_asked_once_are_the_forests_of_tables(spark, monkeypatch, blocks):
    """predictions of a fold's forest and boosting, from few rows and by way of tables."""
    rows = stored(_listings(spark, 300))
    made, candidates = M.regressors(trees=30, rounds=4), [M.Candidate("forest"), M.Candidate("forest", "log"), M.Candidate("boosting"), M.Candidate("ridge")]
    monkeypatch.setattr(trees, "blocks_for", lambda n: blocks)
    monkeypatch.setattr(trees, "GROUP_ROWS", 1000)
    asked = M.out_of_fold(rows, candidates, made)
    monkeypatch.setattr(trees, "ASKED", 10)
    kept = M.out_of_fold(rows, candidates, made)
    got, want = ({(r["entity"], r["model"]): r["y_pred"] for r in df.collect()} for df in (asked, kept))
    of_trees = {k for k in want if "ridge" not in k[1]}
    assert len(got) == 1200 and got == pytest.approx(want, rel=1e-7)
    assert {k: got[k] for k in of_trees} == pytest.approx({k: want[k] for k in of_trees}, rel=1e-12)


def test_trees_grown_together_are_those_grown_alone():
    """levels of many trees are made at once, with the same nodes, cuts and values."""
    draw = np.random.default_rng(3)
    x = np.stack([draw.integers(0, 9, 400), draw.integers(0, 5, 400), draw.integers(0, 7, 400)]).astype(np.uint8)
    bins, y = trees.Bins([np.arange(8.0), np.arange(4.0), None], [9, 5, 7]), draw.normal(size=400) + x[0]
    draws = [draw.poisson(1.0, 400) for _ in range(6)] + [np.zeros(400, int), np.ones(400, int)]
    together = trees.grow_all(x, y, draws, bins, 30, 2)
    alone = [trees.grow(x, y, w, bins, 30, 2) for w in draws]
    assert [t.columns() for t in together] == [t.columns() for t in alone]
    assert len(together[0].feature) > 50 and len(together[6].feature) == 1
