"""Trees grown beside the data against MLlib's, whatever the number of blocks and tasks they are grown in."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from pricetide.operators import models as M
from pricetide.operators import trees


@pytest.fixture(scope="module")
def rows(spark):
    def draw(seed: int, most: int):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(most * 1000)) / 1000.0

    df = spark.range(1500).select(
        F.col("id").alias("entity"),
        (50.0 + draw(1, 80)).alias("area_total"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(45.0 + draw(2, 80)).alias("area_private"),
        draw(3, 4).cast("int").alias("rooms"),
        F.lit(1).alias("baths"),
        draw(4, 2).cast("int").alias("parking"),
        F.concat(F.lit("d"), draw(5, 7).cast("int").cast("string")).alias("district"),
        F.when(draw(6, 5) < 3, "house").otherwise("flat").alias("kind"),
        draw(7, 60000).alias("noise"),
    )
    price = 2000.0 * F.col("area_total") + 10000.0 * F.col("rooms") + F.when(F.col("district").isin("d1", "d4"), 30000.0).otherwise(0.0)
    return df.withColumn("price", price + F.col("noise")).drop("noise").cache()


def _predicted(rows, estimator):
    fitted = M.fit(rows, M.Candidate("x"), {"x": lambda: estimator})
    return fitted, {r["entity"]: r["y_pred"] for r in fitted.predict(rows).collect()}


@pytest.mark.parametrize("blocks", [1, 3])
def test_boosting_is_mllibs(rows, monkeypatch, tmp_path, blocks):
    """every level of every round was a job; one block of rows now goes through all rounds in a task."""
    monkeypatch.setattr(trees, "blocks_for", lambda n: blocks)
    monkeypatch.setattr(trees, "KEEP_ROUNDS", 2)
    sizes = {"maxIter": 5, "stepSize": 0.05, "maxDepth": 3, "seed": 42}
    assert type(M.regressors()["boosting"]()) is M.Boosting
    fitted, got = _predicted(rows, M.Boosting(**sizes))
    assert got == pytest.approx(_predicted(rows, GBTRegressor(**sizes))[1], rel=1e-9)
    fitted.pipeline.write().save(str(tmp_path / "boosted"))
    again = M.Fitted(fitted.candidate, PipelineModel.load(str(tmp_path / "boosted"))).predict(rows)
    assert {r["entity"]: r["y_pred"] for r in again.collect()} == got


@pytest.mark.parametrize("blocks", [1, 2])
def test_boosted_classes_are_mllibs(rows, monkeypatch, blocks):
    """F17."""
    monkeypatch.setattr(trees, "blocks_for", lambda n: blocks)
    frame = rows.withColumn("target", F.when(F.col("price") > 235000, -0.1).otherwise(0.1))
    sizes = {"maxIter": 5, "stepSize": 0.05, "maxDepth": 3, "seed": 42}
    assert type(M.classifiers()["boosting"]()) is M.BoostingClassifier
    got, want = (
        {r["entity"]: r["p"] for r in M.predict_price_cut(M.fit_price_cut(frame, e, numeric=M.NUMERIC_COLUMNS), frame, numeric=M.NUMERIC_COLUMNS).collect()}
        for e in (M.BoostingClassifier(**sizes), GBTClassifier(**sizes))
    )
    assert got == pytest.approx(want, rel=1e-9) and len(set(want.values())) > 3


def test_trees_of_many_rows_are_finished_in_many_tasks(rows, monkeypatch):
    """Nodes above the limit are split from histograms, the others each in a task, with the same trees."""
    monkeypatch.setattr(trees, "_weights", lambda seed, tree, block, n: np.ones(n, int))
    whole, got = _predicted(rows, M.forest(3, 2))
    assert whole.pipeline.stages[-1].table.filter("leaf >= 0").count() == 0
    monkeypatch.setattr(trees, "NODE_ROWS", 50)
    monkeypatch.setattr(trees, "TOPS", 2)
    split, parted = _predicted(rows, M.forest(3, 2))
    assert split.pipeline.stages[-1].table.filter("leaf >= 0").count() > 20
    assert parted == pytest.approx(got, rel=1e-9)
    monkeypatch.setattr(trees, "ASKED", 10)
    assert {r["entity"]: r["y_pred"] for r in split.predict(rows).collect()} == parted


def test_a_forest_draws_its_rows(rows):
    fitted, _ = _predicted(rows, M.forest(8, 2))
    values = {t.predict(fitted.pipeline.transform(M.impute(rows)).first()["features"]) for p in fitted.pipeline.stages[-1].parts for t in p.trees}
    assert len(values) > 4


def test_cut_points_of_many_values(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") * 1.0).alias("a"), (F.col("id") % 3).alias("b"))
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    exact, n = trees.learn_bins(ready, "features", 32)
    monkeypatch.setattr(trees, "COUNTED_ROWS", 10)
    near, _ = trees.learn_bins(ready, "features", 32)
    assert n == 5000 and exact.sizes[1] == near.sizes[1] == 3 and exact.sizes[0] == 32 and near.sizes[0] == 32
    assert np.abs(exact.cuts[0] - near.cuts[0]).max() < 100
