"""Models that are saved and loaded, forests fitted in parts, training that goes on where it stopped."""

import shutil

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from pricetide.operators import clean
from pricetide.operators import models as M
from pricetide.operators.cells import CellStore, cell_name, rows_digest, settings

FACTORIES = M.regressors(trees=10, rounds=2)
CANDIDATES = [M.Candidate("ridge"), M.Candidate("forest", "log"), M.Candidate("boosting")]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(300).select(
        F.col("id").alias("entity"),
        (50.0 + F.col("id") % 80).alias("area_total"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(45.0 + F.col("id") % 80).alias("area_private"),
        (F.col("id") % 4).cast("int").alias("rooms"),
        F.lit(1).alias("baths"),
        (F.col("id") % 2).cast("int").alias("parking"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("d"), (F.col("id") % 7 + (F.col("id") > 295).cast("int") * 50).cast("string"))).alias("district"),
        F.when(F.col("id") % 5 < 3, "house").otherwise("flat").alias("kind"),
        (F.col("id") % 3).cast("int").alias("fold"),
    )
    price = 2000.0 * F.col("area_total") + 10000.0 * F.col("rooms") + 5000.0 * F.length("kind")
    return clean.price_per_area_column(df.withColumn("price", price)).cache()


@pytest.fixture(autouse=True)
def few_parts(request, monkeypatch):
    if "parts" not in request.node.name:
        monkeypatch.setattr(M, "PARTS", 2)


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def rules():
    return Pipeline(stages=[clean.RareCategories("district", ["kind"]), clean.QuantileClip(by=["kind"]), clean.IqrFence(by=["kind"]), clean.MedianTargetEncoder("district", "price", "district_price")])


def test_cleaning_rules_survive_saving(spark, rows, tmp_path):
    fitted = rules().fit(rows.filter("fold > 0"))
    fitted.write().save(str(tmp_path / "rules"))
    loaded = PipelineModel.load(str(tmp_path / "rules"))
    assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages]
    other = rows.withColumn("area_total", F.col("area_total") * 3)
    same(loaded.transform(other), fitted.transform(other))
    assert loaded.transform(other).filter("district = 'outros'").count() > 0


def test_null_categories_are_categories(spark):
    df = spark.createDataFrame([("a", None, 1.0)] * 3 + [("a", "x", 9.0)] * 12, "kind string, district string, price double")
    assert clean.RareCategories("district", ["kind"]).fit(df).transform(df).filter("district = 'outros'").count() == 3
    encoded = clean.MedianTargetEncoder("district", "price", "m", min_count=2).fit(df).transform(df)
    assert {(r["district"], r["m"]) for r in encoded.collect()} == {(None, 1.0), ("x", 9.0)}


def test_parts_make_one_forest(rows, tmp_path):
    candidate = M.Candidate("forest")
    fitted = M.fit(rows, candidate, FACTORIES)
    model = fitted.pipeline.stages[-1]
    assert isinstance(model, M.SplitForestModel) and sorted(p.getNumTrees for p in model.parts) == [1] * 6 + [2] * 2
    assert len({p.getOrDefault("seed") for p in model.parts}) == 8
    scored = fitted.predict(rows)
    trees = [t for p in model.parts for t in p.trees]
    row = fitted.pipeline.transform(M.impute(rows)).first()
    assert row["prediction"] == pytest.approx(sum(t.predict(row["features"]) for t in trees) / 10)
    same(M.fit(rows.repartition(7), candidate, FACTORIES).predict(rows), scored)
    fitted.pipeline.write().save(str(tmp_path / "forest"))
    same(M.Fitted(candidate, PipelineModel.load(str(tmp_path / "forest"))).predict(rows), scored)


def test_trees_split_categories_as_sets(rows):
    """A price that depends on an unordered set of districts is learned by one split."""
    odd = rows.filter("entity < 290").withColumn("price", F.when(F.col("district").isin("d1", "d4", "d6"), 9e5).otherwise(1e5))
    boosted = M.fit(odd, M.Candidate("forest"), {"forest": lambda: M.forest(8, 1).setMaxDepth(1)})
    assert boosted.predict(odd).agg(F.max(F.abs(F.col("y_pred") - F.col("price")))).first()[0] < 1e5
    assert boosted.predict(odd.limit(1).withColumn("district", F.lit("never seen"))).first()["y_pred"] > 0


@pytest.mark.parametrize("combine", ["weighted", "median"])
def test_ensembles_survive_saving(rows, tmp_path, combine):
    members = [M.fit(rows, c, FACTORIES) for c in CANDIDATES]
    for member, weight in zip(members, (0.5, 0.3, 0.2), strict=True):
        member.weight = weight
    model = M.EnsembleModel.of(members, combine)
    model.write().save(str(tmp_path / "ensemble"))
    loaded = M.EnsembleModel.load(str(tmp_path / "ensemble"))
    assert [(m.candidate, m.weight) for m in loaded.members] == [(m.candidate, m.weight) for m in members]
    plain = M.predict_median(rows, members) if combine == "median" else M.predict_weighted(rows, members)
    same(loaded.transform(rows), plain)


def test_segments_are_scored_with_the_rules_they_were_trained_with(spark, rows, tmp_path):
    cleaning = Pipeline(stages=[clean.RareCategories("district", ["kind"]), clean.QuantileClip(by=["kind"])]).fit(rows)
    trained = {}
    for kind in ("flat", "house"):
        train = cleaning.transform(rows).filter(F.col("kind") == kind)
        trained[kind] = M.EnsembleModel.of(M.fit_ensemble(train, {"ridge(price)": 0.25, "forest(log)": 0.75}, CANDIDATES, FACTORIES))
    folder = str(tmp_path / "segments")
    M.save_segments(folder, cleaning, trained, spark)
    found, models = M.load_segments(folder, spark)
    # Scored rows whose own quantiles and counts would give other rules, and a segment nobody trained.
    new = rows.filter("entity < 20").withColumn("area_total", F.col("area_total") * 10)
    new = new.unionByName(new.limit(1).withColumn("kind", F.lit(None).cast("string")))
    got = M.score_segments(new, found, models)
    same(got, M.score_segments(new, cleaning, trained))
    assert got.filter("kind IS NULL AND estimate IS NULL").count() == 1 and got.count() == 21
    assert got.filter("kind IS NOT NULL").agg(F.max("area_total")).first()[0] <= rows.agg(F.max("area_total")).first()[0]
    assert got.filter("kind IS NOT NULL AND (district IS NULL OR district <> 'outros')").count() > 0


def test_training_goes_on_where_it_stopped(spark, rows, tmp_path, monkeypatch):
    store = CellStore(spark, str(tmp_path / "cells"))
    fitted = []
    fit = M.fit

    def failing(train, candidate, *rest):
        if len(fitted) == 4:
            raise RuntimeError("lost")
        fitted.append(candidate.name)
        return fit(train, candidate, *rest)

    monkeypatch.setattr(M, "fit", failing)
    with pytest.raises(RuntimeError):
        M.out_of_fold(rows, CANDIDATES, FACTORIES, store=store, parallelism=1)
    monkeypatch.setattr(M, "fit", lambda train, candidate, *rest: fitted.append(candidate.name) or fit(train, candidate, *rest))
    got = M.out_of_fold(rows, CANDIDATES, FACTORIES, store=store)
    assert len(fitted) == 9
    plain = M.out_of_fold(rows, CANDIDATES, FACTORIES)
    assert len(fitted) == 18
    same(got.select(sorted(got.columns)), plain.select(sorted(got.columns)))
    same(M.out_of_fold(rows, CANDIDATES, FACTORIES, store=store), got)
    assert len(fitted) == 18


def test_cells_that_were_not_committed_or_have_other_contents_are_fitted_again(spark, rows, tmp_path, monkeypatch):
    store = CellStore(spark, str(tmp_path / "cells"))
    fitted = []
    fit = M.fit
    monkeypatch.setattr(M, "fit", lambda train, candidate, *rest: fitted.append(1) or fit(train, candidate, *rest))
    ridge = [M.Candidate("ridge")]
    M.out_of_fold(rows, ridge, FACTORIES, store=store)
    (tmp_path / "cells").glob("cell-*").__next__().joinpath("_SUCCESS").unlink()
    M.out_of_fold(rows, ridge, FACTORIES, store=store)
    assert len(fitted) == 4
    M.out_of_fold(rows.withColumn("price", F.col("price") + 1), ridge, FACTORIES, store=store)
    assert len(fitted) == 7
    M.out_of_fold(rows, ridge, FACTORIES | {"ridge": lambda: M.regressors()["ridge"]().setRegParam(9.0)}, store=store)
    assert len(fitted) == 10
    shutil.rmtree(tmp_path / "cells")


def test_names_of_cells(rows):
    assert rows_digest(rows) == rows_digest(rows.repartition(5)) != rows_digest(rows.filter("entity > 0"))
    a, b = M.forest(10, 1), M.forest(10, 2)
    assert settings(a) == settings(M.forest(10, 1)) != settings(b)
    assert cell_name("x", 1) == cell_name("x", 1) != cell_name("x", 2)
