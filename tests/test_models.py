"""Model wrappers: scales, weights, unseen categories."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from pricetide.operators import models as M
from pricetide.plans import catalog, linear_sql, q_models

FACTORIES = M.regressors(trees=5, rounds=3)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select(
        F.col("id").alias("entity"),
        (50.0 + F.col("id") % 80).alias("area_total"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(45.0 + F.col("id") % 80).alias("area_private"),
        (F.col("id") % 4).cast("int").alias("rooms"),
        F.lit(1).alias("baths"),
        (F.col("id") % 2).cast("int").alias("parking"),
        F.concat(F.lit("d"), (F.col("id") % 6).cast("string")).alias("district"),
        F.lit("Casa").alias("kind"),
        (F.col("id") % 3).cast("int").alias("fold"),
    )
    price = 2000.0 * F.col("area_total") + 10000.0 * F.col("rooms")
    return df.withColumn("price", price).cache()


@pytest.mark.parametrize("target", ["price", "log", "per_area", "log_per_area"])
def test_every_target_scale_predicts_prices(rows, target):
    fitted = M.fit(rows, M.Candidate("linear", target), FACTORIES)
    error = fitted.predict(rows).agg(F.avg(F.abs(F.col("y_pred") - F.col("price")) / F.col("price"))).first()[0]
    assert error < (0.001 if target == "price" else 0.25)


def test_unseen_district_is_scored(spark, rows):
    fitted = M.fit(rows, M.Candidate("ridge"), FACTORIES)
    new = rows.limit(1).withColumn("district", F.lit("never seen"))
    assert fitted.predict(new).first()["y_pred"] > 0


def test_ensemble_weights_and_combination(rows):
    candidates = [M.Candidate("linear"), M.Candidate("ridge"), M.Candidate("forest")]
    held = M.out_of_fold(rows, candidates, FACTORIES).cache()
    assert held.count() == 3 * rows.count()
    board = M.cv_leaderboard(held)
    weights = M.inverse_weights(M.top_members(board, top=2))
    assert len(weights) == 2 and sum(weights.values()) == pytest.approx(1.0)
    best = sorted(board.collect(), key=lambda r: (r["mae"], r["rmse"]))[:2]
    assert set(weights) == {r["model"] for r in best}
    mixed = M.combine(held, weights, ["entity", "price"])
    assert mixed.count() == rows.count()
    assert M.inverse_weights([("a", 1.0), ("b", 3.0)]) == {"a": 0.75, "b": 0.25}


def test_median_ensemble_lies_between(rows):
    members = [M.fit(rows, M.Candidate(m), FACTORIES) for m in ("linear", "forest", "boosting")]
    scored = rows
    for i, member in enumerate(members):
        scored = member.predict(scored, f"p{i}")
    scored = M.predict_median(scored, members)
    assert scored.filter("y_pred < least(p0, p1, p2) OR y_pred > greatest(p0, p1, p2)").count() == 0


def _design(rows):
    """Standardised numbers (sample deviation) and one-hot districts, as the feature stages make them."""
    import numpy as np

    numbers = np.array([[float(r[c]) for c in M.NUMERIC_COLUMNS] for r in rows])
    sd = numbers.std(0, ddof=1)
    scaled = np.where(sd > 0, (numbers - numbers.mean(0)) / np.where(sd > 0, sd, 1), 0.0)
    names = sorted({r["district"] for r in rows})
    onehot = np.array([[float(r["district"] == n) for n in names] for r in rows])
    return np.column_stack((scaled, onehot, np.ones(len(rows))))


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_ridge_is_the_closed_form(rows, scale):
    """min |y - Xw - b|^2 + alpha |w|^2, whatever the scale of the target."""
    import numpy as np

    noisy = rows.withColumn("price", (F.col("price") + 9000.0 * ((F.col("entity") * 37) % 11)) / 1e4 * scale).cache()
    got = {r["entity"]: r["y_pred"] for r in M.fit(noisy, M.Candidate("ridge"), {"ridge": lambda: LinearRegression(regParam=200.0)}).predict(noisy).collect()}
    data = noisy.collect()
    x, y = _design(data), np.array([r["price"] for r in data])
    x = np.column_stack((x[:, :-1], np.ones(len(x)) * 0 + 1.0, x[:, -1]))  # one kind: its indicator is constant
    penalty = np.diag([200.0] * (x.shape[1] - 1) + [0.0])
    w = np.linalg.lstsq(x.T @ x + penalty, x.T @ y, rcond=None)[0]
    assert [got[r["entity"]] for r in data] == pytest.approx((x @ w).tolist(), rel=2e-3)


def test_logistic_penalty_is_one_half_square_beside_the_summed_loss(spark, rows):
    made = M.classifiers()["logistic"]()
    frame = rows.withColumn("target", F.when(F.col("entity") % 5 == 0, -0.1).otherwise(0.1))
    fitted = M.fit_price_cut(frame, made, numeric=M.NUMERIC_COLUMNS).stages[-1]
    assert fitted.getRegParam() == pytest.approx(1.0 / 400) and fitted.getStandardization() is False


def test_forests_look_at_all_features():
    for made in (M.regressors()["forest"](), M.macro_candidates()["forest"](), M.growth_regressors()["forest"]()):
        assert made.getFeatureSubsetStrategy() == "all" and made.getMaxDepth() == 30
    assert M.regressors()["forest"]().getNumTrees() == 400 and M.growth_regressors()["boosting"]().getMaxIter() == 300


def test_grid_search_tries_every_cell_and_keeps_each_familys_best(rows):
    grids = {"ridge": {"regParam": [1e6, 0.1]}, "forest": {"numTrees": [2], "maxDepth": [1, 6]}}
    winners, tried = M.grid_search(rows, grids, FACTORIES)
    assert len(tried) == 8 and len({name for name, _ in tried}) == 8
    error = dict(tried)
    for member, family in zip(winners, ("ridge", "forest", "ridge", "forest"), strict=True):
        name = member.candidate.name
        assert name.startswith(family) and error[name] == min(e for n, e in tried if n.startswith(family) and n.endswith(f"({member.candidate.target})"))
    assert winners[0].candidate.model == "ridge {'regParam': 0.1}"
    assert {f: len(list(M.product(*g.values()))) for f, g in M.GRIDS.items()} == {"ridge": 5, "lasso": 4, "forest": 4, "boosting": 8}


@pytest.mark.parametrize("name", ["growth_model", "price_cut_classifier", "macro_models", "grid_search", "median_ensemble", "batch_score"])
def test_registered_queries_train_at_published_sizes(spark, sf, monkeypatch, name):
    """The sizes of what would be trained; the first fit ends the query."""
    seen = []

    class Enough(Exception):
        pass

    def sizes(factories):
        made = [make() for make in factories.values()]
        seen.append([e.getNumTrees() if e.hasParam("numTrees") else e.getMaxIter() for e in made if e.hasParam("maxDepth")])
        raise Enough

    monkeypatch.setattr(q_models, "prepared", lambda *_: spark.createDataFrame([("train", "k", 0)], "part string, kind string, fold int"))
    monkeypatch.setattr(q_models, "_growth_parts", lambda *_: (None, None))
    monkeypatch.setattr(q_models, "embargoed", lambda *_: spark.range(1))
    monkeypatch.setattr(M, "fit", lambda train, candidate, factories: sizes(factories))
    monkeypatch.setattr(M, "macro_forecasts", lambda split, features, factories: sizes(factories))
    monkeypatch.setattr(M, "train_segment", lambda *a: seen.append([c.name for c in a[3]]) or sizes(a[4]))
    monkeypatch.setattr(M, "grid_search", lambda train, grids, factories: seen.append(grids) or sizes(factories))
    for maker in ("growth_regressors", "classifiers"):
        monkeypatch.setattr(M, maker, lambda *a, make=getattr(M, maker), **k: sizes(make(*a, **k)))
    monkeypatch.setattr(q_models.clean, "leakfree_prepare", lambda *_: spark.createDataFrame([("k",)], "kind string"))
    with pytest.raises(Enough):
        catalog.queries()[name](spark, sf)
    assert seen[-1] == {"growth_model": [300, 300], "price_cut_classifier": [300], "macro_models": [300, 200]}.get(name, [400, 500])
    if name == "grid_search":
        assert seen[0] is M.GRIDS
    if name == "batch_score":
        assert len(seen[0]) == 10


@pytest.mark.parametrize("penalty", [0.0005, 2000.0])
def test_lasso_coefficients_satisfy_the_optimality_conditions(rows, penalty):
    """For half the mean squared error plus the penalty: every feature's gradient is the penalty with the coefficient's sign, or below it at 0."""
    uneven = rows.withColumn("price", F.col("price") * (1.0 + (F.col("entity") * 37 % 101) / 200.0))
    fitted = M.fit(uneven, M.Candidate("lasso"), {"lasso": lambda: LinearRegression(regParam=penalty, elasticNetParam=1.0, maxIter=1000, tol=1e-12)})
    model = fitted.pipeline.stages[-1]
    scored = fitted.pipeline.transform(M.impute(uneven)).select("features", "price", "prediction").collect()
    x = np.array([r["features"].toArray() for r in scored])
    left = np.array([r["price"] - r["prediction"] for r in scored])
    gradient, weights = x.T @ left / len(left), np.array(model.coefficients)
    assert abs(left.mean()) < 1e-3
    assert np.abs(gradient).max() <= penalty + 1e-2
    used = np.abs(weights) > 1e-6
    assert used.any() and np.allclose(gradient[used], penalty * np.sign(weights[used]), atol=1e-2)
    if penalty > 1:
        assert not used.all()


def test_lasso_twin_shrinks_like_the_model(spark, rows):
    """The SQL twin's coordinate descent and the model at a penalty that removes features."""
    penalty = 2000.0
    price = F.col("price") * (1.0 + (F.col("entity") * 37 % 101) / 200.0)
    uneven = rows.withColumn("price", price)
    fitted = M.fit(uneven, M.Candidate("lasso"), {"lasso": lambda: LinearRegression(regParam=penalty, elasticNetParam=1.0, maxIter=1000, tol=1e-12)})
    want = {r["entity"]: r["y_pred"] for r in fitted.predict(uneven).collect()}
    con = duckdb.connect()
    con.register("listing", uneven.toPandas())
    given = "SELECT 1 AS g, 'fit' AS role, price AS y, * FROM listing UNION ALL SELECT 1, 'eval', price, * FROM listing"
    got = dict(con.execute(f"WITH RECURSIVE given AS ({given}), {linear_sql.lasso('given', penalty)} SELECT entity, raw FROM raw").fetchall())
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 0.5
