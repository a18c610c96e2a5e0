"""Price, growth and macro models.

Models train at the published sizes, also in all comparisons: by kind, over the grids and on folds.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..operators import clean, metrics, models
from ..operators import index as I
from ..operators import panel as P
from ..operators.cells import CellStore
from ..operators.rates import distribution
from ..session import stored
from . import bindings as B
from . import linear_sql
from .q_index import FEATURES, MACRO, PAST_YEARS, embargoed, macro
from .q_panel import TEST_MONTHS, month_text, rounded
from .registry import query

PUBLISHED = models.regressors()
FOLDS = 5
SEGMENTS_AT_ONCE = 3


def listings(spark, sf) -> DataFrame:
    """The latest observation of every part as a listing."""
    lines = B.table(spark, sf, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
    )
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    latest = lines.groupBy(F.col("l_partkey").alias("entity")).agg(
        F.max_by(F.struct("l_extendedprice", "l_quantity", "l_linenumber"), order).alias("r"), month_start(F.max("l_shipdate").cast("date")).alias("month")
    )
    part = B.table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("district"), F.col("p_type").alias("kind"), "p_size")
    # Parts grow with the data, so both sides are shuffled by part and none of them is broadcast from the driver.
    return latest.join(part.hint("merge"), "entity").select(
        "entity", "month", "district", "kind",
        F.col("r.l_extendedprice").alias("price"),
        F.col("r.l_quantity").alias("area_total"),
        F.when(F.col("entity") % 3 == 0, 0.0).otherwise(F.col("r.l_quantity")).alias("area_private"),
        (F.col("p_size") % 5 + 1).cast("int").alias("rooms"),
        F.col("r.l_linenumber").alias("baths"),
        (F.col("entity") % 4).cast("int").alias("parking"),
    )


def prepared(spark, sf) -> DataFrame:
    """Hold-out parts, folds and leak-free cleaning, as a table."""
    # The rules read the rows several times; written first, they are taken from the line items once.
    rows = stored(clean.group_folds(clean.holdout_split(listings(spark, sf), "entity"), "entity", FOLDS))
    return stored(clean.leakfree_prepare(rows, ["kind"]))


# Constant columns (one district left in a small table) send the solver from its closed form to iterations.
DIGITS = {"mae": 0, "rmse": 0, "r2": 4, "mape": 2, "within_10_pct": 2, "within_20_pct": 2, "mdape": 2}


def scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics of scored rows, rounded, with a row for the typical part of the test."""
    both = df.withColumn("rows", F.explode(F.when(F.col("typical"), F.array(F.lit("full"), F.lit("typical"))).otherwise(F.array(F.lit("full")))))
    by = [*keys, "rows"]
    out = metrics.regression_metrics(both, by, "price").join(metrics.percentage_error(both, by, "price").drop("n"), by)
    return out.withColumns({c: F.round(c, n) for c, n in DIGITS.items()})


def kinds(rows: DataFrame) -> list[str]:
    """The kinds the data holds, one segment each."""
    return sorted(r[0] for r in rows.select("kind").distinct().collect())


def _single(spark, sf, model: str, target: str = "price") -> DataFrame:
    rows = prepared(spark, sf)
    fitted = models.fit(rows.filter("part = 'train'"), models.Candidate(model, target), PUBLISHED)
    return scores(fitted.predict(rows.filter("part = 'test'")), ["kind"])


@query("feature_encoding", linear_sql.ENCODED)
def feature_encoding(spark, sf):
    """The encoded feature vector of every listing, fitted on the train part."""
    rows = models.impute(prepared(spark, sf))
    fitted = Pipeline(stages=models.feature_stages()).fit(rows.filter("part = 'train'"))
    array = vector_to_array("features")
    return fitted.transform(rows).select("entity", F.size(array).alias("width"), F.round(F.aggregate(array, F.lit(0.0), lambda a, x: a + x), 8).alias("total"))


@query("ridge_regression", linear_sql.single("price"))
def ridge_regression(spark, sf):
    return _single(spark, sf, "ridge")


@query("lasso_regression", linear_sql.single("price", linear_sql.lasso("given")))
def lasso_regression(spark, sf):
    return _single(spark, sf, "lasso")


@query("linear_regression", linear_sql.single("price", linear_sql.ridge("given", linear_sql.NO_PENALTY)))
def linear_regression(spark, sf):
    return _single(spark, sf, "linear")


@query("rf_regression")
def rf_regression(spark, sf):
    return _single(spark, sf, "forest")


@query("gbt_regression")
def gbt_regression(spark, sf):
    return _single(spark, sf, "boosting")


@query("log_target", linear_sql.single("log"))
def log_target(spark, sf):
    return _single(spark, sf, "ridge", "log")


@query("per_area_target", linear_sql.single("per_area"))
def per_area_target(spark, sf):
    return _single(spark, sf, "ridge", "per_area")


CANDIDATES = [models.Candidate(m, t) for t in ("price", "log") for m in ("linear", "ridge", "lasso", "forest", "boosting")]


def _segment(rows: DataFrame, kind: str, part: str) -> DataFrame:
    return rows.filter((F.col("kind") == kind) & (F.col("part") == part))


@query("cv_leaderboard")
def cv_leaderboard(spark, sf):
    """Candidates ranked by out-of-fold predictions of the train part."""
    train = prepared(spark, sf).filter("part = 'train'")
    board = models.cv_leaderboard(models.out_of_fold(train, CANDIDATES, PUBLISHED, store=_store(spark)))
    return board.orderBy("mae", "rmse")


@query("grid_search")
def grid_search(spark, sf):
    """The published grids by cross-validation, and each family's winner on the test part."""
    rows = prepared(spark, sf)
    best, tried = models.grid_search(rows.filter("part = 'train'"), models.GRIDS, PUBLISHED)
    table = spark.createDataFrame([("cv", p, float(s)) for p, s in tried], "stage string, parameters string, mae double")
    for member in best:
        test = scores(member.predict(rows.filter("part = 'test'")), [])
        table = table.unionByName(test.select(F.concat(F.lit("test "), "rows").alias("stage"), F.lit(member.candidate.name).alias("parameters"), "mae"))
    return table


def _ensemble(spark, sf, metric: str, tie: str):
    rows = prepared(spark, sf)
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    board = models.cv_leaderboard(models.out_of_fold(train, CANDIDATES, PUBLISHED, store=_store(spark)))
    weights = models.inverse_weights(models.top_members(board, metric, tie))
    return train, test, weights


@query("weighted_ensemble")
def weighted_ensemble(spark, sf):
    """Best three candidates weighted by 1 / MAE, scored on the untouched test part."""
    train, test, weights = _ensemble(spark, sf, "mae", "rmse")
    members = models.fit_ensemble(train, weights, CANDIDATES, PUBLISHED)
    return scores(models.predict_weighted(test, members), ["kind"])


@query("mdape_ensemble")
def mdape_ensemble(spark, sf):
    """Weights by 1 / MdAPE; the ensemble competes with its members on the same out-of-fold rows."""
    train = prepared(spark, sf).filter("part = 'train'")
    held = models.out_of_fold(train, CANDIDATES, PUBLISHED, store=_store(spark)).select("entity", "price", "model", "y_pred")
    board = models.cv_leaderboard(held)
    weights = models.inverse_weights(models.top_members(board, "mdape", "mae"))
    mixed = models.combine(held, weights, ["entity", "price"]).withColumn("model", F.lit("ensemble"))
    both = held.unionByName(mixed)
    order = metrics.published_order()
    return models.cv_leaderboard(both).orderBy(*order)


@query("median_ensemble")
def median_ensemble(spark, sf):
    rows = prepared(spark, sf)
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    members = models.fit_members(train, [models.Candidate(m) for m in ("boosting", "forest", "ridge")], PUBLISHED)
    return scores(models.predict_median(test, members), ["kind"])


def _store(spark) -> CellStore:
    """A folder of this run's out-of-fold cells."""
    return CellStore(spark, B.shared_folder(spark, "cells"))


def _train_segments(spark, sf, refit: bool = False, test_all: bool = False):
    """One model set per segment: an evaluation fit on train (with ``test_all`` of all candidates) and, with ``refit``, a final fit on everything."""
    rows = prepared(spark, sf)
    store = _store(spark)
    final = None
    if refit:
        everything = clean.price_per_area_column(listings(spark, sf)).withColumn("part", F.lit("train"))
        final = stored(clean.leakfree_prepare(everything, ["kind"]))

    def train(kind):
        everything = final.filter(F.col("kind") == kind) if refit else None
        return models.train_segment(rows.filter(F.col("kind") == kind), everything, kind, CANDIDATES, PUBLISHED, "mae", "rmse", store, test_all)

    with ThreadPool(SEGMENTS_AT_ONCE) as pool:
        return rows, pool.map(inheritable_thread_target(train), kinds(rows), 1)


@query("segmented_training")
def segmented_training(spark, sf):
    rows, trained = _train_segments(spark, sf)
    scored = [models.predict_weighted(_segment(rows, t.segment, "test"), t.evaluation) for t in trained]
    return scores(reduce(DataFrame.unionByName, scored), ["kind"])


def train_and_save(spark, sf) -> str:
    """Trains every segment, and leaves the final ensembles and the cleaning rules of their rows in a folder."""
    _, trained = _train_segments(spark, sf, refit=True)
    rules = Pipeline(stages=[clean.RareCategories("district", ["kind"]), clean.QuantileClip(by=["kind"])])
    folder = B.shared_folder(spark, "segments")
    models.save_segments(folder, rules.fit(listings(spark, sf)), {t.segment: models.EnsembleModel.of(t.final) for t in trained}, spark)
    return folder


@query("batch_score")
def batch_score(spark, sf):
    """Final segment models over all current listings: models and cleaning rules as training saved them, read back."""
    rules, saved = models.load_segments(train_and_save(spark, sf), spark)
    scored = models.score_segments(clean.price_per_area_column(listings(spark, sf)), rules, saved)
    return scored.select("entity", "kind", "district", "price", "estimate")


@query("leaderboard_table")
def leaderboard_table(spark, sf):
    """Position, chosen flag, cross-validated and test errors of every candidate by segment."""
    rows, trained = _train_segments(spark, sf, test_all=True)
    parts = []
    for t in trained:
        board = metrics.leaderboard(t.leaderboard.withColumn("kind", F.lit(t.segment)), ["kind"], metrics.published_order())
        board = board.withColumn("chosen", F.col("model").isin(list(t.weights)))
        tested = []
        for member in t.tested:
            scored = member.predict(_segment(rows, t.segment, "test"))
            tested.append(scored.withColumn("model", F.lit(member.candidate.name)))
        test = scores(stored(reduce(DataFrame.unionByName, tested)), ["model"])
        wide = test.groupBy("model").pivot("rows", ["typical", "full"]).agg(F.first("mae").alias("mae"), F.first("mdape").alias("mdape"))
        parts.append(board.select("kind", "model", "position", "chosen", F.col("mae").alias("cv_mae"), F.col("mdape").alias("cv_mdape")).join(wide, "model", "left"))
    return reduce(DataFrame.unionByName, parts)


@query("cleaning_scenarios", linear_sql.SCENARIOS)
def cleaning_scenarios(spark, sf):
    """Four ways to clean and fit, all measured on one common test set."""
    rows = clean.price_per_area_column(listings(spark, sf))
    split = clean.holdout_split(rows, "entity")
    fences = clean.learn_iqr(split.filter("part = 'train'"), by=["kind"])
    marked = stored(clean.mark_iqr(split, fences, by=["kind"]))
    train, test = marked.filter("part = 'train'"), marked.filter("part = 'test'")
    plain, log = models.Candidate("ridge"), models.Candidate("ridge", "log")

    def one(name, frame, candidate):
        return models.fit(frame, candidate, PUBLISHED).predict(test).withColumn("scenario", F.lit(name))

    split_models = [
        models.fit(train.filter(F.col("kind") == k), plain, PUBLISHED).predict(test.filter(F.col("kind") == k)) for k in kinds(marked)
    ]
    parts = [
        one("1 single model", train, plain),
        reduce(DataFrame.unionByName, split_models).withColumn("scenario", F.lit("2 model per kind")),
        one("3 without outliers", train.filter("typical"), plain),
        one("4 without outliers, log price", train.filter("typical"), log),
    ]
    return scores(reduce(DataFrame.unionByName, parts), ["scenario"])


@query("variant_experiment", linear_sql.VARIANTS)
def variant_experiment(spark, sf):
    """Variants of features and target on the same split, as one table."""
    rows = prepared(spark, sf)
    levels = stored(B.market_levels(spark, sf))
    rows = stored(I.with_month_factor(rows, levels, "month", F.lit("2001-08-01").cast("date"), "inflation_factor"))
    parts = []
    for variant in ("base", "district", "m2", "district+m2", "inflation"):
        train, test, target, numeric = models.variant_frames(rows.filter("part = 'train'"), rows.filter("part = 'test'"), variant)
        fitted = models.fit(train, models.Candidate("ridge", target, numeric), PUBLISHED)
        scored = fitted.predict(test)
        if variant == "inflation":
            scored = scored.withColumn("y_pred", F.col("y_pred") / F.col("inflation_factor"))
        parts.append(scored.select("price", "typical", "y_pred").withColumn("variant", F.lit(variant)))
    return scores(stored(reduce(DataFrame.unionByName, parts)), ["variant"])


# ---------------------------------------------------------------- back-cast training
def _backcast_rows(spark, sf):
    """Train listings at the reference month and their past, test listings, both with a year."""
    levels = stored(B.market_levels(spark, sf))
    rows = prepared(spark, sf)
    dated = I.to_reference_month(rows, levels)
    train = stored(dated.filter("part = 'train'"))
    past = I.backcast(train, levels, PAST_YEARS)
    return stored(train.unionByName(past)), dated.filter("part = 'test'")


NUMERIC_YEAR = (*models.NUMERIC_COLUMNS, "year")


@query("backcast_training", linear_sql.backcast_training(PAST_YEARS, FOLDS))
def backcast_training(spark, sf):
    """Real and simulated rows in grouped folds; errors count real rows only."""
    train, _ = _backcast_rows(spark, sf)
    held = models.out_of_fold(train, [models.Candidate("ridge", "log", NUMERIC_YEAR)], PUBLISHED)
    board = models.cv_leaderboard(held.filter("simulated = 0"), ["kind"])
    return board.withColumns({c: F.round(c, n) for c, n in DIGITS.items()})


IMPLIED_YEARS = [1996, 2000]


@query("implied_past", linear_sql.implied_past(PAST_YEARS, IMPLIED_YEARS))
def implied_past(spark, sf):
    """Annual rate a model trained on the back-cast implies for past years."""
    train, test = _backcast_rows(spark, sf)
    member = models.fit(train, models.Candidate("ridge", "log", NUMERIC_YEAR), PUBLISHED)
    years = [y + 5.5 / 12.0 for y in IMPLIED_YEARS]
    out = models.implied_past(test, [member], years)
    return rounded(distribution(out, ["kind", "year"], "annual_pct"), 4)


# ---------------------------------------------------------------- growth
def _growth_parts(spark, sf):
    parted = P.temporal_split(stored(B.pairs(spark, sf, 1)), TEST_MONTHS)
    rare = clean.learn_rare(parted.filter("part = 'train'"))
    ready = stored(clean.apply_rare(parted, rare))
    return ready.filter("part = 'train'"), ready.filter("part = 'test'")


@query("growth_model")
def growth_model(spark, sf):
    """Expected growth of each listing over the next month against both naive forecasts."""
    train, test = _growth_parts(spark, sf)
    makers = {name: make() for name, make in models.growth_regressors().items()}
    parts = [P.segment_mean_baseline(train, test, "target", "y_pred").withColumn("model", F.lit("segment mean"))]
    parts.append(test.withColumn("y_pred", F.lit(0.0)).withColumn("model", F.lit("no change")))
    for name, estimator in makers.items():
        parts.append(models.predict_growth(models.fit_growth(train, estimator), test).withColumn("model", F.lit(name)))
    return metrics.growth_metrics(reduce(DataFrame.unionByName, parts), ["model"], "target", "y_pred")


@query("price_cut_classifier")
def price_cut_classifier(spark, sf):
    """Probability of a price cut: AUC and Brier score beside the historical rate."""
    train, test = _growth_parts(spark, sf)
    parts = []
    for name, make in models.classifiers().items():
        scored = models.predict_price_cut(models.fit_price_cut(train, make()), test)
        parts.append(scored.select("label", "p").withColumn("model", F.lit(name)))
    rate = train.agg(F.avg((F.col("target") < -0.005).cast("double"))).scalar()
    base = test.select((F.col("target") < -0.005).cast("int").alias("label")).withColumn("p", rate)
    parts.append(base.withColumn("model", F.lit("historical rate")))
    return metrics.auc_brier(reduce(DataFrame.unionByName, parts), ["model"])


# ---------------------------------------------------------------- macro
@query("macro_coefficients", f"WITH RECURSIVE {MACRO}, " + linear_sql.least_squares("macro", FEATURES, "target"))
def macro_coefficients(spark, sf):
    out = models.linear_coefficients(stored(macro(spark, sf)), FEATURES, "target")
    return out.withColumn("coefficient", F.round("coefficient", 5))


@query("macro_models")
def macro_models(spark, sf):
    """Candidates over the embargoed cuts, beside the naive references."""
    split = stored(embargoed(spark, sf))
    learned = models.macro_forecasts(split, FEATURES, models.macro_candidates())
    naive = I.naive_forecasts(split.filter("part = 'test'"))
    columns = ["cut", "model", "prediction", "target"]
    both = learned.select(*columns).unionByName(naive.select(*columns))
    return month_text(models.forecast_metrics(both, ["cut", "model"]), "cut")
