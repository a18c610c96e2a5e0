"""Distributed price and growth models on MLlib.

Candidates are described by data (name, target scale), fitted as MLlib pipelines, and compared by
out-of-fold predictions that stay DataFrames. Only model names, weights and metrics of a handful of
candidates reach the driver. Linear models look at one-hot categories, trees at nominal indices. Ensembles are saved and
loaded with their members, weights and cleaning rules (``EnsembleModel``, ``save_segments``); out-of-fold predictions can be
kept cell by cell (``cells.CellStore``), so that training goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from itertools import product
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import reference_area, safe_expm1
from ..session import checkpoint_dir, stored
from . import trees
from .cells import CellStore, cell_name, rows_digest, settings
from .clean import NUMERIC_COLUMNS, apply_median_encoding, learn_median_encoding
from .metrics import percentage_error, regression_metrics

CATEGORICAL_COLUMNS = ("district", "kind")
TOP_MODELS = 3
# A constant column sends the closed form to an iterative solver, which then has to come as close.
EXACT = {"maxIter": 1000, "tol": 1e-12}
SEED = 42
# Parts of a forest, each with a seed of its own.
PARTS = 8
MISSING = "(none)"


# ---------------------------------------------------------------- features and candidates
def feature_stages(numeric=NUMERIC_COLUMNS, categorical=CATEGORICAL_COLUMNS, out: str = "features") -> list:
    """Standardised numbers plus one-hot categories; an unseen category is all zeros."""
    index = [f"{c}__i" for c in categorical]
    onehot = [f"{c}__v" for c in categorical]
    return [
        StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep"),
        OneHotEncoder(inputCols=index, outputCols=onehot, dropLast=True),
        VectorAssembler(inputCols=list(numeric), outputCol="__numbers"),
        StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["__scaled", *onehot], outputCol=out),
    ]


def tree_stages(numeric=NUMERIC_COLUMNS, categorical=CATEGORICAL_COLUMNS, out: str = "features") -> list:
    """Numbers as they are and categories as nominal indices, which trees split into subsets; unseen categories share one index."""
    index = [f"{c}__i" for c in categorical]
    return [
        StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep"),
        VectorAssembler(inputCols=[*numeric, *index], outputCol=out),
    ]


def is_tree(estimator) -> bool:
    return estimator.hasParam("maxDepth")


def stages_for(estimator, numeric=NUMERIC_COLUMNS, categorical=CATEGORICAL_COLUMNS) -> list:
    return tree_stages(numeric, categorical) if is_tree(estimator) else feature_stages(numeric, categorical)


class Known:
    """What fits on the same rows and feature stages share: how many rows they have, and bins that follow from the features alone.

    ``asked``: the number of rows the fitted models predict, if they do so once. ``ready``, ``held``: few rows to fit on and to
    predict with their features, as tables.
    """

    def __init__(self, rows: int, asked: int | None = None) -> None:
        self.rows, self.asked = rows, asked
        self.ready: DataFrame | None = None
        self.held: DataFrame | None = None
        self.bins: dict[int, trees.Bins] = {}
        self.lock = Lock()

    def learn(self, rows: DataFrame, features: str, most: int) -> trees.Bins:
        with self.lock:
            if most in self.bins:
                return self.bins[most]
            made, _ = trees.learn_bins(rows, features, most, self.rows)
            if made.exact:
                self.bins[most] = made
            return made

    @property
    def once(self) -> bool:
        """Whether forests are asked once, about few rows and by few."""
        return self.asked is not None and self.asked <= trees.ASKED and self.rows <= trees.NODE_ROWS


def tree_rows(frame: DataFrame, label: str, known: Known | None = None) -> DataFrame:
    """What a tree learner sees. Its draws depend on partitions and their order; here both follow from the rows alone."""
    rows = frame.select("features", label)
    return rows.repartition(trees.blocks_for(known.rows if known else rows.count()), label).sortWithinPartitions(label, vector_to_array("features"))


def fit_on(estimator, frame: DataFrame, label: str, features: PipelineModel, known: Known | None = None) -> PipelineModel:
    """The fitted feature stages with the estimator fitted behind them."""
    ready = frame if known and known.ready is not None else features.transform(frame)
    estimator = estimator.copy({estimator.featuresCol: "features", estimator.labelCol: label})
    if is_tree(estimator):
        most = max([0, *(len(names) for s in features.stages if isinstance(s, StringIndexerModel) for names in s.labelsArray)])
        estimator = estimator.copy({estimator.maxBins: max(estimator.getMaxBins(), most + 1)})
        ready = tree_rows(ready, label, known)
        estimator.known = known
    return PipelineModel(stages=[*features.stages, estimator.fit(ready)])


def impute(df: DataFrame, numeric=NUMERIC_COLUMNS, categorical=CATEGORICAL_COLUMNS) -> DataFrame:
    """Constant imputation: 0 for numbers; null and empty categories are one of their own (``MISSING``, for a name can't be empty)."""
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric})
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(MISSING)) for c in categorical})


def regressors(trees: int = 400, rounds: int = 500, seed: int = SEED) -> dict[str, Callable]:
    """Candidate factories; the boosted and forest sizes are the published ones unless given."""
    return {
        "linear": lambda: LinearRegression(regParam=0.0, **EXACT),
        # The ridge penalty is stated on the sum of squares, the lasso's on its half mean; see ``penalised``.
        "ridge": lambda: LinearRegression(regParam=5.0, elasticNetParam=0.0, **EXACT),
        "lasso": lambda: LinearRegression(regParam=0.0005, elasticNetParam=1.0, maxIter=200),
        "forest": lambda: forest(trees, 2, seed),
        "boosting": lambda: Boosting(maxIter=rounds, stepSize=0.05, maxDepth=3, seed=seed),
    }


class SplitForest(RandomForestRegressor):
    """A forest of ``PARTS`` smaller ones, grown by ``trees.forest_table``.

    Part i draws with seed + i; the mean of the parts' predictions, weighted by their trees, is that of the whole forest.
    """

    def _fit(self, dataset: DataFrame) -> SplitForestModel:
        parts = min(PARTS, self.getNumTrees())
        sizes = [self.getNumTrees() // parts + (i < self.getNumTrees() % parts) for i in range(parts)]
        seeds = [((self.getSeed() + i) % (1 << 63), n) for i, n in enumerate(sizes)]
        features, label = self.getFeaturesCol(), self.getLabelCol()
        known, limits = getattr(self, "known", None), (self.getMaxDepth(), self.getMinInstancesPerNode())
        if known and known.once:
            bins = known.learn(dataset, features, self.getMaxBins())
            model = SplitForestModel(None, bins, seeds, features, self.getPredictionCol())
            model.ask = partial(trees.forest_held, table=trees.binned_table(dataset, features, label, bins), n=known.rows, bins=bins, seeds=seeds, depth=limits[0], least=limits[1])
            return model
        bins, rows = (known.learn(dataset, features, self.getMaxBins()), known.rows) if known else trees.learn_bins(dataset, features, self.getMaxBins())
        blocks = trees.binned_blocks(dataset, features, label, bins).persist()
        try:
            table = trees.forest_table(blocks, rows, bins, seeds, *limits, dataset.sparkSession)
        finally:
            blocks.unpersist()
        return SplitForestModel(table, bins, seeds, features, self.getPredictionCol())


@dataclass(frozen=True)
class _AskedTree:
    tree: trees.Tree
    bins: trees.Bins

    def predict(self, features) -> float:
        return float(self.tree.value[self.tree.leaves(self.bins.of(features.toArray()[None]), self.bins.nominal)][0])


@dataclass(frozen=True)
class ForestPart:
    """What a part of a forest was fitted with; its trees on demand."""

    forest: SplitForestModel
    place: int
    seed: int
    getNumTrees: int

    def getOrDefault(self, name: str):
        return {"seed": self.seed, "numTrees": self.getNumTrees}[name]

    @property
    def trees(self) -> list[_AskedTree]:
        rows = self.forest.table.filter(F.col("part") == self.place).orderBy("tree").collect()
        if any(r.leaf >= 0 for r in rows):
            raise ValueError("trees of many rows lie in several rows of the table")
        return [_AskedTree(trees.Tree.of(r, self.forest.bins), self.forest.bins) for r in rows]


class _Binned(Model, MLWritable, MLReadable):
    """A model that asks binned features; its trees are a table beside its params."""

    featuresCol = Param(Params._dummy(), "featuresCol", "column of the features", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "column of the predictions", TypeConverters.toString)

    def __init__(self, bins: trees.Bins | None = None, features: str = "features", out: str = "prediction"):
        super().__init__()
        self.bins = bins
        self._set(featuresCol=features, predictionCol=out)

    def described(self) -> dict:
        return {"cuts": [None if c is None else c.tolist() for c in self.bins.cuts], "sizes": list(self.bins.sizes)}

    def restore(self, found: dict, table: DataFrame) -> None:
        self.bins = trees.Bins([None if c is None else np.array(c, float) for c in found["cuts"]], found["sizes"])

    def write(self) -> MLWriter:
        return _BinnedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BinnedReader(cls)


class SplitForestModel(_Binned):
    """The mean of forests, weighted by their trees. One that is asked once has no table, but ``ask``."""

    def __init__(self, table: DataFrame | None = None, bins: trees.Bins | None = None, seeds: list[tuple[int, int]] | None = None, features: str = "features", out: str = "prediction"):
        super().__init__(bins, features, out)
        self.table, self.seeds = table, seeds or []

    @property
    def parts(self) -> list[ForestPart]:
        return [ForestPart(self, i, seed, n) for i, (seed, n) in enumerate(self.seeds)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        given = (self.getOrDefault(self.featuresCol), self.getOrDefault(self.predictionCol))
        if self.table is None:
            return self.ask(dataset, *given)
        return trees.forest_values(dataset, *given, self.table, sum(n for _, n in self.seeds), self.bins)

    def described(self) -> dict:
        return super().described() | {"seeds": [list(s) for s in self.seeds]}

    def restore(self, found: dict, table: DataFrame) -> None:
        super().restore(found, table)
        self.table, self.seeds = table, [tuple(s) for s in found["seeds"]]


class _Boosting(Estimator):
    """Rounds of small trees by ``trees.boost``; mixed into the estimators whose params it reads."""

    def _boosted(self, dataset: DataFrame, label: str, residual):
        checkpoint_dir(dataset.sparkSession)
        features = self.getFeaturesCol()
        known = getattr(self, "known", None)
        bins = known.learn(dataset, features, self.getMaxBins()) if known else trees.learn_bins(dataset, features, self.getMaxBins())[0]
        blocks = trees.binned_blocks(dataset, features, label, bins)
        made = trees.boost(blocks, bins, self.getMaxIter(), self.getStepSize(), self.getMaxDepth(), self.getMinInstancesPerNode(), residual)
        return made, bins, features, self.getPredictionCol()


class Boosting(_Boosting, GBTRegressor):
    """Gradient-boosted trees of the squared error."""

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        return BoostedModel(*self._boosted(dataset, self.getLabelCol(), trees.squared_residual))


class BoostingClassifier(_Boosting, GBTClassifier):
    """Gradient-boosted trees of the log loss for labels 0 and 1."""

    def _fit(self, dataset: DataFrame) -> BoostedClassifierModel:
        signed = dataset.withColumn("__signed", 2.0 * F.col(self.getLabelCol()) - 1.0)
        return BoostedClassifierModel(*self._boosted(signed, "__signed", trees.logistic_residual))


class BoostedModel(_Binned):
    """The sum of its trees."""

    def __init__(self, made: list[trees.Tree] | None = None, bins: trees.Bins | None = None, features: str = "features", out: str = "prediction"):
        super().__init__(bins, features, out)
        self.made = made or []

    @property
    def table(self) -> DataFrame:
        return SparkSession.active().createDataFrame([(0, i, -1, *t.columns()) for i, t in enumerate(self.made)], trees.TREES)

    def restore(self, found: dict, table: DataFrame) -> None:
        super().restore(found, table)
        self.made = [trees.Tree.of(r, self.bins) for r in table.orderBy("tree").collect()]

    def _value(self) -> Column:
        return trees.boosted_value(self.getOrDefault(self.featuresCol), self.made, self.bins)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOrDefault(self.predictionCol), self._value())


class BoostedClassifierModel(BoostedModel):
    """The logistic function of twice the sum of its trees."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = 1.0 / (1.0 + F.exp(-2.0 * F.col("__margin")))
        scored = dataset.withColumn("__margin", self._value()).withColumn("probability", array_to_vector(F.array(1.0 - p, p)))
        return scored.withColumn(self.getOrDefault(self.predictionCol), (F.col("__margin") > 0).cast("double")).drop("__margin")


class _BinnedWriter(MLWriter):
    """Params and bins of a model and, beside them, its trees."""

    def __init__(self, model: _Binned):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"described": self.model.described()})
        self.model.table.write.parquet(f"{path}/trees")


class _BinnedReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model.restore(found["described"], self.sparkSession.read.schema(trees.TREES).parquet(f"{path}/trees"))
        model._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(model, found)
        return model


class _PartsWriter(MLWriter):
    """Params of a model and, beside them, the models it holds."""

    def __init__(self, model: Model, parts: list):
        super().__init__()
        self.model, self.parts = model, parts

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"parts": len(self.parts)})
        for i, part in enumerate(self.parts):
            part.write().save(f"{path}/parts/{i}")


class _PartsReader(MLReader):
    def __init__(self, cls: type, part: type):
        super().__init__()
        self.cls, self.part = cls, part

    def load(self, path: str):
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls([self.part.load(f"{path}/parts/{i}") for i in range(found["parts"])])
        model._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(model, found)
        return model


def forest(trees: int, min_rows: int, seed: int = SEED) -> SplitForest:
    """Every split looks at all features; trees grow to the depth limit of the implementation."""
    return SplitForest(numTrees=trees, minInstancesPerNode=min_rows, maxDepth=30, featureSubsetStrategy="all", maxMemoryInMB=256, cacheNodeIds=True, seed=seed)


@dataclass(frozen=True)
class Candidate:
    """A regressor, the scale of its target and what it looks at."""

    model: str
    target: str = "price"  # "price", "log", "per_area" or "log_per_area"
    numeric: tuple = NUMERIC_COLUMNS
    categorical: tuple = CATEGORICAL_COLUMNS

    @property
    def name(self) -> str:
        return f"{self.model}({self.target})"


def _area() -> Column:
    """Reference area, 1 when unknown."""
    area = reference_area(F.col("area_private"), F.col("area_total"))
    return F.when(area > 0, area).otherwise(F.lit(1.0))


def target_column(target: str, price: str = "price") -> Column:
    y = F.col(price)
    if target.endswith("per_area"):
        y = y / _area()
    return F.log1p(y) if target.startswith("log") else y


def price_column(target: str, prediction: str) -> Column:
    """Back from the model's scale to a price; log predictions are capped."""
    y = F.col(prediction)
    if target.startswith("log"):
        y = F.expm1(y) if target.endswith("per_area") else safe_expm1(y)
    return y * _area() if target.endswith("per_area") else y


@dataclass
class Fitted:
    """A fitted pipeline that predicts prices."""

    candidate: Candidate
    pipeline: PipelineModel
    weight: float = 1.0

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        c = self.candidate
        return self._priced(self.pipeline.transform(impute(df, c.numeric, c.categorical)), df.columns, out)

    def predict_ready(self, ready: DataFrame, columns: list[str], out: str = "y_pred") -> DataFrame:
        """Predictions of rows that have gone through the feature stages."""
        return self._priced(self.pipeline.stages[-1].transform(ready), columns, out)

    def _priced(self, scored: DataFrame, columns: list[str], out: str) -> DataFrame:
        return scored.withColumn(out, price_column(self.candidate.target, "prediction")).select(*columns, out)


def penalised(estimator, frame: DataFrame, label: str):
    """The estimator with its penalty in the terms of its optimiser.

    The optimiser averages the loss over rows and divides it by the label's variance, the squared penalty by the standard
    deviation only; a ridge penalty on the sum of squares is therefore alpha * sd(label) / n. Coefficients are penalised on
    the scale of the given features, so one-hot columns are not scaled once more.
    """
    if not isinstance(estimator, LinearRegression) or estimator.getRegParam() == 0.0:
        return estimator
    changes = {estimator.standardization: False}
    if estimator.getElasticNetParam() == 0.0:
        n, sd = frame.agg(F.count(label), F.stddev_pop(label)).first()
        changes[estimator.regParam] = estimator.getRegParam() * (sd or 0.0) / max(n, 1)
    return estimator.copy(changes)


def _features(train: DataFrame, candidate: Candidate, estimator) -> PipelineModel:
    return Pipeline(stages=stages_for(estimator, candidate.numeric, candidate.categorical)).fit(impute(train, candidate.numeric, candidate.categorical))


def fit(
    train: DataFrame, candidate: Candidate, factories: dict[str, Callable], price: str = "price", features: PipelineModel | None = None, known: Known | None = None
) -> Fitted:
    """Fit one candidate on its target scale; ``features`` are its feature stages if they are fitted already, ``known`` goes with them."""
    estimator = factories[candidate.model]()
    features = features or _features(train, candidate, estimator)
    frame = known.ready if known and known.ready is not None else impute(train, candidate.numeric, candidate.categorical)
    frame = frame.withColumn("__y", target_column(candidate.target, price))
    return Fitted(candidate, fit_on(penalised(estimator, frame, "__y"), frame, "__y", features, known))


# ---------------------------------------------------------------- comparison
def out_of_fold(
    train: DataFrame,
    candidates: list[Candidate],
    factories: dict[str, Callable],
    fold: str = "fold",
    price: str = "price",
    parallelism: int = 8,
    store: CellStore | None = None,
) -> DataFrame:
    """Predictions of every candidate for rows of the fold it did not see, as (…, model, y_pred).

    Candidates that look at the same columns in the same way share a fold's fitted feature stages; ``parallelism`` fits run at a
    time. With a ``store`` every (fold, candidate) cell is written when it is done, and cells that are there are not fitted again.
    """
    sizes = {r[0]: r["n"] for r in train.groupBy(fold).agg(F.count("*").alias("n")).collect()}
    folds = sorted(sizes)
    cells = [(c, k) for c in candidates for k in folds]
    made = {c: factories[c.model]() for c in candidates}
    data = rows_digest(train) if store else ""
    names = {(c, k): cell_name(data, c.name, repr(c), settings(made[c]), fold, k, price) for c, k in cells} if store else {}
    todo = [cell for cell in cells if not store or not store.has(names[cell])]
    shared = {(k, c.numeric, c.categorical, is_tree(made[c])): c for c, k in todo}

    def stages(key):
        known, candidate = Known(sum(sizes.values()) - sizes[key[0]], sizes[key[0]]), shared[key]
        features = _features(train.filter(F.col(fold) != key[0]), candidate, made[candidate])
        if known.once:
            # All candidates read the same few rows, whose features are made once.
            ready = stored(features.transform(impute(train, candidate.numeric, candidate.categorical)).select(*train.columns, "features"))
            known.ready, known.held = ready.filter(F.col(fold) != key[0]), ready.filter(F.col(fold) == key[0])
        return key, (features, known)

    def one(task):
        candidate, k = task
        features, known = ready[k, candidate.numeric, candidate.categorical, is_tree(made[candidate])]
        fitted = fit(train.filter(F.col(fold) != k), candidate, factories, price, features, known)
        held = fitted.predict(train.filter(F.col(fold) == k)) if known.held is None else fitted.predict_ready(known.held, train.columns)
        held = held.withColumn("model", F.lit(candidate.name))
        if store:
            return store.put(names[task], held)
        # A forest that is asked once may be asked but once.
        return stored(held) if known.once and isinstance(made[candidate], SplitForest) else held

    with ThreadPool(parallelism) as pool:
        ready = dict(pool.map(inheritable_thread_target(stages), shared))
        parts = pool.map(inheritable_thread_target(one), todo, 1)
    return store.read([names[cell] for cell in cells]) if store else reduce(DataFrame.unionByName, parts)


def cv_leaderboard(predictions: DataFrame, keys: list[str] | None = None, y: str = "price") -> DataFrame:
    """MAE, RMSE, R2, MAPE and MdAPE of every model."""
    by = [*(keys or []), "model"]
    errors = percentage_error(predictions, by, y).drop("n")
    return regression_metrics(predictions, by, y).join(errors, by)


def inverse_weights(scores: list[tuple[str, float]]) -> dict[str, float]:
    """Weights proportional to 1 / error, summing to 1."""
    inverse = {name: 1.0 / max(float(error), 1e-9) for name, error in scores}
    total = sum(inverse.values())
    return {name: value / total for name, value in inverse.items()}


def top_members(board: DataFrame, metric: str = "mae", tie: str = "rmse", top: int = TOP_MODELS) -> list[tuple[str, float]]:
    """Names and errors of the best candidates; a leaderboard has one row per candidate."""
    order = [F.round(metric, 1), F.col(tie)] if metric == "mdape" else [F.col(metric), F.col(tie)]
    return [(r["model"], r[metric]) for r in board.orderBy(*order, "model").limit(top).collect()]


def combine(predictions: DataFrame, weights: dict[str, float], row_keys: list[str], out: str = "y_pred") -> DataFrame:
    """Weighted sum over models of long predictions (…, model, y_pred)."""
    pairs = [F.lit(x) for pair in weights.items() for x in pair]
    used = predictions.filter(F.col("model").isin(list(weights)))
    weighted = F.sum(F.create_map(*pairs)[F.col("model")] * F.col("y_pred"))
    return used.groupBy(*row_keys).agg(weighted.alias(out))


def predict_weighted(df: DataFrame, members: list[Fitted], out: str = "y_pred") -> DataFrame:
    """Weighted ensemble in one row pass: every member adds a column."""
    columns = []
    scored = df
    for i, member in enumerate(members):
        scored = member.predict(scored, f"__p{i}")
        columns.append(F.lit(member.weight) * F.col(f"__p{i}"))
    return scored.withColumn(out, sum(columns[1:], columns[0])).select(*df.columns, out)


def predict_median(df: DataFrame, members: list[Fitted], out: str = "y_pred") -> DataFrame:
    """Median of the members' predictions."""
    scored = df
    for i, member in enumerate(members):
        scored = member.predict(scored, f"__p{i}")
    ordered = F.array_sort(F.array(*[F.col(f"__p{i}") for i in range(len(members))]))
    half = len(members) // 2
    middle = F.get(ordered, half) if len(members) % 2 else (F.get(ordered, half - 1) + F.get(ordered, half)) / 2.0
    return scored.withColumn(out, middle).select(*df.columns, out)


class EnsembleModel(Model, MLWritable, MLReadable):
    """Fitted members and how their predictions are combined; saved and loaded as one model."""

    combine = Param(Params._dummy(), "combine", "weighted or median", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "column of the combined predictions", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "weight of each member", TypeConverters.toListFloat)
    candidates = Param(Params._dummy(), "candidates", "what each member is, as text", TypeConverters.toListString)

    def __init__(self, parts: list[PipelineModel] | None = None, candidates: list[Candidate] | None = None, weights: list[float] | None = None, combine: str = "weighted", out: str = "y_pred"):
        super().__init__()
        self.parts = parts or []
        described = [json.dumps([c.model, c.target, c.numeric, c.categorical]) for c in candidates or []]
        self._set(combine=combine, predictionCol=out, weights=weights or [], candidates=described)

    @classmethod
    def of(cls, members: list[Fitted], combine: str = "weighted", out: str = "y_pred") -> EnsembleModel:
        return cls([m.pipeline for m in members], [m.candidate for m in members], [m.weight for m in members], combine, out)

    @property
    def members(self) -> list[Fitted]:
        described = [json.loads(c) for c in self.getOrDefault(self.candidates)]
        made = [Candidate(model, target, tuple(numeric), tuple(categorical)) for model, target, numeric, categorical in described]
        return [Fitted(c, p, w) for c, p, w in zip(made, self.parts, self.getOrDefault(self.weights), strict=True)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        combined = predict_median if self.getOrDefault(self.combine) == "median" else predict_weighted
        return combined(dataset, self.members, self.getOrDefault(self.predictionCol))

    def write(self) -> MLWriter:
        return _PartsWriter(self, self.parts)

    @classmethod
    def read(cls) -> MLReader:
        return _PartsReader(cls, PipelineModel)


def save_segments(path: str, rules: PipelineModel, models: dict[str, EnsembleModel], spark: SparkSession) -> None:
    """Cleaning rules and an ensemble per segment below one folder; the list of segments is written last and makes it complete."""
    rules.write().save(f"{path}/rules")
    for i, model in enumerate(models.values()):
        model.write().save(f"{path}/segments/{i}")
    spark.createDataFrame(list(enumerate(models)), "place int, segment string").coalesce(1).write.parquet(f"{path}/index")


def load_segments(path: str, spark: SparkSession) -> tuple[PipelineModel, dict[str, EnsembleModel]]:
    """What ``save_segments`` wrote: a row per segment reaches the driver."""
    index = spark.read.parquet(f"{path}/index").orderBy("place").collect()
    return PipelineModel.load(f"{path}/rules"), {r["segment"]: EnsembleModel.load(f"{path}/segments/{r['place']}") for r in index}


def score_segments(rows: DataFrame, rules: PipelineModel, models: dict[str, EnsembleModel], segment: str = "kind", out: str = "estimate") -> DataFrame:
    """Rows cleaned with the rules and scored by the ensemble of their segment; rows of other segments have no estimate."""
    ready = stored(rules.transform(rows))
    parts = [predict_weighted(ready.filter(F.col(segment) == name), model.members, out) for name, model in models.items()]
    rest = ready.filter(~F.coalesce(F.col(segment).isin(list(models)), F.lit(False))).withColumn(out, F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, [*parts, rest])


def fit_members(train: DataFrame, candidates: list[Candidate], factories: dict[str, Callable], price: str = "price") -> list[Fitted]:
    """Candidates fitted on all given rows at the same time."""
    more = () if price == "price" else (price,)
    with ThreadPool(max(1, len(candidates))) as pool:
        return pool.map(inheritable_thread_target(lambda c: fit(train, c, factories, *more)), candidates)


def fit_ensemble(train: DataFrame, weights: dict[str, float], candidates: list[Candidate], factories: dict[str, Callable], price: str = "price") -> list[Fitted]:
    """Refit the chosen members on all given rows."""
    by_name = {c.name: c for c in candidates}
    out = fit_members(train, [by_name[name] for name in weights], factories, price)
    for fitted, weight in zip(out, weights.values(), strict=True):
        fitted.weight = weight
    return out


@dataclass
class SegmentModel:
    """What training one segment leaves behind."""

    segment: str
    leaderboard: DataFrame
    evaluation: list[Fitted]
    final: list[Fitted]
    weights: dict[str, float] = field(default_factory=dict)
    tested: list[Fitted] = field(default_factory=list)


def train_segment(
    prepared: DataFrame,
    final_rows: DataFrame | None,
    segment: str,
    candidates: list[Candidate],
    factories: dict[str, Callable],
    metric: str = "mae",
    tie: str = "rmse",
    store: CellStore | None = None,
    test_all: bool = False,
) -> SegmentModel:
    """Rank on the folds of the train part, fit the ensemble for evaluation, refit on everything.

    ``test_all``: every candidate is fitted for evaluation, not only the members of the ensemble.

    ``prepared``: part, fold and features, cleaned with rules of the train part. ``final_rows``:
    the segment cleaned with rules of all its rows; None leaves the final fit out.
    """
    train = prepared.filter("part = 'train'")
    board = cv_leaderboard(out_of_fold(train, candidates, factories, store=store))
    weights = inverse_weights(top_members(board, metric, tie))
    by_name = {m.candidate.name: m for m in fit_members(train, candidates, factories)} if test_all else {}
    return SegmentModel(
        segment,
        board,
        [replace(by_name[name], weight=weight) for name, weight in weights.items()] if test_all else fit_ensemble(train, weights, candidates, factories),
        fit_ensemble(final_rows, weights, candidates, factories) if final_rows is not None else [],
        weights,
        list(by_name.values()),
    )


# The published grids of the families that MLlib has; a depth of 30 is its limit and stands for none.
GRIDS = {
    "ridge": {"regParam": [0.1, 1.0, 5.0, 10.0, 20.0]},
    "lasso": {"regParam": [0.0001, 0.0005, 0.001, 0.005], "maxIter": [20000]},
    "forest": {"numTrees": [300], "maxDepth": [30, 20], "minInstancesPerNode": [1, 2]},
    "boosting": {"maxIter": [300, 500], "stepSize": [0.03, 0.05], "maxDepth": [2, 3]},
}


def grid_search(
    train: DataFrame, grids: dict[str, dict[str, list]], factories: dict[str, Callable], targets: tuple = ("price", "log"), fold: str = "fold", price: str = "price"
) -> tuple[list[Fitted], list[tuple[str, float]]]:
    """Every cell of every family's grid on every target scale, by the absolute error of its out-of-fold prices.

    Returns the winner of each family and scale, refitted on all rows, and the error of every cell; the first of equals wins.
    """
    made, winners, tried = {}, [], []
    for target in targets:
        for family, grid in grids.items():
            cells = []
            for values in product(*grid.values()):
                given = dict(zip(grid, values, strict=True))
                cells.append(Candidate(f"{family} {given}", target))
                estimator = factories[family]()
                made[cells[-1].model] = partial(estimator.copy, {estimator.getParam(p): v for p, v in given.items()})
            held = out_of_fold(train, cells, made, fold, price)
            error = {r["model"]: r["mae"] for r in held.groupBy("model").agg(F.avg(F.abs(F.col(price) - F.col("y_pred"))).alias("mae")).collect()}
            tried += [(c.name, error[c.name]) for c in cells]
            winners.append(fit(train, min(cells, key=lambda c: error[c.name]), made, price))
    return winners, tried


# ---------------------------------------------------------------- growth
GROWTH_NUMERIC = (
    "area_ref", "rooms", "baths", "parking", "log_price_m2", "relative_price", "months_listed",
    "previous_change", "segment_momentum", "kind_momentum",
)


def fit_growth(train: DataFrame, estimator, numeric=GROWTH_NUMERIC, target: str = "target") -> PipelineModel:
    """Expected log growth over the horizon."""
    frame = impute(train, numeric)
    return fit_on(penalised(estimator, frame, target), frame, target, Pipeline(stages=stages_for(estimator, numeric)).fit(frame))


def predict_growth(model: PipelineModel, df: DataFrame, numeric=GROWTH_NUMERIC, out: str = "y_pred") -> DataFrame:
    return model.transform(impute(df, numeric)).withColumn(out, F.col("prediction")).select(*df.columns, out)


def growth_regressors(trees: int = 300, rounds: int = 300, seed: int = SEED) -> dict[str, Callable]:
    """Candidates for the expected growth, with the published sizes unless given."""
    return {
        "ridge": lambda: LinearRegression(regParam=10.0, elasticNetParam=0.0, **EXACT),
        "forest": lambda: forest(trees, 10, seed),
        "boosting": lambda: Boosting(maxIter=rounds, maxDepth=4, stepSize=0.05, seed=seed),
    }


def classifiers(rounds: int = 300, seed: int = SEED) -> dict[str, Callable]:
    """Candidates for the price cut; the logistic penalty is one half of the squared coefficients beside the summed loss."""
    return {
        "logistic": lambda: LogisticRegression(maxIter=100, regParam=1.0, standardization=False),
        "boosting": lambda: BoostingClassifier(maxIter=rounds, stepSize=0.05, maxDepth=3, seed=seed),
    }


def fit_price_cut(train: DataFrame, estimator, band: float = 0.005, numeric=GROWTH_NUMERIC) -> PipelineModel:
    """Probability that the price falls by more than the band."""
    frame = impute(train, numeric).withColumn("label", (F.col("target") < -band).cast("double"))
    if isinstance(estimator, LogisticRegression):
        estimator = estimator.copy({estimator.regParam: estimator.getRegParam() / max(frame.count(), 1)})
    return fit_on(estimator, frame, "label", Pipeline(stages=stages_for(estimator, numeric)).fit(frame))


def predict_price_cut(model: PipelineModel, df: DataFrame, band: float = 0.005, numeric=GROWTH_NUMERIC) -> DataFrame:
    scored = model.transform(impute(df, numeric))
    return scored.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).withColumn(
        "label", (F.col("target") < -band).cast("int")
    ).select(*df.columns, "label", "p")


# ---------------------------------------------------------------- studies
def linear_coefficients(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Unpenalised least-squares coefficients as rows, with the intercept."""
    frame = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df.filter(F.col(target).isNotNull()))
    model = LinearRegression(labelCol=target, regParam=0.0, solver="normal").fit(frame)
    rows = [(f, float(c)) for f, c in zip(features, model.coefficients)] + [("intercept", float(model.intercept))]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def macro_candidates(trees: int = 300, rounds: int = 200, seed: int = SEED) -> dict[str, Callable]:
    return {
        "linear": lambda: LinearRegression(regParam=0.0),
        "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0, **EXACT),
        "forest": lambda: forest(trees, 5, seed),
        "boosting": lambda: Boosting(maxIter=rounds, maxDepth=2, stepSize=0.05, seed=seed),
    }


def macro_forecasts(split: DataFrame, features: list[str], factories: dict[str, Callable]) -> DataFrame:
    """Predictions of every candidate on the test part of every cut (long form)."""
    usable = split.dropna(subset=[*features, "target"])
    cuts = sorted(r[0] for r in usable.select("cut").distinct().collect())
    stages = [
        VectorAssembler(inputCols=features, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True),
    ]
    parts = []
    for cut in cuts:
        rows = usable.filter(F.col("cut") == F.lit(cut))
        train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
        for name, make in factories.items():
            model = fit_on(penalised(make(), train, "target"), train, "target", Pipeline(stages=stages).fit(train))
            parts.append(model.transform(test).select(*rows.columns, "prediction").withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def forecast_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE and MAE in percentage points and the share of correct signs."""
    error = F.col("prediction") - F.col("target")
    same = F.when(F.signum("prediction") == F.signum("target"), 1.0).otherwise(0.0)
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("rmse_pp"),
        F.avg(F.abs(error)).alias("mae_pp"),
        (100.0 * F.avg(same)).alias("sign_pct"),
        F.count("*").alias("n"),
    )


def implied_past(df: DataFrame, members: list[Fitted], years: list[float], year: str = "year") -> DataFrame:
    """Annual rate the model implies between each past year and today, per row.

    Rows with a non-positive prediction are left out.
    """
    today = predict_weighted(df, members, "today")
    past = today.withColumn("__now", F.col(year)).withColumn(year, F.explode(F.array(*[F.lit(float(y)) for y in years])))
    past = predict_weighted(past, members, "past").filter("today > 0 AND past > 0")
    span = F.col("__now") - F.col(year)
    ratio = F.col("past") / F.col("today")
    return past.withColumn("ratio", ratio).withColumn("annual_pct", (F.pow(ratio, -1.0 / span) - 1) * 100.0).drop("__now")


def variant_frames(train: DataFrame, test: DataFrame, variant: str) -> tuple[DataFrame, DataFrame, str, tuple]:
    """(train, test, target scale, numeric columns) of a variant of the price model.

    ``district`` adds the median price per area of the district learned on train; ``m2`` models the
    price per area; ``inflation`` brings train prices to the reference month by their factor.
    """
    numeric, target = NUMERIC_COLUMNS, "price"
    if variant in ("m2", "district+m2"):
        target = "per_area"
    if variant in ("district", "district+m2"):
        per, overall = learn_median_encoding(train.withColumn("__pm2", F.col("price") / _area()), "district", "__pm2")
        # A fit reads its rows several times; the medians are learned and joined once.
        train = stored(apply_median_encoding(train, per, overall, "district", "district_m2"))
        test = stored(apply_median_encoding(test, per, overall, "district", "district_m2"))
        numeric = (*numeric, "district_m2")
    if variant == "inflation":
        train = train.withColumn("price", F.col("price") * F.col("inflation_factor"))
    return train, test, target, numeric
