"""Cleaning rules learned on one part of the data and applied to another.

Every rule is a small DataFrame keyed by the group it was learned in. The ML wrappers give the same
rules a fit/transform contract, so a Pipeline or cross-validation never looks at held-out rows.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, uniform
from ..session import stored
from .ordered import Quantile, aggregate, attach, join_keys

RARE_MIN_COUNT = 10
RARE_LABEL = "outros"
CLIP_QUANTILES = (0.02, 0.98)
MIN_VALUES = 8
IQR_FACTOR = 1.5
NUMERIC_COLUMNS = ("area_total", "area_private", "rooms", "baths", "parking")
IQR_COLUMNS = ("price", "price_m2")
ENCODE_MIN_COUNT = 5


# ---------------------------------------------------------------- learned rules
def learn_rare(df: DataFrame, column: str = "district", by: list[str] | None = None, min_count: int = RARE_MIN_COUNT) -> DataFrame:
    """Categories seen fewer than ``min_count`` times."""
    return df.groupBy(*(by or []), column).agg(F.count("*").alias("n")).filter(F.col("n") < min_count).drop("n")


def apply_rare(df: DataFrame, rare: DataFrame, column: str = "district", by: list[str] | None = None, label: str = RARE_LABEL) -> DataFrame:
    """Replace the learned rare categories; categories never seen are kept."""
    keys = [*(by or []), column]
    marked = join_keys(df, rare.withColumn("__rare", F.lit(True)), keys, "left")
    replaced = F.when(F.col("__rare"), F.lit(label)).otherwise(F.col(column))
    return marked.withColumn(column, replaced).drop("__rare")


def learn_clip(df: DataFrame, columns=NUMERIC_COLUMNS, by: list[str] | None = None, quantiles=CLIP_QUANTILES, min_values: int = MIN_VALUES) -> DataFrame:
    """Quantile bounds over positive values; a column with too few of them has no bounds."""
    keys = by or []
    counts, picks = [], []
    for c in columns:
        value = F.when(F.col(c) > 0, F.col(c).cast("double"))
        counts.append(F.count(value).alias(f"{c}_n"))
        picks += [Quantile(f"{c}_lo", value, quantiles[0]), Quantile(f"{c}_hi", value, quantiles[1])]
    bounds = aggregate(df, keys, counts, picks)
    for c in columns:
        enough = F.col(f"{c}_n") >= min_values
        bounds = bounds.withColumns({f"{c}_{s}": F.when(enough, F.col(f"{c}_{s}")) for s in ("lo", "hi")})
    return bounds.select(*keys, *[f"{c}_{s}" for c in columns for s in ("lo", "hi")])


def apply_clip(df: DataFrame, bounds: DataFrame, columns=NUMERIC_COLUMNS, by: list[str] | None = None) -> DataFrame:
    """Hold each column inside its learned bounds."""
    out = attach(df, bounds, by or [])
    for c in columns:
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        held = F.greatest(lo, F.least(hi, F.col(c).cast("double")))
        out = out.withColumn(c, F.when(lo.isNotNull() & F.col(c).isNotNull(), held).otherwise(F.col(c).cast("double")))
    return out.select(*df.columns)


def learn_iqr(df: DataFrame, columns=IQR_COLUMNS, by: list[str] | None = None, factor: float = IQR_FACTOR, min_values: int = MIN_VALUES) -> DataFrame:
    """Tukey fences over positive values; none where values are few or the spread is zero."""
    keys = by or []
    counts, picks = [], []
    for c in columns:
        value = F.when(F.col(c) > 0, F.col(c))
        counts.append(F.count(value).alias(f"{c}_n"))
        picks += [Quantile(f"{c}_q1", value, 0.25), Quantile(f"{c}_q3", value, 0.75)]
    fences = aggregate(df, keys, counts, picks)
    for c in columns:
        q1, q3 = F.col(f"{c}_q1"), F.col(f"{c}_q3")
        usable = (F.col(f"{c}_n") >= min_values) & (q3 > q1)
        fences = fences.withColumn(f"{c}_fence_lo", F.when(usable, q1 - factor * (q3 - q1)))
        fences = fences.withColumn(f"{c}_fence_hi", F.when(usable, q3 + factor * (q3 - q1)))
    return fences.select(*keys, *[f"{c}_fence_{s}" for c in columns for s in ("lo", "hi")])


def mark_iqr(df: DataFrame, fences: DataFrame, columns=IQR_COLUMNS, by: list[str] | None = None, out: str = "typical") -> DataFrame:
    """Boolean column: inside every learned fence; null values pass."""
    marked = attach(df, fences, by or [])
    keep = F.lit(True)
    for c in columns:
        inside = F.col(c).between(F.col(f"{c}_fence_lo"), F.col(f"{c}_fence_hi"))
        keep = keep & F.coalesce(inside, F.lit(True))
    return marked.withColumn(out, keep).select(*df.columns, out)


def remove_outliers(df: DataFrame, columns=IQR_COLUMNS, by: list[str] | None = None) -> DataFrame:
    """Learn fences on the frame and keep what lies inside them."""
    return mark_iqr(df, learn_iqr(df, columns, by), columns, by).filter("typical").drop("typical")


def learn_median_encoding(df: DataFrame, column: str, value: str, min_count: int = ENCODE_MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(median per category seen often enough, overall median as one row)."""
    per = aggregate(df, [column], [F.count("*").alias("n")], [Quantile("encoded", F.col(value))])
    overall = aggregate(df, [], [], [Quantile("encoded", F.col(value))])
    return per.filter(F.col("n") >= min_count).drop("n"), overall


def apply_median_encoding(df: DataFrame, per: DataFrame, overall: DataFrame, column: str, out: str) -> DataFrame:
    joined = join_keys(df, per.withColumnRenamed("encoded", "__e"), [column], "left")
    return joined.withColumn(out, F.coalesce("__e", overall.select("encoded").scalar())).drop("__e")


# ---------------------------------------------------------------- splits
def holdout_split(df: DataFrame, key: str, test_share: float = 0.2, seed: str = "42") -> DataFrame:
    """Column ``part`` from a hash of the row key: stable under retries and row order."""
    draw = uniform(F.col(key), F.lit(seed))
    return df.withColumn("part", F.when(draw < test_share, "test").otherwise("train"))


def group_folds(df: DataFrame, entity: str, folds: int = 5, seed: str = "folds") -> DataFrame:
    """Column ``fold``: all rows of an entity share one fold. The seed is not that of the hold-out, which would empty a fold."""
    return df.withColumn("fold", hash_bucket(folds, F.col(entity), F.lit(seed)))


def price_per_area_column(df: DataFrame) -> DataFrame:
    area = F.when(F.col("area_private") > 0, F.col("area_private")).otherwise(F.col("area_total"))
    return df.withColumn("price_m2", F.when(area > 0, F.col("price") / area))


def leakfree_prepare(rows: DataFrame, by: list[str], columns=NUMERIC_COLUMNS, rare_min: int = RARE_MIN_COUNT) -> DataFrame:
    """Rare categories, clip bounds and fences learned on part 'train' only, applied to both parts.

    Train rows outside the fences are removed; test rows are all kept, with ``typical`` marking
    those inside.
    """
    train = rows.filter("part = 'train'")
    # Rules are small tables several branches read, so each is learned once.
    rare = stored(learn_rare(train, "district", by, rare_min))
    bounds = stored(learn_clip(train, columns, by))

    def shape(part: DataFrame) -> DataFrame:
        return price_per_area_column(apply_clip(apply_rare(part, rare, "district", by), bounds, columns, by))

    shaped = shape(rows)
    fences = stored(learn_iqr(shaped.filter("part = 'train'"), IQR_COLUMNS, by))
    return mark_iqr(shaped, fences, IQR_COLUMNS, by).filter("part = 'test' OR typical")


def input_warnings(rows: DataFrame, rare: DataFrame, bounds: DataFrame, by: list[str], columns=NUMERIC_COLUMNS) -> DataFrame:
    """Rows with the fields outside what training saw: array of (field, direction, low, high)."""
    marked = join_keys(rows, rare.withColumn("__rare", F.lit(True)), [*by, "district"], "left")
    marked = attach(marked, bounds, by)
    none = F.lit(None).cast("double")

    def note(field: Column, direction: Column, low: Column, high: Column) -> Column:
        return F.struct(field.alias("field"), direction.alias("direction"), low.alias("low"), high.alias("high"))

    notes = []
    for c in columns:
        value, lo, hi = F.col(c).cast("double"), F.col(f"{c}_lo"), F.col(f"{c}_hi")
        where = F.when(value > hi, F.lit("above")).otherwise(F.lit("below"))
        notes.append(F.when((value > 0) & ((value < lo) | (value > hi)), note(F.lit(c), where, lo, hi)))
    wide = (F.col("area_total") > 0) & (F.col("area_private") > F.col("area_total"))
    notes.append(F.when(wide, note(F.lit("area_private"), F.lit("over_total"), none, F.col("area_total").cast("double"))))
    notes.append(F.when(F.col("__rare"), note(F.lit("district"), F.lit("rare"), none, none)))
    return marked.withColumn("warnings", F.array_compact(F.array(*notes))).select(*rows.columns, "warnings")


# ---------------------------------------------------------------- ML wrappers
def _apply(rule: str, df: DataFrame, tables: dict[str, DataFrame], columns: list[str], by: list[str], out: str) -> DataFrame:
    match rule:
        case "rare":
            return apply_rare(df, tables["rare"], columns[0], by)
        case "clip":
            return apply_clip(df, tables["bounds"], columns, by)
        case "fence":
            return mark_iqr(df, tables["fences"], columns, by, out)
        case "encode":
            return apply_median_encoding(df, tables["per"], tables["overall"], columns[0], out)
    raise ValueError(f"no rule is called {rule!r}")


class RuleModel(Model, MLWritable, MLReadable):
    """Applies a learned rule to whatever frame it is given. The rule's tables are saved with it."""

    rule = Param(Params._dummy(), "rule", "rare, clip, fence or encode", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "columns the rule looks at", TypeConverters.toListString)
    by = Param(Params._dummy(), "by", "columns of the groups it was learned in", TypeConverters.toListString)
    out = Param(Params._dummy(), "out", "column it adds, if any", TypeConverters.toString)

    def __init__(self, rule: str = "rare", tables: dict[str, DataFrame] | None = None, columns=(), by: list[str] | None = None, out: str = ""):
        super().__init__()
        self.tables = tables or {}
        self._set(rule=rule, columns=list(columns), by=list(by or []), out=out)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        given = (self.getOrDefault(p) for p in (self.columns, self.by, self.out))
        return _apply(self.getOrDefault(self.rule), dataset, self.tables, *given)

    def write(self) -> MLWriter:
        return _RuleWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _RuleReader()


class _RuleWriter(MLWriter):
    def __init__(self, model: RuleModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"tables": sorted(self.model.tables)})
        for name, table in self.model.tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class _RuleReader(MLReader):
    def load(self, path: str) -> RuleModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = RuleModel(tables={name: self.sparkSession.read.parquet(f"{path}/tables/{name}") for name in found["tables"]})
        model._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(model, found)
        return model


class RareCategories(Estimator):
    def __init__(self, column: str = "district", by: list[str] | None = None, min_count: int = RARE_MIN_COUNT):
        super().__init__()
        self.column, self.by, self.min_count = column, by, min_count

    def _fit(self, dataset: DataFrame) -> RuleModel:
        return RuleModel("rare", {"rare": stored(learn_rare(dataset, self.column, self.by, self.min_count))}, [self.column], self.by)


class QuantileClip(Estimator):
    def __init__(self, columns=NUMERIC_COLUMNS, by: list[str] | None = None, quantiles=CLIP_QUANTILES):
        super().__init__()
        self.columns, self.by, self.quantiles = columns, by, quantiles

    def _fit(self, dataset: DataFrame) -> RuleModel:
        return RuleModel("clip", {"bounds": stored(learn_clip(dataset, self.columns, self.by, self.quantiles))}, self.columns, self.by)


class IqrFence(Estimator):
    """Adds ``typical``; filter on it to drop outliers."""

    def __init__(self, columns=IQR_COLUMNS, by: list[str] | None = None, factor: float = IQR_FACTOR):
        super().__init__()
        self.columns, self.by, self.factor = columns, by, factor

    def _fit(self, dataset: DataFrame) -> RuleModel:
        return RuleModel("fence", {"fences": stored(learn_iqr(dataset, self.columns, self.by, self.factor))}, self.columns, self.by, "typical")


class MedianTargetEncoder(Estimator):
    def __init__(self, column: str, value: str, out: str, min_count: int = ENCODE_MIN_COUNT):
        super().__init__()
        self.column, self.value, self.out, self.min_count = column, value, out, min_count

    def _fit(self, dataset: DataFrame) -> RuleModel:
        per, overall = map(stored, learn_median_encoding(dataset, self.column, self.value, self.min_count))
        return RuleModel("encode", {"per": per, "overall": overall}, [self.column], out=self.out)
