"""Monthly price panel, repeat-listing index, lagged features and forward pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_number, month_start
from ..functions.numbers import clamp
from ..session import stored
from .ordered import Quantile, aggregate

MAX_MONTHLY_LOG_CHANGE = math.log(1.5)
MIN_SEGMENT_PAIRS = 8
MIN_CROSS_SECTION = 5
SEGMENT = ["district", "kind"]


def month_medians(history: DataFrame, day: str = "day") -> DataFrame:
    """Median positive price of each code and month."""
    rows = history.filter("price > 0").select("code", month_start(F.col(day)).alias("month"), "price")
    out = aggregate(rows, ["code", "month"], [], [Quantile("price", F.col("price"))])
    return out.withColumn("month_n", month_number(F.col("month"))).select("code", "month", "month_n", "price")


def monthly_panel(history: DataFrame, features: DataFrame, kinds: list[str] | None = None, day: str = "day") -> DataFrame:
    """Code x month panel with listing features; needs a known reference area."""
    kept = features.filter("area_ref > 0")
    if kinds is not None:
        kept = kept.filter(F.col("kind").isin(kinds))
    panel = month_medians(history, day).join(kept, "code")
    return panel.withColumn("price_m2", F.col("price") / F.col("area_ref"))


def _by_code() -> Window:
    return Window.partitionBy("code").orderBy("month_n")


def _with_previous(panel: DataFrame) -> DataFrame:
    last = _by_code()
    return panel.withColumn("gap", F.col("month_n") - F.lag("month_n").over(last)).withColumn(
        "dlog", F.log(F.col("price") / F.lag("price").over(last))
    )


def monthly_changes(panel: DataFrame, limit: float = MAX_MONTHLY_LOG_CHANGE) -> DataFrame:
    """Log change between consecutive months; jumps beyond the limit are data errors."""
    return _with_previous(panel).filter((F.col("gap") == 1) & (F.abs("dlog") <= limit))


def repeat_pairs(panel: DataFrame, limit: float = MAX_MONTHLY_LOG_CHANGE) -> DataFrame:
    """Log change between consecutive observations over any gap; the limit grows with the gap."""
    return _with_previous(panel).filter((F.col("gap") > 0) & (F.abs("dlog") <= F.lit(limit) * F.col("gap")))


# ---------------------------------------------------------------- index
def repeat_index(changes: DataFrame, min_pairs: int = MIN_SEGMENT_PAIRS) -> DataFrame:
    """Mean log change and pair count by segment, kind and overall month (column ``level``).

    Sums per segment and month are formed first; the coarser levels add those up.
    """
    base = changes.groupBy(*SEGMENT, "month").agg(F.sum("dlog").alias("s"), F.count("*").alias("n"))
    cols = [F.col(c) for c in (*SEGMENT, "month")]
    sets = [cols, [F.col("kind"), F.col("month")], [F.col("month")]]
    rolled = base.groupingSets(sets, *cols).agg(
        F.sum("s").alias("s"), F.sum("n").alias("pairs"), F.grouping_id().alias("g")
    )
    level = F.when(F.col("g") == 0, "segment").when(F.col("g") == 4, "kind").otherwise("overall")
    return (
        rolled.withColumn("level", level)
        .filter((F.col("level") != "segment") | (F.col("pairs") >= min_pairs))
        .select("level", *SEGMENT, "month", (F.col("s") / F.col("pairs")).alias("mean_dlog"), "pairs")
    )


def with_fallback(df: DataFrame, table: DataFrame, value: str, out: str, levels: list[tuple[str, list[str]]], default: Column | None = None) -> DataFrame:
    """First value found along ``levels`` of (level name, join keys), else the default."""
    found = []
    for i, (level, keys) in enumerate(levels):
        part = table.filter(F.col("level") == level).select(*keys, F.col(value).alias(f"__v{i}"))
        df = df.join(part, keys, "left") if keys else df.withColumn(f"__v{i}", part.select(f"__v{i}").scalar())
        found.append(F.col(f"__v{i}"))
    choice = F.coalesce(*found, default) if default is not None else F.coalesce(*found)
    return df.withColumn(out, choice).drop(*[f"__v{i}" for i in range(len(levels))])


INDEX_LEVELS = [("segment", [*SEGMENT, "month"]), ("kind", ["kind", "month"]), ("overall", ["month"])]


def with_momentum(df: DataFrame, index: DataFrame) -> DataFrame:
    """Change of the segment (falling back to kind, then market) and of the kind in the row's month."""
    zero = F.lit(0.0)
    df = with_fallback(df, index, "mean_dlog", "segment_momentum", INDEX_LEVELS, zero)
    return with_fallback(df, index, "mean_dlog", "kind_momentum", INDEX_LEVELS[1:], zero)


def cumulative_index(panel: DataFrame, index: DataFrame) -> DataFrame:
    """Index level of every segment and month, 100 in the first; months without data keep the level."""
    segments = panel.groupBy(*SEGMENT).agg(F.count("*").alias("listings"))
    # The months of the calendar, one array row.
    months = panel.agg(F.array_sort(F.collect_set("month"))).scalar()
    grid = segments.withColumn("months", months).withColumn("month", F.explode("months"))
    grid = grid.withColumn("first", F.col("month") == F.get("months", F.lit(0))).drop("months")
    grid = with_fallback(grid, index, "mean_dlog", "step", INDEX_LEVELS, F.lit(0.0))
    step = F.when(F.col("first"), 0.0).otherwise(F.col("step"))
    whole = Window.partitionBy(*SEGMENT)
    upto = whole.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("step").over(whole)
    return grid.withColumn("step", step).select(
        *SEGMENT,
        "listings",
        "month",
        (100.0 * F.exp(F.sum("step").over(upto))).alias("index_level"),
        (100.0 * F.exp(total) - 100.0).alias("total_change_pct"),
    )


def index_table(levels: DataFrame, months: list[str] | None = None) -> DataFrame:
    """One row per segment with a column per month, as published."""
    rows = levels.withColumn("m", F.date_format("month", "yyyy-MM"))
    rounded = rows.groupBy(*SEGMENT, "listings", F.round("total_change_pct", 2).alias("total_change_pct"))
    return rounded.pivot("m", months).agg(F.round(F.first("index_level"), 2))


# ---------------------------------------------------------------- features and pairs
def cross_section(panel: DataFrame) -> DataFrame:
    """Median price per area and count by (segment, month) and (kind, month)."""
    value = [Quantile("median_price_m2", F.col("price_m2"))]
    count = [F.count("*").alias("n")]
    fine = aggregate(panel, [*SEGMENT, "month"], count, value).withColumn("level", F.lit("segment"))
    coarse = aggregate(panel, ["kind", "month"], count, value).withColumn("level", F.lit("kind"))
    coarse = coarse.withColumn("district", F.lit(None).cast("string"))
    return fine.unionByName(coarse).select("level", *SEGMENT, "month", "median_price_m2", "n")


def panel_features(panel: DataFrame, index: DataFrame, sections: DataFrame | None = None, min_n: int = MIN_CROSS_SECTION) -> DataFrame:
    """Lagged and relative features of each (code, month), from information of that month only."""
    sections = cross_section(panel) if sections is None else sections
    usable = sections.filter((F.col("level") == "kind") | (F.col("n") >= min_n))
    limit = MAX_MONTHLY_LOG_CHANGE
    whole = Window.partitionBy("code")
    df = _with_previous(panel)
    previous = F.when(F.col("gap") == 1, clamp(F.col("dlog"), -limit, limit)).otherwise(0.0)
    df = (
        df.withColumn("months_listed", F.col("month_n") - F.min("month_n").over(whole))
        .withColumn("previous_change", previous)
        .drop("gap", "dlog")
    )
    df = with_fallback(df, usable, "median_price_m2", "__ref", INDEX_LEVELS[:2])
    df = df.withColumn("relative_price", F.coalesce(F.try_divide("price_m2", "__ref"), F.lit(1.0))).drop("__ref")
    df = df.withColumn("log_price_m2", F.log(F.greatest(F.col("price_m2"), F.lit(1.0))))
    return with_momentum(df, index)


def horizon_pairs(features: DataFrame, horizon: int = 1, limit: float = MAX_MONTHLY_LOG_CHANGE, prices: DataFrame | None = None) -> DataFrame:
    """Each (code, month) with the price of the same code ``horizon`` months later.

    ``prices`` is the panel the features were built from; it spares computing them twice.
    """
    prices = features if prices is None else prices
    later = prices.select("code", (F.col("month_n") - horizon).alias("month_n"), F.col("price").alias("future_price"))
    pairs = features.join(later, ["code", "month_n"])
    pairs = pairs.withColumn("target", F.log(F.col("future_price") / F.col("price")))
    return pairs.filter(F.abs("target") <= limit * max(1, horizon)).withColumn(
        "target_month", F.add_months("month", horizon)
    )


def temporal_split(pairs: DataFrame, test_months: int = 1, month: str = "target_month") -> DataFrame:
    """Column ``part``: the last ``test_months`` distinct target months are the test part.

    At least one month stays in the train part; pairs of fewer than two target months fail when the split is read.
    """
    months = pairs.agg(F.array_sort(F.collect_set(month)).alias("m"))
    take = F.greatest(F.least(F.lit(test_months), F.size("m") - 1), F.lit(1))
    refused = F.raise_error(F.lit("a temporal split needs pairs of two target months or more")).cast(pairs.schema[month].dataType)
    cut = months.select(F.when(F.size("m") < 2, refused).otherwise(F.element_at("m", -take))).scalar()
    return pairs.withColumn("__cut", cut).withColumn("part", F.when(F.col(month) >= F.col("__cut"), "test").otherwise("train")).drop("__cut")


def segment_means(train: DataFrame, value: str = "target") -> DataFrame:
    """Mean target by segment, kind and overall, in one pass over the segment sums."""
    base = train.groupBy(*SEGMENT).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    cols = [F.col(c) for c in SEGMENT]
    rolled = base.groupingSets([cols, [F.col("kind")], []], *cols).agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.grouping_id().alias("g")
    )
    level = F.when(F.col("g") == 0, "segment").when(F.col("g") == 2, "kind").otherwise("overall")
    return rolled.select(level.alias("level"), *SEGMENT, (F.col("s") / F.col("n")).alias("mean_value"), "n")


def segment_mean_baseline(train: DataFrame, test: DataFrame, value: str = "target", out: str = "prediction") -> DataFrame:
    """Predict each test row by the train mean of its segment, else kind, else everything."""
    levels = [("segment", SEGMENT), ("kind", ["kind"]), ("overall", [])]
    # The means are read once per level.
    return with_fallback(test, stored(segment_means(train, value)), "mean_value", out, levels)


def latest_rulers(panel: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest-month medians and momentum by segment and by kind, as used for scoring."""
    last = panel.agg(F.max("month")).scalar()
    latest = panel.withColumn("__last", last).filter("month = __last").drop("__last")
    value = [Quantile("median_price_m2", F.col("price_m2"))]
    fine = panel.select(*SEGMENT).distinct().withColumn("month", last)
    fine = with_momentum(fine, index).drop("kind_momentum")
    fine = fine.join(aggregate(latest, SEGMENT, [F.count("*").alias("n")], value), SEGMENT, "left")
    coarse = panel.select("kind").distinct().withColumn("month", last)
    coarse = with_fallback(coarse, index, "mean_dlog", "kind_momentum", INDEX_LEVELS[1:], F.lit(0.0))
    coarse = coarse.join(aggregate(latest, ["kind"], [F.count("*").alias("n")], value), "kind", "left")
    return fine, coarse
