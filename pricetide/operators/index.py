"""Monthly series, compounded indices, back-casting and projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import decimal_year
from ..functions.numbers import monthly_log
from .ordered import Quantile, aggregate

WINDOW_YEARS = 10
JUNE = 6


def first_per_month(rows: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """Keep the first listed value of each month."""
    return rows.groupBy(*keys, "month").agg(F.min_by("value", position).alias("value"))


def align_series(series: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """Long (series, month, value) to one row per month and one column per series; gaps stay null."""
    by = [*(keys or []), "month"]
    return series.groupBy(*by).agg(*[F.max(F.when(F.col("series") == n, F.col("value"))).alias(n) for n in names])


def blend_changes(wide: DataFrame, names: list[str], out: str = "value") -> DataFrame:
    """Mean of several monthly changes; months missing any of them are dropped."""
    total = sum(F.col(n) for n in names)
    return wide.withColumn(out, total / len(names)).filter(F.col(out).isNotNull())


def _by_month(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("month")


def index_level(changes: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Cumulative level of monthly percentage changes, base 1 before the first month."""
    upto = _by_month(keys).rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("index_level", F.exp(F.sum(F.log1p(F.col(value) / 100.0)).over(upto)))


def pct_change(levels: DataFrame, keys: list[str], value: str = "value", out: str = "change_pct") -> DataFrame:
    """Percentage change against the previous observation; the first month has none."""
    previous = F.lag(value).over(_by_month(keys))
    return levels.withColumn(out, 100.0 * (F.col(value) / previous - 1)).filter(F.col(out).isNotNull())


def rolling_compound(changes: DataFrame, keys: list[str], value: str = "value", months: int = 12, out: str = "compounded_pct") -> DataFrame:
    """Compounded change of the last ``months`` observations, null until there are that many."""
    recent = _by_month(keys).rowsBetween(-(months - 1), 0)
    total = F.sum(F.log1p(F.col(value) / 100.0)).over(recent)
    return changes.withColumn(out, F.when(F.count(value).over(recent) == months, 100.0 * F.expm1(total)))


def index_summary(changes: DataFrame, keys: list[str], value: str = "value", years: int = WINDOW_YEARS) -> DataFrame:
    """Mean annual rate of the last ``years``, last 12 months, and p10/p90 of rolling 12 months."""
    last = Window.partitionBy(*keys).orderBy(F.desc("month"))
    rows = rolling_compound(changes, keys, value).withColumn("age", F.row_number().over(last))
    log = F.log1p(F.col(value) / 100.0)
    span = 12 * years
    in_span = F.when(F.col("age") <= span, F.col("month"))
    recent = F.when(F.col("age") <= span, F.col("compounded_pct"))
    return aggregate(
        rows,
        keys,
        [
            (100.0 * F.expm1(F.sum(F.when(F.col("age") <= span, log)) / years)).alias("mean_annual_pct"),
            (100.0 * F.expm1(F.sum(F.when(F.col("age") <= 12, log)))).alias("last_12m_pct"),
            F.min(in_span).alias("first_month"),
            F.max(in_span).alias("last_month"),
        ],
        [Quantile("band_low_pct", recent, 0.10), Quantile("band_high_pct", recent, 0.90)],
    )


def macro_features(wide: DataFrame, keys: list[str], rate: str, inflation: str, construction: str, level: str, reference_months: int = 120) -> DataFrame:
    """Yearly changes known at each month and the change of ``level`` over the next 12 months."""
    order = _by_month(keys)
    df = rolling_compound(wide, keys, inflation, 12, "inflation_12m")
    df = rolling_compound(df, keys, construction, 12, "construction_12m")
    now = F.col(level)
    years = reference_months / 12.0
    return (
        df.withColumn("rate_change_12m", F.col(rate) - F.lag(rate, 12).over(order))
        .withColumn("level_12m", 100.0 * (now / F.lag(level, 12).over(order) - 1))
        .withColumn("target", 100.0 * (F.lead(level, 12).over(order) / now - 1))
        .withColumn("long_mean", 100.0 * (F.pow(now / F.lag(level, reference_months).over(order), F.lit(1.0 / years)) - 1))
    )


# ---------------------------------------------------------------- factors
def with_factor(df: DataFrame, levels: DataFrame, start: Column, end: Column, out: str = "factor") -> DataFrame:
    """How much the index rose from ``start`` to ``end``; months outside the series use its edge.

    ``levels``: one series (month, index_level).
    """
    low, high = levels.agg(F.min("month")).scalar(), levels.agg(F.max("month")).scalar()
    df = df.withColumn("__low", low).withColumn("__high", high)
    df = df.withColumn("__from", F.greatest("__low", F.least(start, "__high")))
    df = df.withColumn("__to", F.greatest("__low", F.least(end, "__high")))
    a = levels.select(F.col("month").alias("__from"), F.col("index_level").alias("__a"))
    b = levels.select(F.col("month").alias("__to"), F.col("index_level").alias("__b"))
    df = df.join(a, "__from", "left").join(b, "__to", "left")
    return df.withColumn(out, F.col("__b") / F.col("__a")).drop("__low", "__high", "__from", "__to", "__a", "__b")


def with_month_factor(df: DataFrame, levels: DataFrame, month: str, reference: Column, out: str = "factor") -> DataFrame:
    """Level at the reference over the level of the row's month; a month outside the series gets 1."""
    at_reference = levels.agg(
        F.coalesce(F.max(F.when(F.col("month") == reference, F.col("index_level"))), F.max("index_level"))
    ).scalar()
    known = levels.select(F.col("month").alias(month), F.col("index_level").alias("__level"))
    df = df.join(known, month, "left").withColumn("__ref", at_reference)
    return df.withColumn(out, F.coalesce(F.col("__ref") / F.col("__level"), F.lit(1.0))).drop("__level", "__ref")


def to_reference_month(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Bring every price to the newest month of the data; the announced price stays alongside."""
    newest = rows.agg(F.max("month")).scalar()
    df = rows.withColumn("announced_price", F.col("price")).withColumn("announced_month", F.col("month"))
    df = df.withColumn("month", newest)
    df = with_factor(df, levels, F.col("announced_month"), F.col("month"))
    df = df.withColumn("price", F.col("price") * F.col("factor")).drop("factor")
    return df.withColumn("year", decimal_year(F.col("month"))).withColumn("simulated", F.lit(0))


def backcast(rows: DataFrame, levels: DataFrame, years: list[int], adjustment: str | None = None) -> DataFrame:
    """Each row once per past year, its price taken to June of that year through the index.

    ``adjustment`` names a column of extra percentage points a year for the row.
    """
    df = rows.withColumn("__year", F.explode(F.array(*[F.lit(y) for y in years])))
    df = df.withColumn("__june", F.make_date("__year", F.lit(JUNE), F.lit(1)))
    df = with_factor(df, levels, F.col("__june"), F.col("month"))
    past = decimal_year(F.col("__june"))
    divisor = F.col("factor")
    if adjustment is not None:
        divisor = divisor * F.pow(1 + F.col(adjustment) / 100.0, F.col("year") - past)
    df = df.withColumn("price", F.col("price") / divisor).withColumn("year", past)
    return df.withColumn("month", F.col("__june")).withColumn("simulated", F.lit(1)).drop("__year", "__june", "factor")


def export_dataset(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Published column order and rounding; simulated rows have no announced price."""
    real = F.col("simulated") == 0
    out = rows.withColumn("announced_month", F.when(real, F.date_format("announced_month", "yyyy-MM")))
    out = out.withColumn("announced_price", F.when(real, F.round("announced_price", 0)))
    columns = (
        "entity", "simulated", "year", F.date_format("month", "yyyy-MM").alias("month"), "kind", "district",
        "area_total", "area_private", "rooms", "baths", "parking", F.round("price", 0).alias("price"),
        "announced_month", "announced_price", *[F.round(c, 3).alias(c) for c in extra],
    )
    return out.select(*columns)


# ---------------------------------------------------------------- rates and scenarios
def prior_blend(rates: DataFrame, summary: DataFrame, months: Column | int, prior_months: int = 12) -> DataFrame:
    """Blend measured monthly rates with an index: the data weigh T / (T + prior).

    ``summary`` holds one row with mean_annual_pct, band_low_pct and band_high_pct.
    """
    t = F.lit(months) if isinstance(months, int) else months
    weight = t / (t + F.lit(float(prior_months)))
    row = F.struct("mean_annual_pct", "band_low_pct", "band_high_pct")
    df = rates.withColumn("__s", summary.select(row).scalar()).withColumn("data_weight", weight)
    w = F.col("data_weight")
    central = monthly_log(F.col("__s.mean_annual_pct"))
    low = F.coalesce(monthly_log(F.col("__s.band_low_pct")), central)
    high = F.coalesce(monthly_log(F.col("__s.band_high_pct")), central)
    return (
        df.withColumn("monthly", w * F.col("monthly") + (1 - w) * central)
        .withColumn("monthly_low", w * F.col("monthly_low") + (1 - w) * low)
        .withColumn("monthly_high", w * F.col("monthly_high") + (1 - w) * high)
        .drop("__s")
    )


def scenario_projection(rows: DataFrame, years: int, reference_pct: str | None = None) -> DataFrame:
    """Value of each row in years 0..N under the low, central and high monthly rate."""
    df = rows.withColumn("year", F.explode(F.sequence(F.lit(0), F.lit(years))))
    for name, rate in (("pessimistic", "monthly_low"), ("central", "monthly"), ("optimistic", "monthly_high")):
        df = df.withColumn(name, F.col("value") * F.exp(12 * F.col(rate) * F.col("year")))
    if reference_pct is not None:
        df = df.withColumn("reference", F.col("value") * F.pow(1 + F.col(reference_pct) / 100.0, F.col("year")))
    return df


def reference_rates(summary: DataFrame, keys: list[str], custom_pct: float = 5.0) -> DataFrame:
    """Every comparison rate of an index as labelled rows: mean, last 12 months, custom and none."""
    none = F.lit(None).cast("double")
    options = F.array(
        F.struct(F.lit("mean").alias("choice"), F.col("mean_annual_pct").alias("rate_pct")),
        F.struct(F.lit("last_12m").alias("choice"), F.col("last_12m_pct").alias("rate_pct")),
        F.struct(F.lit("custom").alias("choice"), F.lit(float(custom_pct)).alias("rate_pct")),
        F.struct(F.lit("none").alias("choice"), none.alias("rate_pct")),
    )
    return summary.select(*keys, F.inline(options))


def embargo_split(rows: DataFrame, cuts: list[str], embargo_months: int = 12, month: str = "month") -> DataFrame:
    """Rows once per cut and part: train ends ``embargo_months`` before the cut, test starts after it."""
    df = rows.withColumn("cut", F.explode(F.array(*[F.lit(c).cast("date") for c in cuts])))
    part = F.when(F.col(month) <= F.add_months("cut", -embargo_months), "train").when(F.col(month) > F.col("cut"), "test")
    return df.withColumn("part", part).filter("part IS NOT NULL")


def naive_forecasts(test: DataFrame) -> DataFrame:
    """Reference forecasts as rows: repeat the last 12 months, long mean, inflation."""
    options = F.array(
        F.struct(F.lit("repeat_12m").alias("model"), F.col("level_12m").alias("prediction")),
        F.struct(F.lit("long_mean").alias("model"), F.coalesce("long_mean", "level_12m").alias("prediction")),
        F.struct(F.lit("inflation").alias("model"), F.col("inflation_12m").alias("prediction")),
    )
    return test.select("*", F.inline(options))
