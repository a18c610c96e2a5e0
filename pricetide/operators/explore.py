"""Exploratory tables: the numbers behind the published charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import KIND_CATALOG, fold_text, source_prefix
from .ordered import Quantile, aggregate, attach, join_keys

PRICE_BAND = (50_000.0, 20_000_000.0)
AREA_BAND = (20.0, 2_000.0)
# Agency prefixes of the listing codes; both spellings of one agency are accepted.
AGENCIES = {
    "N": "Nostra Casa",
    "PL": "Plaza",
    "C": "Casa Imóveis",
    "SI": "SIM",
    "SM": "Santa Maria",
    "S": "Santa Maria",
    "P": "Padrá",
    "M": "Markize",
    "K": "Katedral",
}


def plausible(df: DataFrame, kinds: list[str] | None = None, price=PRICE_BAND, area=AREA_BAND) -> DataFrame:
    """Rows of the kinds with price and reference area inside the plausible band."""
    out = df.filter(F.col("kind").isin(kinds)) if kinds is not None else df
    out = out.filter(F.col("price").between(*price) & F.col("area_ref").between(*area))
    return out.withColumn("price_m2", F.col("price") / F.col("area_ref"))


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count of every stage, in order."""
    out = None
    for i, (name, df) in enumerate(stages.items(), start=1):
        row = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("position"), F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def agency_counts(df: DataFrame, code: str = "code", agencies: dict[str, str] = AGENCIES) -> DataFrame:
    """Listings per agency; prefixes without a name are left out."""
    names = F.create_map(*[F.lit(x) for pair in agencies.items() for x in pair])
    return (
        df.withColumn("agency", names[source_prefix(F.col(code))])
        .filter("agency IS NOT NULL")
        .groupBy("agency")
        .agg(F.count("*").alias("n"))
    )


def share_counts(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage of each category."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share_pct", 100.0 * F.col("n") / total)


def completeness(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Percentage of rows in which each field is missing; ``columns`` maps a name to its test."""
    tests = [(100.0 * F.avg(F.when(test, 1.0).otherwise(0.0))).alias(name) for name, test in columns.items()]
    wide = df.agg(*tests)
    return wide.unpivot([], list(columns), "field", "missing_pct")


def log_histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, edges: int = 45) -> DataFrame:
    """Counts over ``edges`` log-spaced edges; values outside are not counted."""
    span = F.log10(F.lit(float(high))) - F.log10(F.lit(float(low)))
    place = (F.log10(F.col(value)) - F.log10(F.lit(float(low)))) / span * (edges - 1)
    rows = df.filter(F.col(value).between(low, high)).withColumn("bin", F.least(F.floor(place), F.lit(edges - 2)).cast("int"))
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def linear_histogram(df: DataFrame, keys: list[str], value: Column, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts over equal bins between the bounds, else between the group's smallest and largest value."""
    rows = df.withColumn("__v", value)
    if low is None or high is None:
        bounds = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        rows = attach(rows, bounds, keys)
    else:
        rows = rows.withColumn("__lo", F.lit(float(low))).withColumn("__hi", F.lit(float(high)))
    place = F.try_divide(F.col("__v") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins
    rows = rows.withColumn("bin", F.least(F.floor(F.coalesce(place, F.lit(0.0))), F.lit(bins - 1)).cast("int"))
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def boxplot_stats(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Quartiles, extremes and the whisker ends 1.5 IQR away at most."""
    rows = df.withColumn("__v", value)
    v = F.col("__v")
    q = aggregate(rows, keys, [F.count("*").alias("n")], [Quantile("q1", v, 0.25), Quantile("median", v), Quantile("q3", v, 0.75)])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = join_keys(rows, q, keys).groupBy(*keys).agg(
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
    )
    return join_keys(q, ends, keys)


def describe(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """n, mean, std, min, p10, p25, median, p75, p90, max of each column as rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*keys, F.inline(entries))
    v = F.col("v")
    names = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}
    return aggregate(
        long,
        [*keys, "column"],
        [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")],
        [Quantile(name, v, p) for name, p in names.items()],
    )


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(value)
    corrected = F.skewness(value) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2)
    return F.when(n > 2, corrected)


def top_by_median(df: DataFrame, keys: list[str], item: str, value: str, min_n: int = 20, top: int = 15) -> DataFrame:
    """The ``top`` items of each group by median, among those seen at least ``min_n`` times."""
    stats = aggregate(df, [*keys, item], [F.count("*").alias("n")], [Quantile("median", F.col(value))])
    order = Window.partitionBy(*keys).orderBy(F.desc("median"), item)
    return stats.filter(F.col("n") >= min_n).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)


def months_seen(panel: DataFrame) -> DataFrame:
    """How many codes were seen in how many distinct months."""
    per_code = panel.groupBy("code").agg(F.count_distinct("month").alias("months"))
    return per_code.groupBy("months").agg(F.count("*").alias("codes"))


def codes_per_month(panel: DataFrame) -> DataFrame:
    return panel.groupBy("month").agg(F.count_distinct("code").alias("codes"))


def dataset_slice(df: DataFrame, kinds: list[str], districts: list[str] | None = None, low: float = 0.0, high: float | None = None) -> DataFrame:
    """Interactive filter: kinds, districts and a price range open at the top when ``high`` is None."""
    out = df.filter(F.col("kind").isin(kinds) & (F.col("price") >= low))
    if high is not None:
        out = out.filter(F.col("price") <= high)
    return out.filter(F.col("district").isin(districts)) if districts else out


def slider_ceiling(df: DataFrame, price: str = "price", step: int = 50_000) -> DataFrame:
    """Top of the price filter: the step above the 99th percentile."""
    p99 = aggregate(df, [], [], [Quantile("p99", F.col(price), 0.99)])
    return p99.select((F.floor(F.col("p99") / step + 1) * step).cast("double").alias("ceiling"))


def district_lists(df: DataFrame, min_count: int = 3) -> DataFrame:
    """Per kind the sorted districts with at least ``min_count`` listings."""
    counts = df.filter("district <> ''").groupBy("kind", "district").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_count).groupBy("kind").agg(F.array_sort(F.collect_list("district")).alias("districts"))


def type_catalog(spark: SparkSession) -> DataFrame:
    """The published property classes: kind, description and its aliases, one row each."""
    rows = [(kind, about, list(aliases)) for kind, about, aliases in KIND_CATALOG]
    table = spark.createDataFrame(rows, "kind string, description string, aliases array<string>")
    return table.select("kind", "description", F.explode("aliases").alias("alias"))


def type_usage(rows: DataFrame, kind: str) -> DataFrame:
    """The catalogue with how many rows use each alias, whatever their case and accents."""
    used = rows.groupBy(fold_text(F.col(kind)).alias("__folded")).agg(F.count("*").alias("listings"))
    out = type_catalog(rows.sparkSession).withColumn("__folded", fold_text(F.col("alias"))).join(used, "__folded", "left")
    return out.select("kind", "description", "alias", F.coalesce("listings", F.lit(0)).alias("listings"))
