"""Exploratory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore as X
from ..operators import metrics as M
from ..operators import panel as P
from . import bindings as B
from .q_panel import month_text, rounded
from .registry import query

AGENCY = "CASE p_type[1] WHEN 'P' THEN 'Padrá' WHEN 'S' THEN 'Santa Maria' WHEN 'M' THEN 'Markize' END"


@query(
    "source_counts",
    f"""WITH a AS (SELECT {AGENCY} AS name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT 'agency' AS what, name, n, NULL::DOUBLE AS share_pct FROM a WHERE name IS NOT NULL
    UNION ALL SELECT 'kind', p_type, count(*), round(100.0 * count(*) / (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey), 6) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""",
)
def source_counts(spark, sf):
    obs = B.observations(spark, sf)
    coded = obs.withColumn("code", F.concat_ws("-", F.substring("kind", 1, 1), "code"))
    agencies = X.agency_counts(coded).select(F.lit("agency").alias("what"), F.col("agency").alias("name"), "n", F.lit(None).cast("double").alias("share_pct"))
    kinds = X.share_counts(obs, "kind").select(F.lit("kind").alias("what"), F.col("kind").alias("name"), "n", F.round("share_pct", 6).alias("share_pct"))
    return agencies.unionByName(kinds)


@query(
    "funnel_counts",
    f"""WITH {B.OBS} SELECT 1 AS position, 'observed' AS stage, count(*) AS n FROM lineitem UNION ALL SELECT 2, 'codes', count(DISTINCT code) FROM obs
    UNION ALL SELECT 3, 'two kinds', count(*) FILTER (kind IN ('ECONOMY', 'PROMO')) FROM obs UNION ALL SELECT 4, 'plausible', count(*) FILTER (kind IN ('ECONOMY', 'PROMO') AND price >= 50000 AND area BETWEEN 20 AND 2000) FROM obs""",
)
def funnel_counts(spark, sf):
    obs = B.observations(spark, sf).withColumn("area_ref", F.col("area"))
    kinds = ["ECONOMY", "PROMO"]
    return X.funnel(
        {
            "observed": B.table(spark, sf, "lineitem"),
            "codes": obs.select("code").distinct(),
            "two kinds": obs.filter(F.col("kind").isin(kinds)),
            "plausible": X.plausible(obs, kinds),
        }
    )


@query(
    "log_histogram",
    f"""WITH {B.OBS} SELECT kind, CAST(least(43, floor((log10(price) - log10(5e3)) / (log10(2e5) - log10(5e3)) * 44)) AS INTEGER) AS bin, count(*) AS n FROM obs WHERE price BETWEEN 5e3 AND 2e5 GROUP BY 1, 2""",
)
def log_histogram(spark, sf):
    return X.log_histogram(B.observations(spark, sf), ["kind"], "price", 5e3, 2e5)


@query(
    "clipped_histogram",
    f"""WITH {B.OBS}, v AS (SELECT kind, least(price / area, 3000) AS v FROM obs), b AS (SELECT kind, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1)
    SELECT v.kind, CAST(least(44, floor((v - lo) / (hi - lo) * 45)) AS INTEGER) AS bin, count(*) AS n FROM v JOIN b ON b.kind = v.kind GROUP BY 1, 2""",
)
def clipped_histogram(spark, sf):
    value = F.least(F.col("price") / F.col("area"), F.lit(3000.0))
    return X.linear_histogram(B.observations(spark, sf), ["kind"], value, 45)


@query(
    "change_histogram",
    f"""WITH {B.REPEATS}, v AS (SELECT greatest(-30, least(30, 100 * (exp(dlog) - 1))) AS v FROM repeats WHERE abs(100 * (exp(dlog) - 1)) > 1e-9)
    SELECT CAST(least(39, floor((v + 30) / 60 * 40)) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1""",
)
def change_histogram(spark, sf):
    pct = 100.0 * F.expm1("dlog")
    moved = P.repeat_pairs(B.panel(spark, sf)).filter(F.abs(pct) > 1e-9)
    held = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), pct))
    return X.linear_histogram(moved, [], held, 40, -30.0, 30.0)


@query(
    "boxplot_stats",
    f"""WITH {B.OBS}, v AS (SELECT kind, baths, least(price / area, 3000) AS v FROM obs WHERE baths BETWEEN 1 AND 5),
    q AS (SELECT kind, baths, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1, 2)
    SELECT q.kind, q.baths, q.n, round(min(q1), 6) AS q1, round(min(median), 6) AS median, round(min(q3), 6) AS q3,
           round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
    FROM v JOIN q ON q.kind = v.kind AND q.baths = v.baths GROUP BY 1, 2, 3""",
)
def boxplot_stats(spark, sf):
    rows = B.observations(spark, sf).filter("baths BETWEEN 1 AND 5")
    value = F.least(F.col("price") / F.col("area"), F.lit(3000.0))
    return rounded(X.boxplot_stats(rows, ["kind", "baths"], value), 6)


COLUMNS = ("price", "area", "rooms", "baths", "parking")


def _spearman_sql(a: str, b: str) -> str:
    return f"""SELECT kind, '{a}' AS "left", '{b}' AS "right", round(corr(rx, ry), 8) AS rho, count(*) AS n FROM (
        SELECT kind, rank() OVER (PARTITION BY kind ORDER BY {a}) + (count(*) OVER (PARTITION BY kind, {a}) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY kind ORDER BY {b}) + (count(*) OVER (PARTITION BY kind, {b}) - 1) / 2.0 AS ry FROM obs WHERE {a} > 0 AND {b} > 0) GROUP BY kind"""


@query("spearman_matrix", f"WITH {B.OBS} " + " UNION ALL ".join(_spearman_sql(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]))
def spearman_matrix(spark, sf):
    return rounded(M.spearman(B.spread_observations(spark, sf).select("kind", *COLUMNS), ["kind"], list(COLUMNS)), 8)


@query("spearman", f"WITH {B.OBS} {_spearman_sql('area', 'price')}")
def spearman(spark, sf):
    """Association of area and price by kind."""
    return rounded(M.spearman(B.observations(spark, sf).select("kind", "area", "price"), ["kind"], ["area", "price"]), 8)


def _describe_sql(c: str) -> str:
    quantiles = ", ".join(f"round(quantile_cont(v, {p}), 5) AS {n}" for n, p in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)))
    return f"""SELECT kind, '{c}' AS "column", count(v) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, min(v) AS min, max(v) AS max, {quantiles},
        round(skewness(v), 6) AS skew, round(skewness(ln(v)), 6) AS log_skew FROM (SELECT kind, {c} AS v FROM obs) GROUP BY 1"""


@query("describe_skew", f"WITH {B.OBS} {_describe_sql('price')} UNION ALL {_describe_sql('area')}")
def describe_skew(spark, sf):
    obs = B.observations(spark, sf).select("kind", "price", "area")
    out = X.describe(obs, ["kind"], ["price", "area"])
    out = out.withColumns({c: F.round(c, 5) for c in ("mean", "std", "p10", "p25", "median", "p75", "p90")})
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in ("price", "area")])
    skews = obs.select("kind", F.inline(entries)).groupBy("kind", "column").agg(
        F.round(X.sample_skewness(F.col("v")), 6).alias("skew"), F.round(X.sample_skewness(F.log("v")), 6).alias("log_skew")
    )
    return out.join(skews, ["kind", "column"])


@query(
    "quality_counts",
    f"""WITH {B.OBS} SELECT 'price below' AS name, count(*) FILTER (price < 5000) AS n FROM obs UNION ALL SELECT 'price above', count(*) FILTER (price > 100000) FROM obs
    UNION ALL SELECT 'area below', count(*) FILTER (area < 20) FROM obs UNION ALL SELECT 'area above', count(*) FILTER (area > 45) FROM obs
    UNION ALL SELECT 'city ' || lower(district), count(*) FROM obs GROUP BY lower(district)""",
)
def quality_counts(spark, sf):
    """Implausible rows and spellings of a text column."""
    obs = B.observations(spark, sf)
    tests = {"price below": F.col("price") < 5000, "price above": F.col("price") > 100000, "area below": F.col("area") < 20, "area above": F.col("area") > 45}
    wide = obs.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
    spelled = obs.groupBy(F.concat(F.lit("city "), F.lower("district")).alias("name")).agg(F.count("*").alias("n"))
    return wide.unpivot([], list(tests), "name", "n").unionByName(spelled)


@query(
    "panel_coverage",
    f"""WITH {B.PANEL}, c AS (SELECT code, count(DISTINCT month) AS months FROM panel GROUP BY 1)
    SELECT 'month' AS what, strftime(month, '%Y-%m') AS item, count(DISTINCT code) AS codes FROM panel GROUP BY 2 UNION ALL SELECT 'months seen', CAST(months AS VARCHAR), count(*) FROM c GROUP BY 2""",
)
def panel_coverage(spark, sf):
    panel = B.stored_panel(spark, sf)
    per_month = month_text(X.codes_per_month(panel), "month").select(F.lit("month").alias("what"), F.col("month").alias("item"), "codes")
    seen = X.months_seen(panel).select(F.lit("months seen").alias("what"), F.col("months").cast("string").alias("item"), "codes")
    return per_month.unionByName(seen)


@query(
    "top_districts",
    f"""WITH {B.OBS}, s AS (SELECT kind, district, count(*) AS n, quantile_cont(price / area, 0.5) AS median FROM obs GROUP BY 1, 2 HAVING count(*) >= 20),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY median DESC, district) AS position FROM s)
    SELECT kind, district, n, median, CAST(position AS INTEGER) AS position FROM r WHERE position <= 15""",
)
def top_districts(spark, sf):
    rows = B.observations(spark, sf).withColumn("price_m2", F.col("price") / F.col("area"))
    return X.top_by_median(rows, ["kind"], "district", "price_m2").select("kind", "district", "n", "median", "position")
