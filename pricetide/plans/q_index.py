"""Series, compounding, factors, back-casting, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..operators import index as I
from ..operators import models, rates
from ..session import stored
from ..sources.published import publish, read_published
from . import bindings as B
from .q_panel import month_text, rounded
from .registry import query

YEARS = 5  # the series hold 80 months


@query("pct_change", f"WITH {B.SERIES} SELECT series, strftime(month, '%Y-%m') AS month, round(change_pct, 8) AS change_pct FROM moved WHERE change_pct IS NOT NULL")
def pct_change(spark, sf):
    out = I.pct_change(B.monthly_orders(spark, sf), ["series"], "total").select("series", "month", "change_pct")
    return rounded(month_text(out, "month"), 8)


ROLLING = B.SERIES + """,
rolling AS (
    SELECT series, month, value, CASE WHEN count(value) OVER w = 12 THEN 100 * (exp(sum(ln(1 + value / 100)) OVER w) - 1) END AS compounded_pct,
           row_number() OVER (PARTITION BY series ORDER BY month DESC) AS age
    FROM changes_m WINDOW w AS (PARTITION BY series ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query("rolling_compound", f"WITH {ROLLING} SELECT series, strftime(month, '%Y-%m') AS month, round(compounded_pct, 8) AS compounded_pct FROM rolling")
def rolling_compound(spark, sf):
    out = I.rolling_compound(B.changes_by_series(spark, sf), ["series"]).select("series", "month", "compounded_pct")
    return rounded(month_text(out, "month"), 8)


@query("index_level", f"WITH {B.LEVELS} SELECT strftime(month, '%Y-%m') AS month, round(value, 8) AS value, round(index_level, 9) AS index_level FROM levels")
def index_level(spark, sf):
    out = B.market_levels(spark, sf)
    return rounded(month_text(out.withColumn("value", F.round("value", 8)), "month"), 9, "value")


SUMMARY = ROLLING + f""",
summary AS (
    SELECT series, 100 * (exp(sum(ln(1 + value / 100)) FILTER (age <= {12 * YEARS}) / {YEARS}) - 1) AS mean_annual_pct,
           100 * (exp(sum(ln(1 + value / 100)) FILTER (age <= 12)) - 1) AS last_12m_pct,
           min(month) FILTER (age <= {12 * YEARS}) AS first_month, max(month) AS last_month,
           quantile_cont(compounded_pct, 0.1) FILTER (age <= {12 * YEARS}) AS band_low_pct,
           quantile_cont(compounded_pct, 0.9) FILTER (age <= {12 * YEARS}) AS band_high_pct
    FROM rolling GROUP BY series)"""


def _summary(spark, sf):
    return I.index_summary(B.changes_by_series(spark, sf), ["series"], years=YEARS)


@query(
    "compound_rate",
    f"WITH {SUMMARY} SELECT series, strftime(first_month, '%Y-%m') AS first_month, strftime(last_month, '%Y-%m') AS last_month, round(mean_annual_pct, 8) AS mean_annual_pct, round(last_12m_pct, 8) AS last_12m_pct FROM summary",
)
def compound_rate(spark, sf):
    out = _summary(spark, sf).select("series", "first_month", "last_month", "mean_annual_pct", "last_12m_pct")
    return rounded(month_text(out, "first_month", "last_month"), 8)


@query("rolling_band", f"WITH {SUMMARY} SELECT series, round(band_low_pct, 8) AS band_low_pct, round(band_high_pct, 8) AS band_high_pct FROM summary")
def rolling_band(spark, sf):
    return rounded(_summary(spark, sf).select("series", "band_low_pct", "band_high_pct"), 8)


@query(
    "reference_rates",
    f"""WITH {SUMMARY} SELECT series, 'mean' AS choice, round(mean_annual_pct, 8) AS rate_pct FROM summary UNION ALL SELECT series, 'last_12m', round(last_12m_pct, 8) FROM summary
    UNION ALL SELECT series, 'custom', 4.5 FROM summary UNION ALL SELECT series, 'none', NULL FROM summary""",
)
def reference_rates(spark, sf):
    return rounded(I.reference_rates(_summary(spark, sf), ["series"], 4.5), 8)


@query(
    "series_align",
    f"""WITH {B.MONTHLY} SELECT strftime(month, '%Y-%m') AS month, max(total) FILTER (series = '1-URGENT') AS urgent, max(total) FILTER (series = '2-HIGH') AS high,
        max(total) FILTER (series = '5-LOW' AND month(month) <> 7) AS low FROM monthly GROUP BY month""",
)
def series_align(spark, sf):
    """Outer alignment by month; one series misses every July."""
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    series = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("series")]
    long = B.monthly_orders(spark, sf).select(F.coalesce(series, F.lit("other")).alias("series"), "month", F.col("total").alias("value"))
    long = long.filter((F.col("series") != "low") | (F.month("month") != 7))
    return month_text(I.align_series(long, list(names.values())), "month")


@query(
    "blended_index",
    f"""WITH {B.SERIES}, w AS (SELECT month, max(value) FILTER (series = '1-URGENT') AS a, max(value) FILTER (series = '5-LOW') AS b FROM changes_m GROUP BY 1)
    SELECT strftime(month, '%Y-%m') AS month, round((a + b) / 2, 8) AS value, round(exp(sum(ln(1 + (a + b) / 200)) OVER (ORDER BY month)), 8) AS index_level FROM w WHERE a + b IS NOT NULL""",
)
def blended_index(spark, sf):
    """Mean of two monthly changes and its cumulative level."""
    wide = I.align_series(B.changes_by_series(spark, sf), ["1-URGENT", "5-LOW"])
    wide = wide.select("month", F.col("1-URGENT").alias("a"), F.col("5-LOW").alias("b"))
    blended = I.blend_changes(wide, ["a", "b"]).withColumn("series", F.lit("blend"))
    out = I.index_level(blended, ["series"]).select("month", "value", "index_level")
    return rounded(month_text(out, "month"), 8)


MACRO = B.MONTHLY + f""",
mv AS (
    SELECT series, month, CAST(orders AS DOUBLE) AS rate, total AS level, 100 * (total / lag(total) OVER w - 1) / {B.DAMPING} AS inflation,
           100 * (CAST(orders AS DOUBLE) / lag(orders) OVER w - 1) / {B.DAMPING} AS construction
    FROM monthly WINDOW w AS (PARTITION BY series ORDER BY month)),
macro AS (
    SELECT series, month, rate, rate - lag(rate, 12) OVER w AS rate_change_12m, 100 * (level / lag(level, 12) OVER w - 1) AS level_12m,
           CASE WHEN count(inflation) OVER r = 12 THEN 100 * (exp(sum(ln(1 + inflation / 100)) OVER r) - 1) END AS inflation_12m,
           CASE WHEN count(construction) OVER r = 12 THEN 100 * (exp(sum(ln(1 + construction / 100)) OVER r) - 1) END AS construction_12m,
           100 * (lead(level, 12) OVER w / level - 1) AS target, 100 * (pow(level / lag(level, 24) OVER w, 0.5) - 1) AS long_mean
    FROM mv WINDOW w AS (PARTITION BY series ORDER BY month), r AS (PARTITION BY series ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""
MACRO_COLUMNS = ("rate_change_12m", "inflation_12m", "construction_12m", "level_12m", "target", "long_mean")


def macro(spark, sf):
    """Yearly macro features of every order priority."""
    monthly = B.monthly_orders(spark, sf).withColumn("rate", F.col("orders").cast("double"))
    first = monthly.select("series", "month", "rate", F.col("total").alias("level"))

    def damped(column, out):
        change = I.pct_change(monthly, ["series"], column, out)
        return change.select("series", "month", (F.col(out) / B.DAMPING).alias(out))

    wide = first.join(damped("total", "inflation"), ["series", "month"], "left")
    wide = wide.join(damped("rate", "construction"), ["series", "month"], "left")
    return I.macro_features(wide, ["series"], "rate", "inflation", "construction", "level", 24)


@query("macro_features", f"WITH {MACRO} SELECT series, strftime(month, '%Y-%m') AS month, " + ", ".join(f"round({c}, 7) AS {c}" for c in MACRO_COLUMNS) + " FROM macro")
def macro_features(spark, sf):
    return rounded(month_text(macro(spark, sf).select("series", "month", *MACRO_COLUMNS), "month"), 7)


CUTS = ["1998-12-01", "1999-06-01", "1999-12-01"]
FEATURES = ["rate", "rate_change_12m", "inflation_12m", "construction_12m", "level_12m"]
EMBARGO = MACRO + ",\ncuts AS (" + " UNION ALL ".join(f"SELECT DATE '{c}' AS cut" for c in CUTS) + """),
parts AS (
    SELECT m.*, c.cut, CASE WHEN month <= c.cut - INTERVAL 12 MONTH THEN 'train' WHEN month > c.cut THEN 'test' END AS part FROM macro m CROSS JOIN cuts c
    WHERE rate_change_12m IS NOT NULL AND inflation_12m IS NOT NULL AND construction_12m IS NOT NULL AND level_12m IS NOT NULL AND target IS NOT NULL)"""


def embargoed(spark, sf):
    complete = macro(spark, sf).dropna(subset=[*FEATURES, "target"])
    return I.embargo_split(complete, CUTS)


@query(
    "embargo_split",
    f"""WITH {EMBARGO} SELECT strftime(cut, '%Y-%m') AS cut, part, count(*) AS n, strftime(min(month), '%Y-%m') AS first_month, strftime(max(month), '%Y-%m') AS last_month FROM parts
    WHERE part IS NOT NULL GROUP BY 1, 2""",
)
def embargo_split(spark, sf):
    out = embargoed(spark, sf).groupBy("cut", "part").agg(F.count("*").alias("n"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    return month_text(out, "cut", "first_month", "last_month")


@query(
    "naive_references",
    f"""WITH {EMBARGO}, f AS (
        SELECT cut, 'repeat_12m' AS model, level_12m AS p, target FROM parts WHERE part = 'test' UNION ALL SELECT cut, 'long_mean', coalesce(long_mean, level_12m), target FROM parts WHERE part = 'test'
        UNION ALL SELECT cut, 'inflation', inflation_12m, target FROM parts WHERE part = 'test')
    SELECT strftime(cut, '%Y-%m') AS cut, model, round(sqrt(avg(pow(p - target, 2))), 6) AS rmse_pp, round(avg(abs(p - target)), 6) AS mae_pp,
           round(100 * avg(CASE WHEN sign(p) = sign(target) THEN 1.0 ELSE 0.0 END), 6) AS sign_pct, count(*) AS n FROM f GROUP BY 1, 2""",
)
def naive_references(spark, sf):
    test = I.naive_forecasts(embargoed(spark, sf).filter("part = 'test'"))
    return rounded(month_text(models.forecast_metrics(test, ["cut", "model"]), "cut"), 6)


# ---------------------------------------------------------------- factors
@query(
    "index_factor",
    f"""WITH {B.LEVELS}, r AS (
        SELECT CAST(l_partkey AS VARCHAR) AS code, CAST(date_trunc('month', min(l_shipdate)) AS DATE) AS a, CAST(date_trunc('month', max(l_shipdate)) + INTERVAL 6 MONTH AS DATE) AS b FROM lineitem GROUP BY 1),
    lim AS (SELECT min(month) AS lo, max(month) AS hi FROM levels)
    SELECT r.code, strftime(a, '%Y-%m') AS start, strftime(b, '%Y-%m') AS stop, round(y.index_level / x.index_level, 8) AS factor
    FROM r CROSS JOIN lim JOIN levels x ON x.month = greatest(lim.lo, least(r.a, lim.hi)) JOIN levels y ON y.month = greatest(lim.lo, least(r.b, lim.hi))""",
)
def index_factor(spark, sf):
    lines = B.table(spark, sf, "lineitem").select(B.text("l_partkey").alias("code"), F.col("l_shipdate").cast("date").alias("day"))
    rows = lines.groupBy("code").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    rows = rows.select("code", month_start(F.col("a")).alias("start"), F.add_months(month_start(F.col("b")), 6).alias("stop"))
    out = I.with_factor(rows, stored(B.market_levels(spark, sf)), F.col("start"), F.col("stop"))
    return rounded(month_text(out.select("code", "start", "stop", "factor"), "start", "stop"), 8)


@query(
    "ipca_adjust",
    f"""WITH {B.LEVELS}, o AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_extendedprice AS price FROM lineitem)
    SELECT strftime(o.month, '%Y-%m') AS month, count(*) AS n, round(avg(coalesce((SELECT index_level FROM levels WHERE month = DATE '2001-06-01') / l.index_level, 1.0)), 8) AS factor,
           round(sum(o.price * coalesce((SELECT index_level FROM levels WHERE month = DATE '2001-06-01') / l.index_level, 1.0)), 2) AS adjusted
    FROM o LEFT JOIN levels l ON l.month = o.month GROUP BY 1""",
)
def ipca_adjust(spark, sf):
    """Prices brought to a reference month by the index of their own month, 1 where it is missing."""
    lines = B.table(spark, sf, "lineitem").select(month_start(F.col("l_shipdate").cast("date")).alias("month"), F.col("l_extendedprice").alias("price"))
    out = I.with_month_factor(lines, stored(B.market_levels(spark, sf)), "month", F.lit("2001-06-01").cast("date"))
    agg = out.groupBy("month").agg(F.count("*").alias("n"), F.avg("factor").alias("factor"), F.round(F.sum(F.col("price") * F.col("factor")), 2).alias("adjusted"))
    return rounded(month_text(agg, "month"), 8, "adjusted")


# ---------------------------------------------------------------- reference month and back-cast
LATEST = "(l_shipdate, l_orderkey, l_linenumber, l_suppkey)"
REAL = B.LEVELS + f""",
latest AS (
    SELECT l_partkey AS entity, CAST(date_trunc('month', max(l_shipdate)) AS DATE) AS month, arg_max(l_extendedprice, {LATEST}) AS price FROM lineitem GROUP BY 1),
lim AS (SELECT min(month) AS lo, max(month) AS hi FROM levels),
newest AS (SELECT max(month) AS m FROM latest),
ref_level AS (SELECT index_level AS v FROM levels, lim, newest WHERE levels.month = greatest(lo, least(m, hi))),
real_rows AS (
    SELECT l.entity, l.price AS announced_price, l.month AS announced_month, l.price * ((SELECT v FROM ref_level) / x.index_level) AS price, (SELECT m FROM newest) AS month,
           year((SELECT m FROM newest)) + (month((SELECT m FROM newest)) - 0.5) / 12.0 AS year, (l.entity % 7 - 3) / 4.0 AS adjustment_pp,
           p_type AS kind, p_brand AS district, CAST(p_size AS DOUBLE) AS area_total
    FROM latest l JOIN part ON p_partkey = l.entity CROSS JOIN lim JOIN levels x ON x.month = greatest(lim.lo, least(l.month, lim.hi)))"""
PAST_YEARS = [1996, 1997, 1998, 1999, 2000]


def past_sql(divisor: str) -> str:
    return REAL + f""",
past AS (
    SELECT r.* EXCLUDE (price, month, year), y.y AS y, make_date(y.y, 6, 1) AS month, y.y + 5.5 / 12.0 AS year,
           r.price / ((SELECT v FROM ref_level) / x.index_level{divisor}) AS price
    FROM real_rows r CROSS JOIN (SELECT unnest({PAST_YEARS}) AS y) y CROSS JOIN lim JOIN levels x ON x.month = greatest(lim.lo, least(make_date(y.y, 6, 1), lim.hi)))"""


ADJUSTED = " * pow(1 + r.adjustment_pp / 100, r.year - (y.y + 5.5 / 12.0))"


def real_rows(spark, sf, levels):
    """Latest observation of each part, brought to the newest month."""
    lines = B.table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    latest = lines.groupBy(F.col("l_partkey").alias("entity")).agg(
        month_start(F.max("l_shipdate").cast("date")).alias("month"), F.max_by("l_extendedprice", order).alias("price")
    )
    part = B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("entity"), F.col("p_type").alias("kind"), F.col("p_brand").alias("district"), F.col("p_size").cast("double").alias("area_total")
    )
    rows = latest.join(part, "entity").withColumn("adjustment_pp", (F.col("entity") % 7 - 3) / 4.0)
    return I.to_reference_month(rows, levels)


def _levels_and_rows(spark, sf):
    levels = stored(B.market_levels(spark, sf))
    return levels, stored(real_rows(spark, sf, levels))


@query(
    "index_to_reference",
    f"WITH {REAL} SELECT entity, announced_price, strftime(announced_month, '%Y-%m') AS announced_month, round(price, 5) AS price, strftime(month, '%Y-%m') AS month, round(year, 8) AS year FROM real_rows",
)
def index_to_reference(spark, sf):
    rows = real_rows(spark, sf, stored(B.market_levels(spark, sf)))
    out = rows.select("entity", "announced_price", "announced_month", F.round("price", 5).alias("price"), "month", F.round("year", 8).alias("year"))
    return month_text(out, "announced_month", "month")


def _past_columns(df):
    return month_text(df.select("entity", "month", F.round("year", 8).alias("year"), F.round("price", 5).alias("price")), "month")


@query("backcast_index", f"WITH {past_sql('')} SELECT entity, strftime(month, '%Y-%m') AS month, round(year, 8) AS year, round(price, 5) AS price FROM past")
def backcast_index(spark, sf):
    levels, rows = _levels_and_rows(spark, sf)
    return _past_columns(I.backcast(rows, levels, PAST_YEARS))


@query("backcast_adjusted", f"WITH {past_sql(ADJUSTED)} SELECT entity, strftime(month, '%Y-%m') AS month, round(year, 8) AS year, round(price, 5) AS price FROM past")
def backcast_adjusted(spark, sf):
    levels, rows = _levels_and_rows(spark, sf)
    return _past_columns(I.backcast(rows, levels, PAST_YEARS, "adjustment_pp"))


@query(
    "export_dataset",
    f"""WITH {past_sql(ADJUSTED)}
    SELECT entity, 0 AS simulated, round(year, 8) AS year, strftime(month, '%Y-%m') AS month, kind, district, area_total, round(price, 0) AS price, strftime(announced_month, '%Y-%m') AS announced_month,
           round(announced_price, 0) AS announced_price, CAST(round(adjustment_pp, 3) AS DOUBLE) AS adjustment_pp FROM real_rows
    UNION ALL SELECT entity, 1, round(year, 8), strftime(month, '%Y-%m'), kind, district, area_total, round(price, 0), NULL, NULL, CAST(round(adjustment_pp, 3) AS DOUBLE) FROM past""",
)
def export_dataset(spark, sf):
    """Real and simulated rows in the published columns: written as table and CSV, and read back from the table."""
    levels, rows = _levels_and_rows(spark, sf)
    both = rows.unionByName(I.backcast(rows, levels, PAST_YEARS, "adjustment_pp"))
    missing = {c: F.lit(None).cast("double") for c in ("area_private", "rooms", "baths", "parking")}
    out = I.export_dataset(both.withColumns(missing), ("adjustment_pp",)).drop(*missing)
    folder = B.shared_folder(spark, "published")
    publish(out.withColumn("year", F.round("year", 8)), folder, "listings", ["entity", "year"])
    return read_published(spark, folder, "listings")


@query(
    "version_compare",
    f"""WITH {past_sql(ADJUSTED)}, plain AS (
        SELECT r.entity, y.y, r.price / ((SELECT v FROM ref_level) / x.index_level) AS price
        FROM real_rows r CROSS JOIN (SELECT unnest({PAST_YEARS}) AS y) y CROSS JOIN lim JOIN levels x ON x.month = greatest(lim.lo, least(make_date(y.y, 6, 1), lim.hi)))
    SELECT a.entity, a.y AS year, round(100 * a.price / r.price, 7) AS plain_pct, round(100 * b.price / r.price, 7) AS adjusted_pct
    FROM plain a JOIN past b ON a.entity = b.entity AND a.y = b.y JOIN real_rows r ON r.entity = a.entity""",
)
def version_compare(spark, sf):
    """The same entity and year under both back-casts, as a share of today's price."""
    levels, rows = _levels_and_rows(spark, sf)
    year = F.year("month").alias("year")
    plain = I.backcast(rows, levels, PAST_YEARS).select("entity", year, F.col("price").alias("plain"))
    adjusted = I.backcast(rows, levels, PAST_YEARS, "adjustment_pp").select("entity", year, F.col("price").alias("adjusted"))
    both = plain.join(adjusted, ["entity", "year"]).join(rows.select("entity", "price"), "entity")
    return both.select(
        "entity", "year", F.round(100.0 * F.col("plain") / F.col("price"), 7).alias("plain_pct"), F.round(100.0 * F.col("adjusted") / F.col("price"), 7).alias("adjusted_pct")
    )


@query(
    "positional_sample",
    f"""WITH {REAL}, r AS (
        SELECT kind, entity, adjustment_pp, row_number() OVER (PARTITION BY kind ORDER BY adjustment_pp, entity) - 1 AS position, count(*) OVER (PARTITION BY kind) AS n FROM real_rows)
    SELECT kind, entity, CAST(adjustment_pp AS DOUBLE) AS adjustment_pp, position FROM r WHERE position IN (0, n // 3, 2 * n // 3, n - 1)""",
)
def positional_sample(spark, sf):
    _, rows = _levels_and_rows(spark, sf)
    out = rates.positional_sample(rows.select("kind", "entity", "adjustment_pp"), ["kind"], "adjustment_pp", "entity")
    return out.select("kind", "entity", "adjustment_pp", "position")
