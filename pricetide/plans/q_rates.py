"""Long-run rates, bootstrap, credibility, blending and the fuzzy adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy as Z
from ..functions.hashing import DRAWS, poisson_thresholds
from ..operators import index as I
from ..operators import panel as P
from ..operators import rates as R
from ..session import spread, stored
from . import bindings as B
from .q_panel import rounded
from .q_scalars import _trapezoid_sql
from .registry import query

YEARS = 5

SUMS = B.REPEATS + """,
sums AS (SELECT code, min(district) AS district, min(kind) AS kind, sum(dlog) AS dlog, CAST(sum(gap) AS BIGINT) AS gap FROM repeats GROUP BY 1)"""


def sums(spark, sf):
    return R.entity_sums(P.repeat_pairs(B.panel(spark, sf)))


@query("entity_sums", f"WITH {SUMS} SELECT code, district, kind, round(dlog, 9) AS dlog, gap FROM sums")
def entity_sums(spark, sf):
    return rounded(sums(spark, sf))


POINTS = SUMS + """,
seg_rate AS (SELECT district, kind, sum(dlog) / sum(gap) AS monthly, CAST(sum(gap) AS BIGINT) AS months, count(*) AS entities FROM sums GROUP BY 1, 2),
kind_rate AS (SELECT kind, sum(dlog) / sum(gap) AS monthly, CAST(sum(gap) AS BIGINT) AS months, count(*) AS entities FROM sums GROUP BY 1)"""


@query(
    "segment_rates",
    f"""WITH {POINTS} SELECT 'segment' AS level, district, kind, round(monthly, 9) AS monthly, months, entities FROM seg_rate
    UNION ALL SELECT 'kind', NULL, kind, round(monthly, 9), months, entities FROM kind_rate""",
)
def segment_rates(spark, sf):
    return rounded(R.segment_rates(sums(spark, sf)))


WEIGHT = " + ".join(f"CAST(u >= {t!r} AS INTEGER)" for t in poisson_thresholds())
BOOT = POINTS + f""",
draws AS (SELECT s.*, g.replica, {B.uniform_sql('s.code', f'(g.replica - 1) // {DRAWS}', "'42'", place=f'(g.replica - 1) % {DRAWS}')} AS u FROM sums s CROSS JOIN (SELECT unnest(range(1, {R.BOOTSTRAP_REPLICAS + 1})) AS replica) g),
weighted AS (SELECT *, {WEIGHT} AS w FROM draws),
seg_boot AS (SELECT district, kind, replica, sum(w * dlog) / sum(w * gap) AS rate FROM weighted WHERE w > 0 GROUP BY 1, 2, 3),
kind_boot AS (SELECT kind, replica, sum(w * dlog) / sum(w * gap) AS rate FROM weighted WHERE w > 0 GROUP BY 1, 2)"""


@query(
    "bootstrap_rates",
    f"""WITH {BOOT}
    SELECT 'segment' AS level, p.district, p.kind, p.entities, round(p.monthly, 9) AS monthly, round(b.lo, 9) AS monthly_low, round(b.hi, 9) AS monthly_high
    FROM seg_rate p JOIN (SELECT district, kind, quantile_cont(rate, 0.1) AS lo, quantile_cont(rate, 0.9) AS hi FROM seg_boot GROUP BY 1, 2) b ON b.district = p.district AND b.kind = p.kind
    UNION ALL
    SELECT 'kind', NULL, p.kind, p.entities, round(p.monthly, 9), round(b.lo, 9), round(b.hi, 9)
    FROM kind_rate p JOIN (SELECT kind, quantile_cont(rate, 0.1) AS lo, quantile_cont(rate, 0.9) AS hi FROM kind_boot GROUP BY 1) b ON b.kind = p.kind""",
)
def bootstrap_rates(spark, sf):
    return rounded(R.bootstrap_rates(stored(sums(spark, sf))))


MIN_ENTITIES = 12
CREDIBLE = BOOT + f""",
own AS (SELECT *, entities / (entities + {float(R.CREDIBILITY_K)}) AS weight FROM seg_rate WHERE entities >= {MIN_ENTITIES}),
mixed AS (
    SELECT o.district, o.kind, o.weight * s.rate + (1 - o.weight) * k.rate AS rate
    FROM own o JOIN seg_boot s ON s.district = o.district AND s.kind = o.kind JOIN kind_boot k ON k.kind = o.kind AND k.replica = s.replica),
credible AS (
    SELECT o.district, o.kind, o.entities, o.weight, o.monthly AS raw, o.weight * o.monthly + (1 - o.weight) * k.monthly AS monthly, m.lo AS monthly_low, m.hi AS monthly_high
    FROM own o JOIN kind_rate k ON k.kind = o.kind
    JOIN (SELECT district, kind, quantile_cont(rate, 0.1) AS lo, quantile_cont(rate, 0.9) AS hi FROM mixed GROUP BY 1, 2) m ON m.district = o.district AND m.kind = o.kind)"""


def credible(spark, sf):
    return R.credibility_rates(stored(sums(spark, sf)), min_entities=MIN_ENTITIES)


@query(
    "credibility_rates",
    f"WITH {CREDIBLE} SELECT district, kind, entities, round(weight, 9) AS weight, round(raw, 9) AS raw, round(monthly, 9) AS monthly, round(monthly_low, 9) AS monthly_low, round(monthly_high, 9) AS monthly_high FROM credible",
)
def credibility_rates(spark, sf):
    return rounded(credible(spark, sf))


@query(
    "rate_lookup",
    f"""WITH {POINTS} SELECT f.code, round(coalesce(s.monthly, k.monthly), 9) AS monthly, CASE WHEN s.monthly IS NOT NULL THEN 'district' ELSE 'kind' END AS rate_source
    FROM features f LEFT JOIN (SELECT * FROM seg_rate WHERE entities >= {MIN_ENTITIES}) s ON s.district = f.district AND s.kind = f.kind LEFT JOIN kind_rate k ON k.kind = f.kind""",
)
def rate_lookup(spark, sf):
    table = stored(R.segment_rates(sums(spark, sf)))
    fine = table.filter(f"level = 'segment' AND entities >= {MIN_ENTITIES}")
    out = R.rate_lookup(B.features(spark, sf).select("code", "district", "kind"), fine, table.filter("level = 'kind'"))
    return rounded(out.select("code", "monthly", "rate_source"))


# ---------------------------------------------------------------- blending with an index
MARKET = """,
msum AS (
    SELECT month, value, row_number() OVER (ORDER BY month DESC) AS age,
           CASE WHEN count(value) OVER w = 12 THEN 100 * (exp(sum(ln(1 + value / 100)) OVER w) - 1) END AS c12
    FROM levels WINDOW w AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
market_summary AS (
    SELECT 100 * (exp(sum(ln(1 + value / 100)) FILTER (age <= 60) / 5) - 1) AS mean_pct, quantile_cont(c12, 0.1) FILTER (age <= 60) AS lo_pct, quantile_cont(c12, 0.9) FILTER (age <= 60) AS hi_pct FROM msum),
observed AS (SELECT greatest(1, max(month_n) - min(month_n)) AS t FROM panel),
blended AS (
    SELECT c.district, c.kind, c.entities, c.weight, t / (t + 12.0) AS data_weight,
           t / (t + 12.0) * c.monthly + 12.0 / (t + 12.0) * ln(1 + mean_pct / 100) / 12 AS monthly,
           t / (t + 12.0) * c.monthly_low + 12.0 / (t + 12.0) * ln(1 + lo_pct / 100) / 12 AS monthly_low,
           t / (t + 12.0) * c.monthly_high + 12.0 / (t + 12.0) * ln(1 + hi_pct / 100) / 12 AS monthly_high
    FROM credible c CROSS JOIN market_summary CROSS JOIN observed)"""
BLENDED = CREDIBLE + ",\n" + B.LEVELS + MARKET


def blended(spark, sf):
    panel = B.stored_panel(spark, sf)
    table = R.credibility_rates(stored(R.entity_sums(P.repeat_pairs(panel))), min_entities=MIN_ENTITIES)
    changes = B.market_levels(spark, sf).withColumn("series", F.lit("market"))
    summary = stored(I.index_summary(changes, ["series"], years=YEARS))
    months = panel.select(F.greatest(F.lit(1), F.max("month_n") - F.min("month_n"))).scalar()
    return I.prior_blend(table, summary, months)


@query(
    "prior_blend",
    f"WITH {BLENDED} SELECT district, kind, round(data_weight, 9) AS data_weight, round(monthly, 9) AS monthly, round(monthly_low, 9) AS monthly_low, round(monthly_high, 9) AS monthly_high FROM blended",
)
def prior_blend(spark, sf):
    return rounded(blended(spark, sf).select("district", "kind", "data_weight", "monthly", "monthly_low", "monthly_high"))


@query(
    "scenario_projection",
    f"""WITH {BLENDED} SELECT district, kind, CAST(y AS INTEGER) AS year, round(100000 * exp(12 * monthly_low * y), 3) AS pessimistic, round(100000 * exp(12 * monthly * y), 3) AS central,
        round(100000 * exp(12 * monthly_high * y), 3) AS optimistic, round(100000 * pow(1.045, y), 3) AS reference FROM blended CROSS JOIN (SELECT unnest(range(0, 11)) AS y)""",
)
def scenario_projection(spark, sf):
    rows = blended(spark, sf).withColumn("value", F.lit(100000.0)).withColumn("reference_pct", F.lit(4.5))
    out = I.scenario_projection(rows, 10, "reference_pct")
    return rounded(out.select("district", "kind", "year", "pessimistic", "central", "optimistic", "reference"), 3)


@query(
    "district_rate_table",
    f"""WITH {BLENDED} SELECT district, kind, entities, round(100 * (exp(12 * monthly) - 1), 7) AS central_pct, round(100 * (exp(12 * monthly_low) - 1), 7) AS low_pct,
        round(100 * (exp(12 * monthly_high) - 1), 7) AS high_pct, row_number() OVER (PARTITION BY kind ORDER BY round(100 * (exp(12 * monthly) - 1), 7) DESC, district) AS position FROM blended""",
)
def district_rate_table(spark, sf):
    """Blended annual rates by district, best first inside each kind."""
    from pyspark.sql import Window

    out = blended(spark, sf)
    for name, rate in (("central_pct", "monthly"), ("low_pct", "monthly_low"), ("high_pct", "monthly_high")):
        out = out.withColumn(name, F.round(100.0 * F.expm1(12.0 * F.col(rate)), 7))
    order = Window.partitionBy("kind").orderBy(F.desc("central_pct"), "district")
    out = out.withColumn("position", F.row_number().over(order).cast("long"))
    return out.select("district", "kind", "entities", "central_pct", "low_pct", "high_pct", "position")


@query(
    "segment_rate_ranking",
    f"""WITH {CREDIBLE}, k AS (SELECT kind, 100 * (exp(12 * monthly) - 1) AS kind_pct FROM kind_rate)
    SELECT c.district, c.kind, c.entities, round(100 * (exp(12 * monthly) - 1), 7) AS central_pct, round(100 * (exp(12 * monthly_low) - 1), 7) AS low_pct,
           round(100 * (exp(12 * monthly_high) - 1), 7) AS high_pct, round(k.kind_pct, 7) AS kind_pct FROM credible c JOIN k ON k.kind = c.kind WHERE entities >= 15""",
)
def segment_rate_ranking(spark, sf):
    """Segments with enough entities, beside the rate of their kind, lowest first."""
    base = stored(sums(spark, sf))
    kinds = R.segment_rates(base).filter("level = 'kind'").select("kind", F.round(100.0 * F.expm1(12.0 * F.col("monthly")), 7).alias("kind_pct"))
    out = R.credibility_rates(base, min_entities=MIN_ENTITIES).filter("entities >= 15")
    for name, rate in (("central_pct", "monthly"), ("low_pct", "monthly_low"), ("high_pct", "monthly_high")):
        out = out.withColumn(name, F.round(100.0 * F.expm1(12.0 * F.col(rate)), 7))
    out = out.join(kinds, "kind").select("district", "kind", "entities", "central_pct", "low_pct", "high_pct", "kind_pct")
    return out.orderBy("kind", "central_pct", "district")


# ---------------------------------------------------------------- trend and fuzzy adjustment
TREND = B.PANEL + """,
ends AS (SELECT code, arg_min(price, month_n) AS p0, arg_max(price, month_n) AS p1, min(month_n) AS m0, max(month_n) AS m1 FROM panel GROUP BY 1),
trend AS (
    SELECT f.kind, f.district, avg(greatest(-50, least(50, ln(p1 / p0) * 12 / (m1 - m0) * 100))) AS trend_pct, count(*) AS entities
    FROM ends e JOIN features f ON f.code = e.code WHERE m1 > m0 GROUP BY 1, 2)"""


def trend(spark, sf):
    return R.district_trend(B.panel(spark, sf), B.features(spark, sf))


@query("district_trend", f"WITH {TREND} SELECT kind, district, round(trend_pct, 9) AS trend_pct, entities FROM trend")
def district_trend(spark, sf):
    return rounded(trend(spark, sf))


def train_rows(spark, sf):
    """Listings with a current price, as the rulers need them."""
    part = B.table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("entity"), F.col("p_type").alias("kind"), F.col("p_brand").alias("district"), F.col("p_size").cast("double").alias("area_ref"),
        (F.col("p_retailprice") * (F.col("p_size") + F.col("p_partkey") % 13)).alias("price"),
    )


RULERS = TREND + """,
train AS (
    SELECT p_partkey AS entity, p_type AS kind, p_brand AS district, CAST(p_size AS DOUBLE) AS area_ref, p_retailprice * (p_size + p_partkey % 13) AS price FROM part),
ruler_kind AS (SELECT kind, quantile_cont(price / area_ref, 0.5) AS kind_price_m2, quantile_cont(area_ref, 0.5) AS kind_area FROM train GROUP BY 1),
ruler_price AS (
    SELECT t.kind, t.district, quantile_cont(price / area_ref, 0.5) / min(k.kind_price_m2) AS district_price FROM train t JOIN ruler_kind k ON k.kind = t.kind GROUP BY 1, 2 HAVING count(*) >= 10),
ruler_trend AS (SELECT kind, district, trend_pct * entities / (entities + 20.0) AS trend FROM trend WHERE entities >= 10),
fin AS (
    SELECT t.entity, t.kind, t.district, coalesce(p.district_price, 1.0) AS district_price, t.area_ref / k.kind_area AS area, coalesce(r.trend, 0.0) AS trend
    FROM train t JOIN ruler_kind k ON k.kind = t.kind LEFT JOIN ruler_price p ON p.kind = t.kind AND p.district = t.district
    LEFT JOIN ruler_trend r ON r.kind = t.kind AND r.district = t.district)"""


@query(
    "fuzzy_rulers",
    f"""WITH {RULERS} SELECT coalesce(p.kind, r.kind) AS kind, coalesce(p.district, r.district) AS district, round(p.district_price, 9) AS district_price, round(r.trend, 9) AS trend
    FROM ruler_price p FULL JOIN ruler_trend r ON r.kind = p.kind AND r.district = p.district""",
)
def fuzzy_rulers(spark, sf):
    return rounded(R.fuzzy_rulers(train_rows(spark, sf), trend(spark, sf))[1])


def inputs(spark, sf):
    train = train_rows(spark, sf)
    kinds, districts = R.fuzzy_rulers(train, trend(spark, sf))
    table = R.fuzzy_inputs(train, kinds, districts).select("entity", "kind", "district", "district_price", "area", "trend")
    # The centroid costs hundreds of steps a row; the table's own size says whether few tasks would read it.
    table = stored(table)
    return spread(table, table, "entity")


@query("fuzzy_inputs", f"WITH {RULERS} SELECT entity, round(district_price, 9) AS district_price, round(area, 9) AS area, round(trend, 9) AS trend FROM fin")
def fuzzy_inputs(spark, sf):
    return rounded(inputs(spark, sf).select("entity", "district_price", "area", "trend"))


def _strength_sql(i: int) -> str:
    terms = [_trapezoid_sql(name, Z.INPUT_SETS[name][term]) for name, term in Z.RULES[i][0].items()]
    return f"least(1.0, {', '.join(terms)})"


STRENGTHS = RULERS + ",\nfired AS (SELECT *, " + ", ".join(f"{_strength_sql(i)} AS r{i + 1}" for i in range(len(Z.RULES))) + " FROM fin)"
GRID_AREA = "greatest(0.0, " + ", ".join(f"least(r{i + 1}, {_trapezoid_sql('y', Z.OUTPUT_SETS[out])})" for i, (_, out) in enumerate(Z.RULES)) + ")"
CENTROID = STRENGTHS + f""",
profile AS (SELECT entity, kind, district, district_price, area, trend, y, {GRID_AREA} AS h FROM fired CROSS JOIN (SELECT -1.5 + 3.0 * i / 600 AS y FROM (SELECT unnest(range(0, 601)) AS i))),
raw AS (SELECT entity, kind, min(district) AS district, min(area) AS area, CASE WHEN sum(h) > 0 THEN sum(h * y) / sum(h) ELSE 0.0 END AS raw_pp FROM profile GROUP BY 1, 2),
adjusted AS (SELECT *, raw_pp - avg(raw_pp) OVER (PARTITION BY kind) AS adjustment_pp FROM raw)"""


@query("fuzzy_rules", f"WITH {STRENGTHS} SELECT entity, " + ", ".join(f"round(r{i + 1}, 8) AS r{i + 1}" for i in range(len(Z.RULES))) + " FROM fired")
def fuzzy_rules(spark, sf):
    _, strengths, _ = R.fuzzy_columns()
    return inputs(spark, sf).select("entity", *[F.round(s, 8).alias(f"r{i + 1}") for i, s in enumerate(strengths)])


@query("fuzzy_centroid", f"WITH {CENTROID} SELECT entity, round(raw_pp, 8) + 0.0 AS raw_pp FROM raw")
def fuzzy_centroid(spark, sf):
    _, _, raw = R.fuzzy_columns()
    return inputs(spark, sf).select("entity", (F.round(raw, 8) + 0.0).alias("raw_pp"))


def adjustment(spark, sf):
    return R.fuzzy_adjustment(inputs(spark, sf))


@query("fuzzy_adjustment", f"WITH {CENTROID} SELECT entity, kind, round(adjustment_pp, 8) + 0.0 AS adjustment_pp FROM adjusted")
def fuzzy_adjustment(spark, sf):
    return adjustment(spark, sf).select("entity", "kind", (F.round("adjustment_pp", 8) + 0.0).alias("adjustment_pp"))


@query("group_center", f"WITH {RULERS} SELECT entity, kind, round(area - avg(area) OVER (PARTITION BY kind), 9) AS centered FROM fin")
def group_center(spark, sf):
    out = R.center_by(inputs(spark, sf), "area", "kind", "centered")
    return rounded(out.select("entity", "kind", "centered"))


@query(
    "fuzzy_explain",
    f"""WITH {CENTROID} SELECT f.entity, round({_trapezoid_sql('f.district_price', Z.INPUT_SETS['district_price']['cheap'])}, 8) AS cheap,
        (r1 > 0)::INT + (r2 > 0)::INT + (r3 > 0)::INT + (r4 > 0)::INT + (r5 > 0)::INT + (r6 > 0)::INT + (r7 > 0)::INT + (r8 > 0)::INT + (r9 > 0)::INT + (r10 > 0)::INT + (r11 > 0)::INT + (r12 > 0)::INT AS fired,
        round(greatest(r1, r2, r3, r4, r5, r6, r7, r8, r9, r10, r11, r12), 8) AS strongest, round(raw.raw_pp, 8) + 0.0 AS raw_pp FROM fired f JOIN raw ON raw.entity = f.entity""",
)
def fuzzy_explain(spark, sf):
    out = R.fuzzy_explanation(inputs(spark, sf))
    strengths = F.col("rules")["strength"]
    return out.select(
        "entity",
        F.round("district_price_cheap", 8).alias("cheap"),
        F.size(F.filter(strengths, lambda s: s > 0)).alias("fired"),
        F.round(F.array_max(strengths), 8).alias("strongest"),
        (F.round("raw_pp", 8) + 0.0).alias("raw_pp"),
    )


def _rated(spark, sf):
    rows = adjustment(spark, sf)
    base = (F.col("area") + 4.0) / 1000.0
    return rows.withColumns({"monthly": base, "monthly_low": base - 0.001, "monthly_high": base + 0.001, "data_weight": F.lit(0.3)})


@query(
    "adjusted_projection",
    f"""WITH {CENTROID} SELECT entity, round(100 * (exp(12 * (area + 4.0) / 1000) - 1) + 0.7 * adjustment_pp, 7) AS central_pct,
        round(100 * (exp(12 * ((area + 4.0) / 1000 - 0.001)) - 1) + 0.7 * adjustment_pp, 7) AS low_pct, round(100 * (exp(12 * ((area + 4.0) / 1000 + 0.001)) - 1) + 0.7 * adjustment_pp, 7) AS high_pct FROM adjusted""",
)
def adjusted_projection(spark, sf):
    """Index-blended rates plus the part of the row's own adjustment the index weighs."""
    out = R.projected_rates(_rated(spark, sf))
    return rounded(out.select("entity", "central_pct", "low_pct", "high_pct"), 7)


DIST = """count(v) AS n, round(min(v), 7) + 0.0 AS min, round(quantile_cont(v, 0.1), 7) + 0.0 AS p10, round(quantile_cont(v, 0.5), 7) + 0.0 AS median, round(avg(v), 7) + 0.0 AS mean,
    round(quantile_cont(v, 0.9), 7) + 0.0 AS p90, round(max(v), 7) + 0.0 AS max"""


@query(
    "distribution_summary",
    f"""WITH {CENTROID}, d AS (SELECT kind, district, 5.8 + adjustment_pp AS v FROM adjusted)
    SELECT kind, NULL AS district, {DIST} FROM d GROUP BY 1 UNION ALL SELECT kind, district, {DIST} FROM d GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def distribution_summary(spark, sf):
    """Rates of each listing (index mean plus adjustment) by kind and by district."""
    rows = stored(adjustment(spark, sf).withColumn("v", 5.8 + F.col("adjustment_pp")))
    kinds = R.distribution(rows, ["kind"], "v").withColumn("district", F.lit(None).cast("string"))
    both = kinds.unionByName(R.distribution(rows, ["kind", "district"], "v", 10))
    return both.select("kind", "district", "n", *[(F.round(c, 7) + 0.0).alias(c) for c in ("min", "p10", "median", "mean", "p90", "max")])
