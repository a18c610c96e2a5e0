"""Cleaning rules learned on one part and applied to another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from . import bindings as B
from .registry import query

RARE_MIN = 320


def split_rows(spark, sf):
    """Observations with hold-out parts and the columns of a training frame."""
    row = F.concat_ws("-", *[B.text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    obs = B.spread_observations(spark, sf).withColumn("row_id", row)
    obs = obs.withColumn("area_private", F.when(F.col("l_linenumber") % 3 == 0, 0.0).otherwise(F.col("area"))).withColumnRenamed("area", "area_total")
    return clean.holdout_split(obs, "row_id").drop("l_orderkey", "l_linenumber", "l_suppkey", "source", "day")


ROWS = B.SPLIT + """,
rows_all AS (SELECT row_id, code, part, kind, district, price, area AS area_total, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE area END AS area_private, rooms, baths, parking FROM split),
tr AS (SELECT * FROM rows_all WHERE part = 'train')"""


@query(
    "rare_category",
    f"""WITH {ROWS}, rare AS (SELECT kind, district FROM tr GROUP BY 1, 2 HAVING count(*) < {RARE_MIN})
    SELECT a.part, a.kind, CASE WHEN r.kind IS NOT NULL THEN 'outros' ELSE a.district END AS district, count(*) AS n
    FROM rows_all a LEFT JOIN rare r ON r.kind = a.kind AND r.district = a.district GROUP BY 1, 2, 3""",
)
def rare_category(spark, sf):
    """Through the estimator: learned on train, applied to everything."""
    rows = split_rows(spark, sf)
    model = clean.RareCategories(by=["kind"], min_count=RARE_MIN).fit(rows.filter("part = 'train'"))
    return model.transform(rows).groupBy("part", "kind", "district").agg(F.count("*").alias("n"))


CLIP = """bounds AS (SELECT kind, """ + ", ".join(
    f"quantile_cont({c}, 0.02) FILTER ({c} > 0) AS {c}_lo, quantile_cont({c}, 0.98) FILTER ({c} > 0) AS {c}_hi" for c in clean.NUMERIC_COLUMNS
) + " FROM tr GROUP BY 1)"


@query(
    "quantile_clip",
    f"""WITH {ROWS}, {CLIP} SELECT a.part, a.kind, count(*) AS n, """
    + ", ".join(f"round(sum(greatest(b.{c}_lo, least(b.{c}_hi, a.{c}))), 4) AS {c}" for c in clean.NUMERIC_COLUMNS)
    + " FROM rows_all a JOIN bounds b ON b.kind = a.kind GROUP BY 1, 2",
)
def quantile_clip(spark, sf):
    rows = split_rows(spark, sf)
    model = clean.QuantileClip(by=["kind"]).fit(rows.filter("part = 'train'"))
    out = model.transform(rows).groupBy("part", "kind")
    return out.agg(F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in clean.NUMERIC_COLUMNS])


FENCES = """shaped AS (SELECT *, price / (CASE WHEN area_private > 0 THEN area_private ELSE area_total END) AS price_m2 FROM rows_all),
q AS (
    SELECT kind, quantile_cont(price, 0.25) AS a1, quantile_cont(price, 0.75) AS a3, quantile_cont(price_m2, 0.25) AS b1, quantile_cont(price_m2, 0.75) AS b3
    FROM shaped WHERE part = 'train' GROUP BY 1),
marked AS (
    SELECT s.*, price BETWEEN a1 - 1.5 * (a3 - a1) AND a3 + 1.5 * (a3 - a1) AND price_m2 BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1) AS typical
    FROM shaped s JOIN q ON q.kind = s.kind)"""


@query("iqr_filter", f"WITH {ROWS}, {FENCES} SELECT part, kind, typical, count(*) AS n, round(sum(price), 2) AS price_sum FROM marked GROUP BY 1, 2, 3")
def iqr_filter(spark, sf):
    rows = clean.price_per_area_column(split_rows(spark, sf))
    model = clean.IqrFence(by=["kind"]).fit(rows.filter("part = 'train'"))
    return model.transform(rows).groupBy("part", "kind", "typical").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price_sum"))


@query(
    "median_target_encode",
    f"""WITH {ROWS}, e AS (SELECT code, quantile_cont(price / area_total, 0.5) AS v FROM tr GROUP BY 1 HAVING count(*) >= 25), o AS (SELECT quantile_cont(price / area_total, 0.5) AS v FROM tr)
    SELECT a.row_id, coalesce(e.v, (SELECT v FROM o)) AS encoded FROM rows_all a LEFT JOIN e ON e.code = a.code WHERE a.part = 'test'""",
)
def median_target_encode(spark, sf):
    rows = split_rows(spark, sf).withColumn("price_m2", F.col("price") / F.col("area_total"))
    model = clean.MedianTargetEncoder("code", "price_m2", "encoded", 25).fit(rows.filter("part = 'train'"))
    return model.transform(rows.filter("part = 'test'")).select("row_id", "encoded")


@query(
    "leakfree_prepare",
    f"""WITH {ROWS}, {CLIP}, rare AS (SELECT kind, district FROM tr GROUP BY 1, 2 HAVING count(*) < {RARE_MIN}),
    held AS (
        SELECT a.part, a.kind, CASE WHEN r.kind IS NOT NULL THEN 'outros' ELSE a.district END AS district, a.price, greatest(b.area_total_lo, least(b.area_total_hi, a.area_total)) AS area_total,
               greatest(b.area_private_lo, least(b.area_private_hi, a.area_private)) AS area_private
        FROM rows_all a JOIN bounds b ON b.kind = a.kind LEFT JOIN rare r ON r.kind = a.kind AND r.district = a.district),
    {FENCES.replace('FROM rows_all', 'FROM held')}
    SELECT part, kind, district, typical, count(*) AS n, round(sum(price), 2) AS price_sum, round(sum(area_private), 4) AS area_private FROM marked WHERE part = 'test' OR typical GROUP BY 1, 2, 3, 4""",
)
def leakfree_prepare(spark, sf):
    out = clean.leakfree_prepare(split_rows(spark, sf), ["kind"], rare_min=RARE_MIN)
    return out.groupBy("part", "kind", "district", "typical").agg(
        F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price_sum"), F.round(F.sum("area_private"), 4).alias("area_private")
    )
