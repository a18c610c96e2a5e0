"""Evaluation of prediction tables and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import panel as P
from ..session import stored
from . import bindings as B
from .q_panel import rounded
from .registry import query


@query(
    "regression_metrics",
    f"""WITH {B.PREDICTIONS} SELECT kind, round(avg(abs(y - y_pred)), 4) AS mae, round(sqrt(avg(pow(y - y_pred, 2))), 4) AS rmse, round(1 - sum(pow(y - y_pred, 2)) / (var_pop(y) * count(*)), 8) AS r2,
        round(100 * avg(abs((y - y_pred) / nullif(y, 0))), 5) AS mape, count(*) AS n FROM pred GROUP BY 1""",
)
def regression_metrics(spark, sf):
    out = M.regression_metrics(B.predictions(spark, sf), ["kind"])
    return out.select("kind", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 8).alias("r2"), F.round("mape", 5).alias("mape"), "n")


@query(
    "percentage_error",
    f"""WITH {B.PREDICTIONS}, e AS (SELECT kind, abs(y_pred - y) / y * 100 AS e FROM pred)
    SELECT kind, round(100 * avg(CASE WHEN e <= 10 THEN 1.0 ELSE 0.0 END), 6) AS within_10_pct, round(100 * avg(CASE WHEN e <= 20 THEN 1.0 ELSE 0.0 END), 6) AS within_20_pct, count(*) AS n, round(quantile_cont(e, 0.5), 6) AS mdape FROM e GROUP BY 1""",
)
def percentage_error(spark, sf):
    return rounded(M.percentage_error(B.predictions(spark, sf), ["kind"]), 6)


@query(
    "auc_brier",
    f"""WITH {B.SPLIT}, s AS (SELECT kind, CASE WHEN price > 50000 THEN 1 ELSE 0 END AS label, area / 50.0 AS p FROM split WHERE part = 'test'),
    r AS (SELECT *, rank() OVER (PARTITION BY kind ORDER BY p) + (count(*) OVER (PARTITION BY kind, p) - 1) / 2.0 AS rk FROM s)
    SELECT kind, round((sum(label * rk) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 8) AS auc, round(avg(pow(p - label, 2)), 8) AS brier,
           CAST(sum(label) AS BIGINT) AS n1, count(*) AS n FROM r GROUP BY 1""",
)
def auc_brier(spark, sf):
    rows = B.predictions(spark, sf).withColumn("label", F.when(F.col("y") > 50000, 1).otherwise(0)).withColumn("p", F.col("area") / 50.0)
    return rounded(M.auc_brier(rows, ["kind"]), 8)


@query(
    "quartile_error",
    f"""WITH {B.PREDICTIONS}, q AS (SELECT kind, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS q2, quantile_cont(y, 0.75) AS q3 FROM pred GROUP BY 1),
    b AS (SELECT p.kind, CASE WHEN y <= q1 THEN 1 WHEN y <= q2 THEN 2 WHEN y <= q3 THEN 3 ELSE 4 END AS quartile, y, abs(y_pred - y) AS ae FROM pred p JOIN q ON q.kind = p.kind)
    SELECT kind, quartile, count(*) AS n, round(avg(ae), 4) AS mae, min(y) AS y_min, max(y) AS y_max, round(quantile_cont(ae / y * 100, 0.5), 6) AS mdape FROM b GROUP BY 1, 2""",
)
def quartile_error(spark, sf):
    out = M.quartile_error(B.predictions(spark, sf), ["kind"])
    return out.withColumn("mae", F.round("mae", 4)).withColumn("mdape", F.round("mdape", 6))


@query("signed_error", f"WITH {B.PREDICTIONS} SELECT row_id, district, area, round((y_pred - y) / y * 100, 7) AS error_pct FROM pred")
def signed_error(spark, sf):
    return M.signed_error(B.predictions(spark, sf)).select("row_id", "district", "area", F.round("error_pct", 7).alias("error_pct"))


@query(
    "error_histogram",
    f"""WITH {B.PREDICTIONS}, b AS (SELECT kind, CAST(least(40, floor((greatest(-100, least(100, (y_pred - y) / y * 100)) + 100) / 5)) AS INTEGER) AS bin FROM pred)
    SELECT kind, bin, count(*) AS n, bin * 5.0::DOUBLE - 100 AS bin_start FROM b GROUP BY 1, 2""",
)
def error_histogram(spark, sf):
    return M.error_histogram(B.predictions(spark, sf), ["kind"])


# ---------------------------------------------------------------- leaderboards
CANDIDATES = B.PREDICTIONS + """,
board_rows AS (
    SELECT kind, y, 'segment' AS model, y_pred AS p FROM pred UNION ALL SELECT s.kind, s.y, 'kind', m2.v FROM pred s JOIN m2 ON m2.kind = s.kind
    UNION ALL SELECT kind, y, 'overall', (SELECT v FROM m3) FROM pred UNION ALL SELECT kind, y, 'constant', 50000.0 FROM pred UNION ALL SELECT kind, y, 'quantity', 2100.0 * area FROM pred),
board AS (
    SELECT kind, model, avg(abs(y - p)) AS mae, sqrt(avg(pow(y - p, 2))) AS rmse, quantile_cont(abs(p - y) / y * 100, 0.5) AS mdape FROM board_rows GROUP BY 1, 2)"""


def candidate_rows(spark, sf):
    """Hold-out rows once per naive candidate."""
    row = F.concat_ws("-", *[B.text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    from ..operators.clean import holdout_split

    split = holdout_split(B.observations(spark, sf).withColumn("row_id", row), "row_id")
    train, test = split.filter("part = 'train'"), split.filter("part = 'test'")
    means = stored(P.segment_means(train, "price"))
    test = P.with_fallback(test, means, "mean_value", "__s", [("segment", P.SEGMENT), ("kind", ["kind"]), ("overall", [])])
    test = P.with_fallback(test, means, "mean_value", "__k", [("kind", ["kind"])])
    test = P.with_fallback(test, means, "mean_value", "__o", [("overall", [])])
    options = {"segment": F.col("__s"), "kind": F.col("__k"), "overall": F.col("__o"), "constant": F.lit(50000.0), "quantity": 2100.0 * F.col("area")}
    entries = F.array(*[F.struct(F.lit(n).alias("model"), c.cast("double").alias("y_pred")) for n, c in options.items()])
    return test.select("kind", F.col("price").alias("y"), F.inline(entries))


def board(spark, sf):
    rows = stored(candidate_rows(spark, sf))
    by = ["kind", "model"]
    errors = M.percentage_error(rows, by).select(*by, "mdape")
    return stored(M.regression_metrics(rows, by).select(*by, "mae", "rmse").join(errors, by))


@query(
    "leaderboard_topk",
    f"WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY mae, rmse) AS position FROM board) SELECT kind, model, CAST(position AS INTEGER) AS position, round(mae, 4) AS mae FROM r WHERE position <= 3",
)
def leaderboard_topk(spark, sf):
    out = M.leaderboard(board(spark, sf), ["kind"], [F.col("mae"), F.col("rmse")], 3)
    return out.select("kind", "model", "position", F.round("mae", 4).alias("mae"))


@query(
    "leaderboard_tiebreak",
    f"WITH {CANDIDATES} SELECT kind, model, CAST(row_number() OVER (PARTITION BY kind ORDER BY round(mdape, 1), mae) AS INTEGER) AS position, round(mdape, 6) AS mdape FROM board",
)
def leaderboard_tiebreak(spark, sf):
    out = M.leaderboard(board(spark, sf), ["kind"], M.published_order())
    return out.select("kind", "model", "position", F.round("mdape", 6).alias("mdape"))


@query(
    "argmin_filtered",
    f"""WITH {CANDIDATES} SELECT kind, arg_min(model, (round(mdape, 1), mae, model)) FILTER (model <> 'quantity') AS chosen, arg_min(model, (round(mdape, 1), mae, model)) FILTER (model NOT IN ('quantity', 'segment')) AS reserve FROM board GROUP BY 1""",
)
def argmin_filtered(spark, sf):
    """Best eligible model and the best that may stand in for it."""
    out = M.choose(board(spark, sf), ["kind"], F.col("model") != "quantity", F.col("model") != "segment")
    return out.select("kind", F.col("chosen.model").alias("chosen"), F.col("reserve.model").alias("reserve"))


@query(
    "gap_to_best",
    f"""WITH {CANDIDATES}, s AS (SELECT kind, min(mdape) AS best, quantile_cont(mdape, 0.85) AS p85 FROM board GROUP BY 1)
    SELECT b.kind, model, round(mdape - best, 6) AS gap, round(least(mdape, 1.15 * p85), 6) AS bar FROM board b JOIN s ON s.kind = b.kind""",
)
def gap_to_best(spark, sf):
    return rounded(M.gap_to_best(board(spark, sf), ["kind"]).select("kind", "model", "gap", "bar"), 6)
