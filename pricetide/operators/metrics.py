"""Evaluation of prediction tables, all as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import STABLE_BAND, direction
from ..session import stored
from .ordered import Quantile, aggregate, attach, average_ranks, prefix_counts

Y, P = "y", "y_pred"


def _r2(y: Column, p: Column) -> Column:
    return F.try_divide(F.lit(1.0) * F.sum(F.pow(y - p, 2)), F.var_pop(y) * F.count(y))


def regression_metrics(df: DataFrame, keys: list[str] | None = None, y: str = Y, p: str = P) -> DataFrame:
    """MAE, RMSE, R2 and MAPE (rows with a zero truth do not enter the MAPE)."""
    t, e = F.col(y), F.col(y) - F.col(p)
    return df.groupBy(*(keys or [])).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1.0 - _r2(t, F.col(p))).alias("r2"),
        (100.0 * F.avg(F.when(t != 0, F.abs(e / t)))).alias("mape"),
        F.count("*").alias("n"),
    )


def percentage_error(df: DataFrame, keys: list[str] | None = None, y: str = Y, p: str = P) -> DataFrame:
    """Median absolute percentage error and the share of rows within 10 % and 20 %."""
    error = F.abs(F.col(p) - F.col(y)) / F.col(y) * 100.0
    rows = df.filter(F.col(y) != 0).withColumn("__e", error)
    within = [(100.0 * F.avg(F.when(F.col("__e") <= k, 1.0).otherwise(0.0))).alias(f"within_{k}_pct") for k in (10, 20)]
    return aggregate(rows, keys or [], [*within, F.count("*").alias("n")], [Quantile("mdape", F.col("__e"))])


def growth_metrics(df: DataFrame, keys: list[str] | None = None, y: str = Y, p: str = P, price: str = "price") -> DataFrame:
    """Errors of a log growth forecast in percentage points, direction hits and money."""
    t, f = F.col(y), F.col(p)
    points = 100.0 * F.expm1(t) - 100.0 * F.expm1(f)
    money = F.col(price) * F.expm1(t) - F.col(price) * F.expm1(f)
    return df.groupBy(*(keys or [])).agg(
        F.avg(F.abs(points)).alias("mae_pp"),
        F.sqrt(F.avg(points * points)).alias("rmse_pp"),
        F.when(F.count("*") > 1, 1.0 - _r2(t, f)).otherwise(0.0).alias("r2"),
        F.avg(F.when(direction(t) == direction(f), 1.0).otherwise(0.0)).alias("direction_accuracy"),
        F.avg(F.abs(money)).alias("mae_money"),
        F.count("*").alias("n"),
    )


def auc_brier(df: DataFrame, keys: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """Area under the ROC curve by rank sums over distinct scores, and the Brier score.

    ``keys`` may be empty. Counts per distinct score are accumulated bin by bin, so no task ever
    orders all rows.
    """
    one = F.col(label) == 1
    counts = df.groupBy(*keys, F.col(p).alias("value")).agg(
        F.count("*").alias("rows"), F.count_if(one).alias("positives")
    )
    ranked = prefix_counts(counts, keys)
    ranked = ranked.withColumn("rank", F.col("before_rows") + (F.col("rows") + 1) / 2.0)
    t, q = F.col("positives"), F.col("value")
    sums = ranked.groupBy(*keys).agg(
        F.sum(t * F.col("rank")).alias("rank_sum"),
        F.sum(t).alias("n1"),
        F.sum(F.col("rows")).alias("n"),
        F.sum(t * F.pow(1 - q, 2) + (F.col("rows") - t) * q * q).alias("squares"),
    )
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    auc = F.try_divide(F.col("rank_sum") - n1 * (n1 + 1) / 2.0, (n1 * n0).cast("double"))
    return sums.select(*keys, auc.alias("auc"), (F.col("squares") / F.col("n")).alias("brier"), "n1", "n")


def change_shares(df: DataFrame, keys: list[str] | None = None, change: str = "dlog", band: float = 1e-9) -> DataFrame:
    """Share of comparisons unchanged, risen and fallen, in percent."""
    pct = 100.0 * F.expm1(F.col(change))

    def share(test: Column) -> Column:
        return 100.0 * F.avg(F.when(test, 1.0).otherwise(0.0))

    return df.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"),
        share(F.abs(pct) < band).alias("unchanged_pct"),
        share(pct > band).alias("rose_pct"),
        share(pct < -band).alias("fell_pct"),
        F.avg(F.when(F.col(change) < -STABLE_BAND, 1.0).otherwise(0.0)).alias("cut_rate"),
    )


def signed_error(df: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    return df.withColumn("error_pct", (F.col(p) - F.col(y)) / F.col(y) * 100.0)


def error_histogram(df: DataFrame, keys: list[str] | None = None, y: str = Y, p: str = P) -> DataFrame:
    """Rows per 5-point bin of the signed error held in [-100, 100]."""
    held = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("error_pct")))
    bins = F.least(F.floor((held + 100.0) / 5.0), F.lit(40))
    rows = signed_error(df.filter(F.col(y) != 0), y, p).withColumn("bin", bins.cast("int"))
    out = rows.groupBy(*(keys or []), "bin").agg(F.count("*").alias("n"))
    return out.withColumn("bin_start", F.col("bin") * 5.0 - 100.0)


def quartile_error(df: DataFrame, keys: list[str], y: str = Y, p: str = P) -> DataFrame:
    """Errors by quartile of the true value; quartiles cut on values, ties stay together."""
    cuts = aggregate(df, keys, [], [Quantile(f"__q{i}", F.col(y), i / 4) for i in (1, 2, 3)])
    rows = attach(df, cuts, keys)
    t = F.col(y)
    band = F.when(t <= F.col("__q1"), 1).when(t <= F.col("__q2"), 2).when(t <= F.col("__q3"), 3).otherwise(4)
    rows = rows.withColumn("quartile", band).withColumn("__ae", F.abs(F.col(p) - t))
    return aggregate(
        rows,
        [*keys, "quartile"],
        [F.count("*").alias("n"), F.avg("__ae").alias("mae"), F.min(t).alias("y_min"), F.max(t).alias("y_max")],
        [Quantile("mdape", F.col("__ae") / t * 100.0)],
    )


# ---------------------------------------------------------------- leaderboards (one row per model)
def leaderboard(scores: DataFrame, keys: list[str], order: list[Column], top: int | None = None) -> DataFrame:
    """Position of each model in its segment; a leaderboard holds one row per candidate."""
    ranked = scores.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("position") <= top) if top else ranked


def published_order(mdape: str = "mdape", mae: str = "mae") -> list[Column]:
    """Smallest MdAPE to one decimal, then smallest MAE."""
    return [F.round(mdape, 1), F.col(mae)]


def choose(scores: DataFrame, keys: list[str], eligible: Column, reserve: Column, mdape: str = "mdape", mae: str = "mae") -> DataFrame:
    """Best eligible candidate and the best that also fits the reserve condition."""
    order = F.struct(F.round(mdape, 1).alias("a"), F.col(mae).alias("b"), F.col("model").alias("c"))
    pick = F.struct("model", mdape, mae)
    return scores.groupBy(*keys).agg(
        F.min_by(pick, F.when(eligible, order)).alias("chosen"),
        F.min_by(pick, F.when(eligible & reserve, order)).alias("reserve"),
    )


def gap_to_best(scores: DataFrame, keys: list[str], value: str = "mdape") -> DataFrame:
    """Distance of each candidate to the best, and its bar length capped at 1.15 x p85."""
    summary = aggregate(scores, keys, [F.min(value).alias("best")], [Quantile("p85", F.col(value), 0.85)])
    rows = attach(scores, summary, keys)
    return (
        rows.withColumn("gap", F.col(value) - F.col("best"))
        .withColumn("bar", F.least(F.col(value), F.col("p85") * 1.15))
        .drop("best", "p85")
    )


# ---------------------------------------------------------------- rank correlation
#: A column of so many distinct values is counted beside others, and its ranks are looked up.
FEW_VALUES = 1_000


def spearman(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Spearman correlation of every column pair over rows where both are known (positive).

    Pairs of columns with few values come from counts of these columns together. In a pair of one such column and one of many
    values, ranks of the former are looked up and summed by values of the latter, for all such pairs at once. Only pairs of two
    columns of many values count every (x, y).
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    found = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if found[c] <= FEW_VALUES]
    many = [c for c in columns if c not in few]
    parts = []
    if few:
        known = [(F.col(c) > 0).alias(f"__known_{c}") for c in many]
        counted = stored(rows.groupBy(*keys, *few, *known).agg(F.count("*").alias("__rows")))
        if len(few) > 1:
            parts.append(_joint_sums(counted, keys, [p for p in pairs if set(p) <= set(few)], F.col("__rows")))
        parts += [_looked_up_sums(rows, counted, keys, c, {f: p for p in pairs for f in few if set(p) == {c, f}}) for c in many]
    if len(many) > 1:
        parts.append(_joint_sums(rows, keys, [p for p in pairs if set(p) <= set(many)], F.lit(1)))
    sums = reduce(DataFrame.unionByName, parts)
    rho = F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    return sums.select(*keys, "left", "right", rho.alias("rho"), "n")


def _joint_sums(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], rows: Column) -> DataFrame:
    """Products of centred ranks: rows are counted per (pair, x, y); ranks come from the value counts of either side."""
    entries = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    long = df.select(*keys, rows.alias("rows"), F.inline(entries)).filter("x > 0 AND y > 0")
    group = [*keys, "left", "right"]
    joint = long.groupBy(*group, "x", "y").agg(F.sum("rows").alias("rows"))
    rx = average_ranks(joint.groupBy(*group, "x").agg(F.sum("rows").alias("rows")), group, "x")
    ry = average_ranks(joint.groupBy(*group, "y").agg(F.sum("rows").alias("rows")), group, "y")
    rx = rx.select(*group, "x", F.col("rank").alias("rx"), F.col("total_rows").alias("n"))
    ry = ry.select(*group, "y", F.col("rank").alias("ry"))
    both = joint.join(rx, [*group, "x"]).join(ry, [*group, "y"])
    dx, dy = F.col("rx") - (F.col("n") + 1) / 2.0, F.col("ry") - (F.col("n") + 1) / 2.0
    w = F.col("rows")
    return both.groupBy(*group).agg(
        F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"), F.max("n").alias("n")
    )


def _looked_up_sums(rows: DataFrame, counted: DataFrame, keys: list[str], column: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """The same for a column of many values with each of few; ``counted``: rows by values of these and by which others are known."""
    group = [*keys, "left", "right"]
    names = {f: [F.lit(a).alias("left"), F.lit(b).alias("right")] for f, (a, b) in pairs.items()}
    values = counted.filter(F.col(f"__known_{column}")).select(*keys, "__rows", F.inline(F.array(*[F.struct(*names[f], F.col(f).alias("y")) for f in pairs])))
    values = values.filter("y > 0").groupBy(*group, "y").agg(F.sum("__rows").alias("rows"))
    centred = F.col("rank") - (F.col("total_rows") + 1) / 2.0
    ry = stored(average_ranks(values, group, "y").select(*group, "y", "rows", centred.alias("dy")))
    yy = ry.groupBy(*group).agg(F.sum(F.col("rows") * F.col("dy") * F.col("dy")).alias("yy"))
    ranked = rows.filter(F.col(column) > 0)
    for f, (a, b) in pairs.items():
        mine = ry.filter((F.col("left") == a) & (F.col("right") == b))
        ranked = ranked.join(mine.select(*keys, F.col("y").alias(f), F.col("dy").alias(f"__dy_{f}")), [*keys, f], "left")
    sums = [F.struct(F.count(f"__dy_{f}").alias("rows"), F.sum(f"__dy_{f}").alias("dy")).alias(f"__{f}") for f in pairs]
    by_x = ranked.groupBy(*keys, F.col(column).alias("x")).agg(*sums)
    entries = F.array(*[F.struct(*names[f], F.col(f"__{f}.rows").alias("rows"), F.col(f"__{f}.dy").alias("dy")) for f in pairs])
    long = stored(by_x.select(*keys, "x", F.inline(entries)).filter("rows > 0"))
    dx = F.col("rank") - (F.col("total_rows") + 1) / 2.0
    out = average_ranks(long, group, "x").groupBy(*group).agg(
        F.sum(dx * F.col("dy")).alias("xy"), F.sum(F.col("rows") * dx * dx).alias("xx"), F.max("total_rows").alias("n")
    )
    return out.join(yy, group)
