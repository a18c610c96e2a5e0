"""Order statistics by prefix sums equal those of a sorted list, whatever the skew."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricetide.operators import ordered
from pricetide.operators.metrics import auc_brier, spearman
from pricetide.operators.ordered import FINE_BITS, Quantile, aggregate, average_ranks, fine_bin
from pricetide.operators.rates import positional_sample


@pytest.fixture(scope="module")
def skewed():
    random.seed(7)
    rows = [("hot", round(random.lognormvariate(12, 1), 2)) for _ in range(3000)]
    rows += [("ties", float(random.choice([1, 1, 1, 2, 5]))) for _ in range(500)]
    rows += [("signed", random.uniform(-3, 3)) for _ in range(401)]
    rows += [("zero", 0.0)] * 7 + [("one", 4.5)] + [(None, float(i)) for i in range(10)] + [("empty", None)] * 3
    return rows


def test_quantiles_equal_numpy(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, v double")
    shares = (0.02, 0.25, 0.5, 0.9, 0.98)
    quantiles = [Quantile(f"q{int(100 * p)}", F.col("v"), p) for p in shares]
    quantiles.append(Quantile("half", F.when(F.col("v") > 0, F.col("v") / 2)))
    got = {r["k"]: r for r in aggregate(df, ["k"], [F.count("*").alias("n")], quantiles).collect()}
    frame = pd.DataFrame(skewed, columns=["k", "v"]).astype({"v": float})
    for k, r in got.items():
        v = frame[frame.k.isna() if k is None else frame.k == k].v
        assert r["n"] == len(v)
        v = v.dropna()
        for p in shares:
            assert r[f"q{int(100 * p)}"] == (pytest.approx(np.quantile(v, p)) if len(v) else None)
        half = v[v > 0] / 2
        assert r["half"] == (pytest.approx(np.quantile(half, 0.5)) if len(half) else None)


def test_quantiles_and_ranks_of_nan_and_infinities(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, nan, nan, nan)] + [("b", v) for v in (-inf, -inf, 0.0, inf)] + [(None, v) for v in (5.0, inf)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in aggregate(df, ["k"], [], [Quantile("lo", F.col("v"), 0.25), Quantile("mid", F.col("v"), 0.5), Quantile("hi", F.col("v"), 0.75)]).collect()}
    assert got["a"]["lo"] == 2.5 and got["a"]["mid"] == 4.0 and np.isnan(got["a"]["hi"])
    assert got["b"]["lo"] == -inf and got["b"]["mid"] == -inf and got["b"]["hi"] == inf
    assert got[None]["hi"] == inf
    counts = df.groupBy("k", "v").agg(F.count("*").alias("rows"))
    ranks = {(r["k"], str(r["v"])): r["rank"] for r in average_ranks(counts, ["k"], "v").collect()}
    assert ranks["a", "nan"] == 6.0 and ranks["b", "-inf"] == 1.5 and ranks["b", "inf"] == 4.0


def test_densely_packed_values(spark):
    """Values inside one coarse bin are told apart by fine bins."""
    values = [300_000 + k / 100 for k in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    fine = df.select(fine_bin(F.col("v")).alias("f"), F.shiftright(fine_bin(F.col("v")), FINE_BITS).alias("c"))
    assert fine.select("c").distinct().count() <= 2 and fine.select("f").distinct().count() > 200
    assert aggregate(df, [], [], [Quantile("m", F.col("v"), 0.3)]).first()["m"] == pytest.approx(np.quantile(values, 0.3))


def test_quantiles_without_groups(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, v double")
    got = aggregate(df, [], [F.count("*").alias("n")], [Quantile("m", F.col("v"))]).first()
    values = [v for _, v in skewed if v is not None]
    assert got["n"] == len(skewed) and got["m"] == pytest.approx(float(np.median(values)))


def test_average_ranks(spark, skewed):
    values = [(k or "none", v) for k, v in skewed if v is not None]
    counts = spark.createDataFrame(values, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("rows"))
    got = {(r["k"], r["v"]): r["rank"] for r in average_ranks(counts, ["k"], "v").collect()}
    frame = pd.DataFrame(values, columns=["k", "v"])
    frame["rank"] = frame.groupby("k")["v"].rank()
    assert got == {(r.k, r.v): pytest.approx(r.rank) for r in frame.drop_duplicates().itertuples()}


def test_spearman_and_auc(spark):
    random.seed(1)
    rows = [(i % 2, float(random.randint(0, 9)), float(random.randint(0, 30)), int(random.random() < 0.4)) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, x double, y double, label int")
    frame = pd.DataFrame(rows, columns=["g", "x", "y", "label"])
    for r in spearman(df, ["g"], ["x", "y"]).collect():
        part = frame[(frame.g == r["g"]) & (frame.x > 0) & (frame.y > 0)]
        assert r["rho"] == pytest.approx(part.x.rank().corr(part.y.rank()))
    got = auc_brier(df.withColumn("p", F.col("y") / 30), [], "label", "p").first()
    pos, neg = frame[frame.label == 1].y, frame[frame.label == 0].y
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert got["auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    assert got["brier"] == pytest.approx(((frame.y / 30 - frame.label) ** 2).mean())


def test_positional_sample(spark):
    random.seed(3)
    rows = [("a", i, random.choice([0.0, 0.0, 0.0, 1.5, -2.0, 1.5001])) for i in range(200)] + [("b", 5, 1.0), ("b", 3, 1.0)]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    got = {(r["k"], r["position"]): r["id"] for r in positional_sample(df, ["k"], "v", "id").collect()}
    want = {}
    for k in ("a", "b"):
        ordered = sorted((v, i) for kk, i, v in rows if kk == k)
        n = len(ordered)
        for p in {0, n // 3, 2 * n // 3, n - 1}:
            want[(k, p)] = ordered[p][1]
    assert got == want


def test_keys_may_be_called_anything(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("b", 2, 7.0)], "rows string, value int, metric double")
    got = aggregate(df, ["rows", "value"], [], [Quantile("m", F.col("metric"))]).collect()
    assert {(r["rows"], r["value"], r["m"]) for r in got} == {("a", 1, 3.0), ("b", 2, 7.0)}


@pytest.mark.parametrize("held", [0, 3, 450, 10**6])
def test_both_routes_give_the_same_quantiles(spark, skewed, monkeypatch, held):
    nan, inf = float("nan"), float("inf")
    extra = [("nan", v) for v in (1.0, 2.0, nan, nan, inf, -inf)] + [("ends", v) for v in (-inf, -inf, 0.0, -0.0, inf)]
    df = spark.createDataFrame(skewed + extra, "k string, v double")
    quantiles = [Quantile(f"q{int(100 * p)}", v, p) for v in (F.col("v"),) for p in (0.0, 0.1, 0.5, 0.9, 1.0)]
    quantiles.append(Quantile("half", F.when(F.col("v") > 0, F.col("v") / 2), 0.25))
    columns = [F.round(q.name, 9).alias(q.name) for q in quantiles]
    monkeypatch.setattr(ordered, "BUFFER_VALUES", 10**6)
    want = sorted(map(str, aggregate(df, ["k"], [F.count("*").alias("n")], quantiles).select("k", "n", *columns).collect()))
    monkeypatch.setattr(ordered, "BUFFER_VALUES", held)
    got = sorted(map(str, aggregate(df, ["k"], [F.count("*").alias("n")], quantiles).select("k", "n", *columns).collect()))
    assert got == want
    assert aggregate(df, [], [], quantiles[:2]).collect() and aggregate(df.limit(0), ["k"], [], quantiles).collect() == []


def test_small_groups_need_no_written_counts(spark, monkeypatch):
    """a panel's medians took six shuffles and a written table; groups of few rows take one."""
    monkeypatch.setattr(ordered, "stored", lambda df: pytest.fail("counts were written"))
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", -0.0), ("a", 0.0), ("b", None)], "k string, v double")
    got = aggregate(df, ["k"], [F.count("*").alias("n")], [Quantile("m", F.col("v"))]).collect()
    assert {(r["k"], r["n"], str(r["m"])) for r in got} == {(None, 2, "2.5"), ("a", 2, "0.0"), ("b", 1, "None")}
