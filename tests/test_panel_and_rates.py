"""Panel, index, rates, back-cast and cleaning: worked examples and invariants."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from pricetide.operators import clean
from pricetide.operators import index as I
from pricetide.operators import panel as P
from pricetide.operators import rates as R


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for code, district, prices in [
        ("a", "x", {1: 100.0, 2: 110.0, 4: 121.0}),  # month 3 is missing
        ("b", "x", {1: 100.0, 2: 100.0, 4: 100.0, 5: 100.0}),
        ("c", "y", {1: 100.0, 2: 200.0, 5: 210.0}),  # a jump above 50 % in one month
        ("d", "y", {1: 50.0}),
    ]:
        rows += [(code, date(2026, m, 3), p, district) for m, p in prices.items()]
    history = spark.createDataFrame(rows, "code string, day date, price double, district string")
    twice = history.unionAll(history.withColumn("day", F.date_add("day", 9)))  # two observations a month
    features = history.select("code", "district").distinct().withColumns(
        {"kind": F.lit("Casa"), "area_ref": F.lit(10.0), "rooms": F.lit(1), "baths": F.lit(1), "parking": F.lit(0)}
    )
    return P.monthly_panel(twice.drop("district"), features).cache()


def test_changes_need_consecutive_months_and_pairs_do_not(panel):
    changes = {(r["code"], r["month"].month): r["dlog"] for r in P.monthly_changes(panel).collect()}
    assert set(changes) == {("a", 2), ("b", 2), ("b", 5)}
    assert changes[("a", 2)] == pytest.approx(math.log(1.1))
    pairs = {(r["code"], r["month"].month): r["gap"] for r in P.repeat_pairs(panel).collect()}
    assert pairs == {("a", 2): 1, ("a", 4): 2, ("b", 2): 1, ("b", 4): 2, ("b", 5): 1, ("c", 5): 3}


def test_index_keeps_its_level_without_data(panel):
    index = P.repeat_index(P.monthly_changes(panel), min_pairs=2)
    levels = {(r["district"], r["month"].month): r["index_level"] for r in P.cumulative_index(panel, index).collect()}
    first = math.exp((math.log(1.1) + 0) / 2) * 100
    assert levels[("x", 1)] == 100.0 and levels[("x", 2)] == pytest.approx(first)
    assert levels[("x", 4)] == pytest.approx(first)  # no consecutive pair ends in month 4
    assert levels[("y", 2)] == pytest.approx(first)  # too few pairs in y: the kind decides
    wide = P.index_table(P.cumulative_index(panel, index)).filter("district = 'x'").first()
    assert wide["2026-04"] == round(first, 2) and wide["2026-01"] == 100.0


def test_features_use_the_month_only(spark, panel):
    index = P.repeat_index(P.monthly_changes(panel), min_pairs=2)
    full = P.panel_features(panel, index)
    early = panel.filter("month_n <= 2026 * 12 + 2")
    past = P.panel_features(early, P.repeat_index(P.monthly_changes(early), min_pairs=2))
    columns = ["code", "month_n", "months_listed", "previous_change", "relative_price", "segment_momentum", "kind_momentum"]
    want = sorted(map(tuple, full.filter("month_n <= 2026 * 12 + 2").select(columns).collect()))
    assert sorted(map(tuple, past.select(columns).collect())) == want
    pairs = P.horizon_pairs(full, 2)
    assert {(r["code"], r["month"].month, r["target_month"].month) for r in pairs.collect()} == {("a", 2, 4), ("b", 2, 4)}
    parts = P.temporal_split(P.horizon_pairs(full, 1))
    bounds = {r["part"]: (r["lo"], r["hi"]) for r in parts.groupBy("part").agg(F.min("target_month").alias("lo"), F.max("target_month").alias("hi")).collect()}
    assert bounds["train"][1] < bounds["test"][0]
    last = parts.agg(F.max("target_month")).first()[0]
    with pytest.raises(Exception, match="two target months"):
        P.temporal_split(parts.drop("part").filter(F.col("target_month") == last)).collect()


def test_rates_credibility_and_bootstrap(spark):
    rows = [(f"e{i}", "d1" if i < 30 else "d2", "Casa", 0.01 * (i % 5), 3) for i in range(120)]
    sums = spark.createDataFrame(rows, "code string, district string, kind string, dlog double, gap int")
    rates = {(r["level"], r["district"]): r["monthly"] for r in R.segment_rates(sums).collect()}
    assert rates[("kind", None)] == pytest.approx(sum(r[3] for r in rows) / 360)
    got = {r["district"]: r for r in R.credibility_rates(sums, replicas=200).collect()}
    assert got["d1"]["weight"] == 0.5 and got["d2"]["weight"] == 0.75
    for r in got.values():
        assert r["monthly_low"] < r["monthly"] < r["monthly_high"]
    shuffled = R.credibility_rates(sums.orderBy(F.desc("code")), replicas=200)
    assert {r["district"]: r["monthly_low"] for r in shuffled.collect()} == {d: pytest.approx(r["monthly_low"]) for d, r in got.items()}


def test_prior_weight_and_published_projection(spark):
    base = spark.createDataFrame([(0.0, 0.0, 0.0)], "monthly double, monthly_low double, monthly_high double")
    summary = spark.createDataFrame([(5.0, 4.0, 6.0)], "mean_annual_pct double, band_low_pct double, band_high_pct double")
    assert I.prior_blend(base, summary, 5).first()["data_weight"] == pytest.approx(5 / 17)
    rows = spark.createDataFrame([(630776.0, math.log1p(0.0065) / 12, 4.96)], "value double, monthly double, ref double")
    rows = rows.withColumns({"monthly_low": F.col("monthly"), "monthly_high": F.col("monthly")})
    last = I.scenario_projection(rows, 10, "ref").filter("year = 10").first()
    assert last["central"] == pytest.approx(672838, rel=1e-3) and last["reference"] == pytest.approx(1024001, rel=1e-3)


@pytest.fixture(scope="module")
def levels(spark):
    rows = [("s", date(2016 + m // 12, m % 12 + 1, 1), 0.4) for m in range(5, 128)]
    return I.index_level(spark.createDataFrame(rows, "series string, month date, value double"), ["series"]).select("month", "index_level")


def test_backcast_and_back_again(spark, levels):
    rows = spark.createDataFrame([(1, 500000.0, date(2026, 8, 1), 2026 + 7.5 / 12, 0.5)], "entity int, price double, month date, year double, adj double")
    past = I.backcast(rows, levels, [2016, 2021])
    ratio = {r["month"].year: 500000.0 / r["price"] for r in past.collect()}
    assert ratio[2021] == pytest.approx(1.004**62) and ratio[2016] == pytest.approx(1.004**122)
    back = I.with_factor(past, levels, F.col("month"), F.lit("2026-08-01").cast("date"))
    assert all(r[0] == pytest.approx(500000.0) for r in back.select(F.col("price") * F.col("factor")).collect())
    adjusted = I.backcast(rows, levels, [2021], "adj").first()["price"]
    assert adjusted == pytest.approx(500000.0 / 1.004**62 / 1.005 ** (5 + 2 / 12))


def test_factor_clamps_to_the_series(spark, levels):
    rows = spark.createDataFrame([(date(1990, 1, 1), date(2050, 1, 1))], "a date, b date")
    assert I.with_factor(rows, levels, F.col("a"), F.col("b")).first()["factor"] == pytest.approx(1.004**122)


def test_fuzzy_adjustment_has_zero_mean_per_kind(spark):
    rows = [(i, "Casa" if i % 3 else "Apartamento", 0.7 + i / 60, 0.5 + i / 30, -3 + i / 8) for i in range(60)]
    df = spark.createDataFrame(rows, "entity int, kind string, district_price double, area double, trend double")
    means = R.fuzzy_adjustment(df).groupBy("kind").agg(F.avg("adjustment_pp").alias("m"), F.max("adjustment_pp").alias("x")).collect()
    assert all(abs(r["m"]) < 1e-12 and r["x"] > 0 for r in means)


# ---------------------------------------------------------------- cleaning
@pytest.fixture(scope="module")
def listings(spark):
    rows = [
        (i, "Casa", f"d{i % 9 if i % 50 else 99}", 1e5 + 1000 * (i % 97), 50.0 + i % 60, 0.0 if i % 4 == 0 else 45.0 + i % 60, i % 5, 1, i % 3) for i in range(600)
    ]
    return spark.createDataFrame(
        rows, "id int, kind string, district string, price double, area_total double, area_private double, rooms int, baths int, parking int"
    )


def test_rules_do_not_depend_on_the_test_rows(listings):
    split = clean.holdout_split(listings, "id").cache()
    poisoned = split.withColumn("price", F.when(F.col("part") == "test", F.col("price") * 1000).otherwise(F.col("price")))
    poisoned = poisoned.withColumn("area_total", F.when(F.col("part") == "test", 1e6).otherwise(F.col("area_total")))
    one = clean.leakfree_prepare(split, ["kind"]).filter("part = 'train'")
    two = clean.leakfree_prepare(poisoned, ["kind"]).filter("part = 'train'")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    tested = clean.leakfree_prepare(poisoned, ["kind"]).filter("part = 'test'")
    assert tested.count() == split.filter("part = 'test'").count()  # test rows are never dropped
    assert tested.filter("typical").count() == 0


def test_folds_keep_an_entity_together(spark):
    rows = spark.range(200).withColumn("year", F.explode(F.sequence(F.lit(0), F.lit(3))))
    folds = clean.group_folds(rows, "id")
    assert folds.groupBy("id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert folds.select("fold").distinct().count() == 5


def test_rare_categories_keep_unseen_ones(spark):
    train = spark.createDataFrame([("a",)] * 12 + [("b",)] * 3, "district string")
    model = clean.RareCategories().fit(train)
    new = spark.createDataFrame([("a",), ("b",), ("never seen",)], "district string")
    assert sorted(r[0] for r in model.transform(new).collect()) == ["a", "never seen", "outros"]


def test_few_values_mean_no_bounds(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(1, 8)], "price double, price_m2 double")
    fences = clean.learn_iqr(df)
    assert fences.first()["price_fence_lo"] is None
    assert clean.mark_iqr(df, fences).filter("typical").count() == 7
    assert clean.learn_clip(df, ("price",)).first()["price_lo"] is None
    null = spark.createDataFrame([(None, 1.0), (1e9, 1.0)], "price double, price_m2 double")
    wide = spark.createDataFrame([(float(i), 1.0) for i in range(1, 30)], "price double, price_m2 double")
    marked = clean.mark_iqr(null, clean.learn_iqr(wide)).orderBy("price")
    assert [r["typical"] for r in marked.collect()] == [True, False]
