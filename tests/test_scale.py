"""Steps whose cost must not grow faster than their input."""

from pyspark.sql import functions as F

from pricetide import session
from pricetide.operators import rates
from pricetide.plans import q_models, q_panel, q_rates, q_streams


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merge_counts_ids_apart_from_the_picks(spark, sf):
    """a distinct count beside the picks sent their buffers through two more shuffles."""
    lines = optimized(q_panel.merge_by_code(spark, sf)).splitlines()
    assert any("max_by" in line for line in lines)
    assert not any("max_by" in line and "count(distinct" in line for line in lines)


def test_fuzzy_inputs_are_dealt_out_by_their_own_size(spark, sf, monkeypatch):
    """the line items' size, not that of the inputs, decided, and large ones were left to few tasks."""
    monkeypatch.setattr(session, "SPREAD_ROWS", 5000)
    assert q_rates.inputs(spark, sf).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_a_bootstrap_row_is_not_repeated_for_its_blocks(spark):
    """250 rows with a digest in text for each code."""
    rows = [("a", "d", "k", 0.5, 2), ("b", "d", "k", -0.25, 1), (None, None, "k", 1.0, 3)]
    sums = spark.createDataFrame(rows, "code string, district string, kind string, dlog double, gap bigint")
    boot = rates.bootstrap_sums(sums, 6)
    assert "sequence" not in optimized(boot) and dict(boot.dtypes)["g"] == "bigint"
    assert boot.count() == 12
    from pricetide.functions.hashing import hash_draws, poisson_weight_of

    for replica, d, g in boot.filter("district = 'd'").select("replica", "d", "g").collect():
        block, place = divmod(replica - 1, 4)
        weights = {r[0]: r[1] for r in sums.filter("district = 'd'").select("code", poisson_weight_of(hash_draws(F.col("code"), F.lit(block), F.lit("42")), place)).collect()}
        assert abs(d - (0.5 * weights["a"] - 0.25 * weights["b"])) < 1e-12 and g == 2 * weights["a"] + weights["b"]


def test_a_delivery_has_files_by_its_rows(spark, tmp_path, monkeypatch):
    """a delivery was one file, written by one task that read a sixth of all rows."""
    monkeypatch.setattr(q_streams, "FILE_ROWS", 10, raising=False)
    rows = spark.range(600)
    files = q_streams._deliver(rows, rows, str(tmp_path / "in"), "id")
    assert files == 10
    found = spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert found[0] < 100 and found[1] > 600


def test_rank_correlations_do_not_repeat_every_row_for_every_pair(spark, monkeypatch):
    """each row was exploded into all its pairs and counted by both values."""
    from pricetide.operators import metrics

    rows = spark.range(300).select(
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("g"), F.col("id") % 2)).alias("g"),
        (F.col("id") * 37 % 101 + 0.5).alias("x"), (F.col("id") % 7).alias("y"), (F.col("id") * 11 % 5).alias("z"),
    )
    monkeypatch.setattr(metrics, "FEW_VALUES", 10, raising=False)
    found = metrics.spearman(rows, ["g"], ["y", "x", "z"])
    assert "Range" not in optimized(found)
    got = {(r["g"], r["left"], r["right"]): (r["rho"], r["n"]) for r in found.collect()}
    want, table = {}, rows.toPandas()
    for g, mine in table.groupby("g"):
        for a, b in (("y", "x"), ("y", "z"), ("x", "z")):
            both = mine[(mine[a] > 0) & (mine[b] > 0)]
            want[g, a, b] = (both[a].rank().corr(both[b].rank()), len(both))
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def small_tables(spark, folder):
    """Parts 1 to 3 and one without a number, and their line items; part 3 was never sold, part 9 isn't known."""
    parts = [(1, "B1", "T1", 4), (2, None, "T2", 7), (3, "B1", "T1", 9), (None, "B2", "T2", 1)]
    lines = [
        (1, 1, 5, 1, 2.0, 10.0, "1995-01-03"), (2, 1, 5, 2, 3.0, 30.0, "1995-02-07"), (3, 1, 5, 3, 4.0, 20.0, "1995-01-30"),
        (4, 2, 6, 1, 5.0, 50.0, "1996-03-04"), (5, 9, 6, 1, 1.0, 1.0, "1996-03-04"), (6, None, 6, 1, 1.0, 1.0, "1996-03-04"),
    ]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate string"
    rows = spark.createDataFrame(lines, schema).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    rows.write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_listings_do_not_pass_through_the_driver(spark, tmp_path):
    """every reading of the listings broadcast all parts."""
    found = q_models.listings(spark, small_tables(spark, str(tmp_path)))
    rows = {r["entity"]: r for r in found.collect()}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows.keys() == {1, 2}
    assert (rows[1]["price"], rows[1]["area_total"], rows[1]["baths"], rows[1]["rooms"], str(rows[1]["month"])) == (30.0, 3.0, 2, 5, "1995-02-01")
    assert (rows[2]["district"], rows[2]["kind"], rows[2]["price"]) == (None, "T2", 50.0)


def test_rules_are_learned_from_written_listings(spark, tmp_path, monkeypatch):
    """each rule and both parts joined line items and parts anew."""
    given = []
    monkeypatch.setattr(q_models.clean, "leakfree_prepare", lambda rows, by: given.append(rows) or rows)
    assert q_models.prepared(spark, small_tables(spark, str(tmp_path))).count() == 2
    assert not any("lineitem" in f or "part.parquet" in f for f in given[0].inputFiles())


def test_a_variant_joins_its_district_medians_once(spark):
    """a fit reads its rows several times, and each time the medians were learned and broadcast again."""
    from pricetide.operators import models

    cities = spark.range(40).select(
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("d"), F.col("id") % 4)).alias("district"), (F.col("id") + 1.0).alias("price"),
        F.lit(0.0).alias("area_private"), F.lit(2.0).alias("area_total"), F.lit("k").alias("kind"),
    )
    train, test, target, numeric = models.variant_frames(cities, cities.limit(4), "district+m2")
    assert target == "per_area" and numeric[-1] == "district_m2"
    for frame in (train, test):
        plan = optimized(frame)
        assert "Join" not in plan and "Aggregate" not in plan
    assert {r["district"]: r["district_m2"] for r in test.collect()} == {None: 9.5, "d1": 10.0, "d2": 10.5, "d3": 11.0}
