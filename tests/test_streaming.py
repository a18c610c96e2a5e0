"""Incremental jobs end where their batch twins do, in any delivery order."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pricetide.operators.merge import price_history, upsert_latest
from pricetide.streaming import ingest

SCHEMA = "id string, price double, district string, ts timestamp, seq int"


def test_upsert_in_small_batches_equals_one_batch(spark, tmp_path):
    random.seed(4)
    rows = [(random.choice(["", "a", "b", "c", "d"]), float(i), random.choice(["x", "y"]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, price double, district string, seq int")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60)).select("id", "price", "district", "ts", "seq")
    for part in random.sample(range(6), 6):  # files arrive out of order
        df.filter(F.col("seq") % 6 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.snapshot_stream(spark, str(tmp_path / "in"), df.schema, "*.parquet", files_per_trigger=1)
    ingest.start_upsert(stream, str(tmp_path / "out"), str(tmp_path / "state"), F.struct("ts", "seq"), F.col("ts"), "P-").awaitTermination()
    got = ingest.latest_version(spark, str(tmp_path / "out"))
    want = upsert_latest(df, F.struct("ts", "seq"), F.col("ts"), "P-")
    columns = ["id", "price", "district", "inserted_at", "updated_at"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.count() == 4


def test_equal_stamps_follow_the_callers_order(spark, tmp_path):
    df = spark.createDataFrame([("a", 5.0, "x", 5), ("a", 3.0, "y", 3)], "id string, price double, district string, seq int")
    df = df.withColumn("ts", F.lit("2026-03-01").cast("timestamp"))
    for seq in (5, 3):
        df.filter(F.col("seq") == seq).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.snapshot_stream(spark, str(tmp_path / "in"), df.schema, "*.parquet", files_per_trigger=1)
    ingest.start_upsert(stream, str(tmp_path / "out"), str(tmp_path / "state"), F.struct("ts", "seq"), F.col("ts")).awaitTermination()
    assert ingest.latest_version(spark, str(tmp_path / "out")).first()["price"] == 5.0


HISTORY = "code string, id string, price double, area_total double, area_private double, source_db string, updated_at string, inserted_at string, seq int"


def test_history_keeps_old_rows_and_the_last_of_repeats(spark, tmp_path):
    random.seed(9)
    rows = [("", f"{random.choice('ab')}", float(k), 2.0, 0.0, "f", "", f"{random.choice([1999, 2010, 2026])}-03-0{random.randint(1, 3)}T08:00:00", k) for k in range(40)]
    df = spark.createDataFrame(rows, HISTORY)
    for part in random.sample(range(5), 5):
        df.filter(F.col("seq") % 5 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.snapshot_stream(spark, str(tmp_path / "in"), df.schema, "*.parquet", files_per_trigger=1)
    ingest.start_history(stream, str(tmp_path / "out"), str(tmp_path / "state"), F.col("seq")).awaitTermination()
    got = ingest.latest_version(spark, str(tmp_path / "out")).collect()
    want = price_history(df, F.col("seq")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 10


def test_a_lost_predecessor_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "x", 1)], "id string, price double, district string, seq int").withColumn("ts", F.lit("2026-03-01").cast("timestamp"))
    state, out = str(tmp_path / "state"), str(tmp_path / "out")

    def run(target):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.snapshot_stream(spark, str(tmp_path / "in"), df.schema, "*.parquet")
        ingest.start_upsert(stream, target, state, F.struct("ts", "seq"), F.col("ts")).awaitTermination()

    run(out)
    with pytest.raises(StreamingQueryException):
        run(str(tmp_path / "elsewhere"))
    run(out)
    assert ingest.latest_version(spark, out).count() == 1


# ---------------------------------------------------------------- runs, manifests, compaction
def keyed_rows(spark, lo, hi, price):
    df = spark.range(lo, hi).select(F.col("id").cast("string").alias("id"), F.lit(float(price)).alias("price"))
    return df.withColumns({"inserted_at": F.lit(price), "updated_at": F.lit(price), "order_key": F.lit(price)})


def written(target):
    """Bytes of each run's files."""
    return {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in (target / "runs").iterdir()}


def test_a_small_batch_writes_a_small_run(spark, tmp_path):
    table = ingest.RunTable(spark, str(tmp_path))
    table.fold(keyed_rows(spark, 0, 200_000, 1), 0, ["id"])
    large = max(written(tmp_path).values())
    for batch in (1, 2):
        before = set(written(tmp_path))
        table.fold(keyed_rows(spark, 500 * batch, 500 * batch + 300, batch + 1), batch, ["id"])
        assert sum(n for name, n in written(tmp_path).items() if name not in before) < large / 50
    got = table.latest().groupBy("price").count().collect()
    assert sorted(map(tuple, got)) == [(1.0, 199_400), (2.0, 300), (3.0, 300)]


def test_runs_merge_by_level_and_old_ones_go(spark, tmp_path):
    table = ingest.RunTable(spark, str(tmp_path))
    for batch in range(10):
        table.fold(keyed_rows(spark, batch, batch + 5, batch), batch, ["id"], fan=3)
        runs = table.manifest()["runs"]
        assert all(sum(r["level"] == level for r in runs) < 3 for level in range(4))
    assert [r["level"] for r in sorted(runs, key=lambda r: r["level"])] == [0, 2]
    assert table.batches() == [7, 8, 9]
    named = {r["name"] for b in table.batches() for r in table.manifest(b)["runs"]}
    assert set(written(tmp_path)) == named
    got = {r["id"]: (r["price"], r["inserted_at"], r["updated_at"]) for r in table.latest().collect()}
    assert got == {str(k): (float(min(k, 9)), max(0, k - 4), min(k, 9)) for k in range(14)}


def test_a_replayed_batch_starts_from_its_predecessor(spark, tmp_path):
    table = ingest.RunTable(spark, str(tmp_path))
    for batch in (0, 1, 1, 1):
        table.fold(keyed_rows(spark, 0, 3, batch), batch, ["id"])
    assert table.batches() == [0, 1] and len(table.manifest()["runs"]) == 2
    assert [r["price"] for r in table.latest().collect()] == [1.0] * 3


def test_readers_see_the_manifest_they_began_with(spark, tmp_path):
    """A half-written manifest is not seen, and runs stay for readers while later batches come in."""
    table = ingest.RunTable(spark, str(tmp_path))
    table.fold(keyed_rows(spark, 0, 3, 0), 0, ["id"], fan=2)
    reader = table.latest()
    (tmp_path / "manifests" / ".00000000000000000009-half").write_text("{")
    for batch in (1, 2):
        table.fold(keyed_rows(spark, 0, 3, batch), batch, ["id"], fan=2)
    assert [r["price"] for r in reader.collect()] == [0.0] * 3
    assert [r["price"] for r in table.latest().collect()] == [2.0] * 3


def test_files_grow_in_number_with_the_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FILE_BYTES", 20_000)
    table = ingest.RunTable(spark, str(tmp_path))
    for batch in (0, 1):
        table.fold(keyed_rows(spark, 20_000 * batch, 20_000 * (batch + 1), batch), batch, ["id"], fan=2)
    (run,) = table.manifest()["runs"]
    assert run["level"] == 1 and len(list((tmp_path / "runs" / run["name"]).glob("*.parquet"))) > 3
    assert table.latest().count() == 40_000


def test_no_manifest_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest.latest_version(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        ingest.RunTable(spark, str(tmp_path)).fold(keyed_rows(spark, 0, 1, 0), 3, ["id"])
