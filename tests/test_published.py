"""Exports that readers see whole: table and CSV of one computation behind a manifest."""

import pytest
from pyspark.sql import functions as F

from pricetide.sources.files import SharedFiles
from pricetide.sources.published import publish, read_published


def rows(spark, n, price=1.5):
    district = F.when(F.col("id") % 3 > 0, F.concat(F.lit('Centro, "alto" ç'), F.col("id")))
    return spark.range(n).select("id", district.alias("district"), F.lit(price).alias("price"), F.lit(None).cast("string").alias("note"))


def collected(df):
    return sorted(map(str, df.collect()))


def test_table_and_csv_hold_the_same_rows(spark, tmp_path):
    df = rows(spark, 50).repartition(4)
    manifest = publish(df, str(tmp_path), "listings", ["id"])
    assert manifest["rows"] == 50 and min(manifest["bytes"].values()) > 0
    for form in ("table", "csv"):
        got = read_published(spark, str(tmp_path), "listings", form)
        assert got.dtypes == df.dtypes and collected(got) == collected(df)
    assert [r["id"] for r in read_published(spark, str(tmp_path), "listings").collect()] == list(range(50))


def test_both_come_from_one_computation(spark, tmp_path):
    drawn = rows(spark, 30).withColumn("price", F.rand())
    publish(drawn, str(tmp_path), "drawn")
    table, csv = (read_published(spark, str(tmp_path), "drawn", form) for form in ("table", "csv"))
    assert collected(table) == collected(csv)


def test_a_broken_export_is_not_seen(spark, tmp_path):
    publish(rows(spark, 10), str(tmp_path), "listings")
    broken = rows(spark, 10).withColumn("price", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(2.0))
    with pytest.raises(Exception, match="lost"):
        publish(broken, str(tmp_path), "listings")
    assert collected(read_published(spark, str(tmp_path), "listings")) == collected(rows(spark, 10))


def test_a_reader_keeps_its_version_and_older_ones_go(spark, tmp_path):
    publish(rows(spark, 3, 1.0), str(tmp_path), "listings")
    reader = read_published(spark, str(tmp_path), "listings")
    manifest = publish(rows(spark, 3, 2.0), str(tmp_path), "listings")
    assert [r["price"] for r in reader.collect()] == [1.0] * 3
    assert len(manifest["versions"]) == 2
    manifest = publish(rows(spark, 3, 3.0), str(tmp_path), "listings")
    folders = {p.name for p in (tmp_path / "listings").iterdir() if p.is_dir()}
    assert folders == set(manifest["versions"])
    assert [r["price"] for r in read_published(spark, str(tmp_path), "listings").collect()] == [3.0] * 3


def test_an_empty_table_is_published_too(spark, tmp_path):
    assert publish(rows(spark, 0), str(tmp_path), "none")["rows"] == 0
    assert read_published(spark, str(tmp_path), "none").columns == ["id", "district", "price", "note"]


def test_no_manifest_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_published(spark, str(tmp_path), "listings")


def test_a_file_is_replaced_whole(spark, tmp_path):
    files = SharedFiles(spark, str(tmp_path))
    for k in range(3):
        files.replace_json("sub/state.json", {"k": k})
        assert files.read_json("sub/state.json") == {"k": k}
    assert [n for n in files.names("sub") if not n.startswith(".")] == ["state.json"]
    assert files.names("nowhere") == []
