"""Snapshots, stored responses, pages, series and files."""

import json

from pyspark.sql import functions as F

from pricetide.operators.index import first_per_month
from pricetide.operators.merge import merge_by_code, price_history
from pricetide.sources import html, records, series, snapshots, tables

RAW = "id string, preco double, bairro string, cidade string, tipo_imovel string, area_total double, area_privada double, quartos int, banheiros int, vagas int, data_insercao string"


def write_snapshots(spark, folder):
    old = spark.createDataFrame(
        [("C-1", 100.0, "Centro", "Chapecó", "Casa", 50.0, 0.0, 2, 1, 0, "2026-03-01T10:00:00"), ("C-2", 0.0, "", "", "", 0.0, 0.0, 0, 0, 0, "")], RAW
    )
    new = spark.createDataFrame(
        [("C-1", 120.0, "", "Chapecó", "", 0.0, 0.0, 3, 0, 1, "2026-04-01T10:00:00"), ("P-1", 90.0, "Presidente Medice", "Chapecó", "Apto", 0.0, 30.0, 1, 1, 1, "2026-04-02T10:00:00")],
        RAW,
    ).withColumn("endereco", F.lit("Rua A"))
    old.coalesce(1).write.parquet(f"{folder}/listings_01_03_2026")
    new.coalesce(1).write.parquet(f"{folder}/listings_01_04_2026")
    return snapshots.read_snapshots(spark, folder, "*.parquet")


def test_snapshots_drift_merge_and_history(spark, tmp_path):
    rows = write_snapshots(spark, str(tmp_path / "snap"))
    assert {str(r[0]) for r in rows.select("snapshot_date").distinct().collect()} == {"2026-03-01", "2026-04-01"}
    assert rows.filter("address IS NULL").count() == 2
    merged = {r["code"]: r for r in merge_by_code(rows)[0].collect()}
    assert set(merged) == {"C-1", "P-1"}  # equal numbers under different prefixes stay apart
    c1 = merged["C-1"]
    # newest filled value of each field, first insert date
    assert (c1["price"], c1["district"], c1["kind"], c1["area_total"], c1["rooms"], c1["parking"]) == (120.0, "Centro", "Casa", 50.0, 3, 1)
    assert str(c1["inserted_at"]) == "2026-03-01 10:00:00" and c1["source_count"] == 2 and c1["price_m2"] == 2.4
    assert merged["P-1"]["district"] == "Presidente Medici"
    history = price_history(rows, F.col("inserted_at"))
    assert sorted((r["code"], str(r["day"]), r["price"]) for r in history.collect()) == [
        ("C-1", "2026-03-01", 100.0), ("C-1", "2026-04-01", 120.0), ("P-1", "2026-04-01", 90.0)
    ]


def test_training_frame_coerces(spark):
    df = spark.createDataFrame(
        [("Centro ", "Casas", 10.0, "x", "5", None, "", "1"), ("a", "b", None, "1", "1", "1", "1", "1"), ("a", "b", 5.0, "0", None, "1", "1", "1")],
        "district string, kind string, price double, area_total string, area_private string, rooms string, baths string, parking string",
    )
    rows = snapshots.training_frame(df).collect()
    assert [(r["district"], r["kind"], r["area_total"], r["area_private"], r["rooms"]) for r in rows] == [("centro", "Casa", 0.0, 5.0, 0.0)]


def test_attribute_list_with_fallbacks(spark):
    def page(attributes, **extra):
        return (json.dumps({"success": True, "result": [{"id": 7, "configVenda": {"valor": "6000000"}, "caracteristicas": attributes, **extra}]}),)

    def a(key, value, **extra):
        return {"idCaracteristica": key, "valor": value, **extra}

    rows = [
        page([a(89, "4 + 1 suíte"), a(84, "6"), a(104, "4"), a(109, "0"), a(107, "600"), a(124, "")], bairro="X"),
        page([a(103, "+1 suite"), a(124, "468,5"), a(123, "300")]),
        ('{"success": true, "result": []}',),
    ]
    df = spark.createDataFrame(rows, "body string")
    got = records.detail_records(df, ids=records.ATTRIBUTE_IDS["agency_p"]).collect()
    assert len(got) == 2
    first, second = got
    assert (first["price"], first["rooms"], first["baths"], first["parking"], first["area_total"], first["area_private"]) == (6e6, 5, 6, 4, 600.0, 600.0)
    assert first["price_m2"] == 10000.0
    assert (second["rooms"], second["area_total"], second["area_private"]) == (2, 300.0, 300.0)


def test_ignored_kinds(spark):
    df = spark.createDataFrame([("Barracão",), ("SALA ",), ("Casa",), (None,)], "kind string")
    assert [r[0] for r in records.drop_ignored(df).collect()] == ["Casa", None]


def test_pages(spark):
    body = (
        '<div class="carac"><p class="carac__title">Área  Total</p><p class="carac__value">1.200,5</p></div>'
        '<div class="carac"><p class="carac__title">Vagas</p><p class="carac__value">1</p></div>'
        '<div class="carac"><p class="carac__title">vagas</p><p class="carac__value">3 cobertas</p></div>'
        '<a href="imovel.php?id=5">a</a><a href="imovel.php?id=9">b</a><a href="imovel.php?id=5&x=1">c</a><a href="/x">d</a>'
    )
    df = spark.createDataFrame([(1, "http://h.example/l", body)], "page_id int, url string, html string")
    row = html.slug_records(df).first()
    assert (row["area_total"], row["area_private"], row["parking"]) == (1200.5, 1200.5, 3)
    links = {r["link_id"]: (r["position"], r["occurrences"]) for r in html.links(df, identifier=r"id=(\d+)").collect()}
    assert links == {"5": (0, 2), "9": (1, 1)}
    texts = html.tag_texts(spark.createDataFrame([(1, "<p>a <b>b</b></p><p>c &amp; d</p>")], "page_id int, html string"), ("p",))
    assert [r["text"] for r in texts.orderBy("position").collect()] == ["a b", "c & d"]


def test_series_first_value_of_a_month(spark, tmp_path):
    points = [{"data": "01/01/2020", "valor": 1.5}, {"data": "15/01/2020", "valor": 9.0}, {"data": "01/02/2020", "valor": -0.5}]
    (tmp_path / "prices.json").write_text(json.dumps(points, indent=1))
    (tmp_path / "bundle.json").write_text(json.dumps({"incc": points[:1], "ipca": points}))
    got = series.read_series(spark, str(tmp_path / "prices.json"))
    assert sorted((r["series"], str(r["month"]), r["value"]) for r in got.collect()) == [("prices", "2020-01-01", 1.5), ("prices", "2020-02-01", -0.5)]
    bundle = series.read_series_bundle(spark, str(tmp_path / "bundle.json"))
    assert {(r["series"], r["value"]) for r in bundle.collect()} == {("incc", 1.5), ("ipca", 1.5), ("ipca", -0.5)}
    assert first_per_month(series.parse_series(spark.createDataFrame([("a", "[]")], "series string, body string")), ["series"]).count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "NA", None), (2, None, 2.5)], "a int, b string, c double")
    tables.write_csv(df, str(tmp_path / "csv"), ["a"])
    back = tables.read_csv(spark, str(tmp_path / "csv"), "a int, b string, c double")
    assert sorted(map(tuple, back.collect())) == [(1, "NA", None), (2, None, 2.5)]
    lists = spark.createDataFrame([("Casa", ["a", "b"])], "kind string, districts array<string>")
    tables.write_district_lists(lists, str(tmp_path / "lists"))
    assert json.loads(spark.read.text(str(tmp_path / "lists")).first()[0]) == {"Casa": ["a", "b"]}
