"""Column expressions on inline rows, including the published worked examples."""

import math
import random
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.functions import dates as D
from pricetide.functions import fuzzy as Z
from pricetide.functions import hashing as H
from pricetide.functions import numbers as N
from pricetide.functions import text as T
from pricetide.sources import html


def apply(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_fold_text(spark):
    assert apply(spark, ["  São  JOÃO\t", "Ação ß™", None, "Ñandú"], T.fold_text) == ["sao joao", "acao", "", "nandu"]


def test_canonical_kind_order(spark):
    raw = ["Casa comercial", "Prédio Comercial", "apto", "Área", "área de terra", "SALA", "Sobrado", "", "Lote rural", "duplex"]
    wide = ["Comercial", "Comercial", "Outros", "Chácara", "Chácara", "Comercial", "Casa", "", "Terreno", "Outros"]
    assert apply(spark, raw, T.canonical_kind) == wide
    narrow = apply(spark, raw, lambda c: T.canonical_kind(c, T.KIND_RULES_NARROW))
    assert narrow[4] == "Outros" and narrow[3] == "Chácara"


def test_district_alias_and_address(spark):
    assert apply(spark, ["Presidente Médice", "Centro", None], T.unify_district) == ["Presidente Medici", "Centro", None]
    raw = ["Rua A, 10 - Centro, Chapecó - SC", "Rua B - fundos, CEP 89800", "  "]
    assert apply(spark, raw, T.canonical_address) == ["rua a, 10 - centro", "rua b - fundos", ""]
    assert apply(spark, raw, lambda c: T.canonical_address(c, True)) == ["rua a", "rua b", ""]


def test_codes_and_addresses(spark):
    assert apply(spark, ["C-123", "123", None], T.source_prefix)[:2] == ["C", ""]
    df = spark.createDataFrame([("", "C-1"), (" 9 ", "C-2"), (None, None)], "code string, id string")
    assert [r[0] for r in df.select(T.listing_code(F.col("code"), F.col("id"))).collect()] == ["C-1", "9", ""]
    df = spark.createDataFrame([("Rua  X", "12", "ap 3"), ("Rua X", "x/x", "##"), ("**", "1", "2"), ("Rua Y", "-", None)], "s string, n string, c string")
    got = [r[0] for r in df.select(T.format_address(F.col("s"), F.col("n"), F.col("c"))).collect()]
    assert got == ["Rua X, 12 - ap 3", "Rua X", None, "Rua Y, -"]


def test_display(spark):
    assert apply(spark, [1234567.891], T.format_currency, "double") == ["R$ 1.234.567,89"]
    assert apply(spark, [4.96, -0.5], T.format_percent, "double") == ["+4,96%", "-0,50%"]
    assert apply(spark, ["bairro-sao-lucas"], lambda c: T.slug_title(c, "bairro-")) == ["Sao Lucas"]
    assert apply(spark, ["sao lucas", "", None], T.district_label) == ["Sao Lucas", "(sem bairro)", "(sem bairro)"]


def test_numbers(spark):
    assert apply(spark, ["2.9", "", None, "x", "1e3", "7d"], N.safe_double) == [2.9, 0.0, 0.0, 0.0, 1000.0, 0.0]
    assert apply(spark, ["2.9", "-2.9", "x"], N.safe_int) == [2, -2, 0]
    assert apply(spark, ["R$ 1.350.000,50", "sob consulta"], lambda c: N.parse_money(c, "labelled")) == [1350000.5, None]
    assert apply(spark, ["850 mil", "R$ 1,35 milhões"], lambda c: N.parse_money(c, "words")) == [850000.0, 1350000.0]
    assert apply(spark, ["R$ 1,35 milhões"], lambda c: N.parse_money(c, "words", strict=True)) == [1350.0]
    assert apply(spark, ["1.234.56 m²", "12,5", "abc"], N.parse_decimal) == [1234.56, 12.5, None]
    assert apply(spark, ["2 + 1 suíte", "+1 suíte", "suíte", "3", "1 suíte", "4 quartos", ""], N.parse_rooms) == [3, 2, 1, 3, 1, 4, None]
    assert apply(spark, [-5.0, 30.0], N.safe_expm1, "double") == [0.0, pytest.approx(math.expm1(21))]


def test_relative_difference_bounds(spark):
    df = spark.createDataFrame([(82.0, 100.0), (81.0, 100.0), (0.0, 0.0)], "l double, r double")
    got = [r[0] for r in df.select(N.relative_difference(F.col("l"), F.col("r"))).collect()]
    assert got == [pytest.approx(0.18), pytest.approx(0.19), 0.0]


def test_dates(spark):
    raw = ["2026-08-01T10:11:12.5Z", "2026-08-01 10:11:12", "03/09/2026 01:02:03", "2026-08-01", "2026-08", "x", ""]
    got = [str(v) if v else None for v in apply(spark, raw, D.parse_datetime)]
    assert got == ["2026-08-01 10:11:12.500000", "2026-08-01 10:11:12", "2026-09-03 01:02:03", "2026-08-01 00:00:00", None, None, None]
    names = ["listings_03_09_2026.db", "listings_31_02_2026.db", "x"]
    assert [str(v) if v else None for v in apply(spark, names, D.snapshot_date)] == ["2026-09-03", None, None]


def test_hashes(spark):
    assert apply(spark, [[True] * 64, [False] * 63 + [True], []], H.bits_to_hex, "array<boolean>") == ["f" * 16, "0" * 15 + "1", ""]
    df = spark.createDataFrame([("f" * 16, "0" * 16), ("8000000000000000", "0" * 16), ("", "0" * 16)], "l string, r string")
    assert [r[0] for r in df.select(H.hamming_distance(F.col("l"), F.col("r"))).collect()] == [64, 1, None]


def test_poisson_weights_have_mean_one(spark):
    mean = spark.range(20000).select(F.avg(H.poisson_weight(H.uniform(F.col("id"), F.lit("x"))))).first()[0]
    assert abs(mean - 1) < 0.03


@pytest.mark.parametrize(
    "row, expected", [((1.12, 1.27, 0.12), -0.308721), ((0.85, 0.70, 1.2), 0.513139), ((1.0, 1.0, 0.0), 0.0), ((0.7, 0.5, 3.0), 0.876667)]
)
def test_fuzzy_golden(spark, row, expected):
    df = spark.createDataFrame([row], "district_price double, area double, trend double")
    strengths = Z.rule_strengths(Z.memberships({n: F.col(n) for n in Z.INPUT_SETS}))
    assert df.select(Z.centroid(Z.term_heights(strengths))).first()[0] == pytest.approx(expected, abs=1e-6)


def test_fuzzy_degrees_and_crisp_kind(spark):
    df = spark.createDataFrame([(0.85, "Casa")], "district_price double, kind string")
    degrees = Z.memberships({"district_price": F.col("district_price")})
    row = df.select(degrees[("district_price", "cheap")], degrees[("district_price", "average")]).first()
    assert row[0] == pytest.approx(2 / 3) and row[1] == pytest.approx(1 / 3)
    rules = (({"kind": "Casa", "district_price": "cheap"}, "above"), ({"kind": "Apartamento"}, "below"))
    assert [v for v in df.select(*Z.rule_strengths(degrees, F.col("kind"), rules)).first()] == [pytest.approx(2 / 3), 0.0]


def test_absolute_url_agrees_with_the_standard_library(spark):
    bases = ["http://h.example/a/b/c?q=1#f", "https://h.example", "https://h.example/x/"]
    values = ["/p.png", "p.png", "//cdn.example/p.png", "http://o.example/p", "?z=2"]
    rows = [(b, v) for b in bases for v in values]
    df = spark.createDataFrame(rows, "b string, v string")
    got = [r[0] for r in df.select(html.absolute_url(F.col("b"), F.col("v"))).collect()]
    assert got == [urljoin(b, v) for b, v in rows]


def test_weights_of_a_digest_are_those_of_its_numbers(spark):
    df = spark.range(3000).withColumn("h", H.hash_draws(F.col("id"), F.lit("x")))
    for k in range(H.DRAWS):
        number = F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("double") / 4294967296.0
        assert df.filter(H.poisson_weight_of(F.col("h"), k) != H.poisson_weight(number)).count() == 0


def test_centroid_equals_the_sum_over_the_grid(spark):
    random.seed(3)
    terms = list(Z.OUTPUT_SETS)
    levels = [0.0, 0.25, 0.5, 0.75, 1.0, 1 / 3, 1e-9, 1 - 1e-9]
    rows = [[random.choice(levels) for _ in terms] for _ in range(1500)] + [[random.random() for _ in terms] for _ in range(1500)]
    rows += [[0.0] * len(terms), [1.0] * len(terms)]
    step = (Z.OUTPUT_HIGH - Z.OUTPUT_LOW) / (Z.OUTPUT_POINTS - 1)
    ys = np.array([Z.OUTPUT_LOW + step * i for i in range(Z.OUTPUT_POINTS)])

    def shape(a, b, c, d):
        up = np.ones_like(ys) if math.isinf(b) else (ys - a) / (b - a)
        down = np.ones_like(ys) if math.isinf(c) else (d - ys) / (d - c)
        return np.clip(np.minimum(up, down), 0, 1)

    shapes = np.array([shape(*Z.OUTPUT_SETS[t]) for t in terms])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{t} double" for t in terms))
    got = {r["i"]: r["c"] for r in df.select("i", Z.centroid({t: F.col(t) for t in terms}).alias("c")).collect()}
    some = {r["i"]: r["c"] for r in df.select("i", Z.centroid({t: F.col(t) for t in terms[1:4]}).alias("c")).collect()}
    for i, r in enumerate(rows):
        for out, heights in ((got, r), (some, [0.0, *r[1:4], 0.0])):
            profile = np.minimum(np.array(heights)[:, None], shapes).max(axis=0)
            want = (profile * ys).sum() / profile.sum() if profile.sum() > 0 else 0.0
            assert out[i] == pytest.approx(want, abs=1e-9 if profile.sum() > 1e-3 else 1e-6)
