"""Listing records out of stored API responses (nested JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import backfill, parse_comma_float, parse_money, parse_plain, parse_rooms, price_per_area
from ..functions.text import fold_label, format_address
from .html import absolute_url

DETAIL_SCHEMA = """
    success BOOLEAN,
    result ARRAY<STRUCT<
        id: BIGINT, codigo: STRING, bairro: STRING, cidade: STRING, endereco: STRING, numero: STRING,
        complemento: STRING, dataPublicacao: STRING,
        categoria: STRUCT<descricao: STRING>, configVenda: STRUCT<valor: STRING>,
        imagens: ARRAY<STRUCT<url: STRING, urlCDN: STRING, url_original: STRING, url_small: STRING>>,
        caracteristicas: ARRAY<STRUCT<
            idCaracteristica: INT, descricao: STRING, valor: STRING, valorFormatado: STRING, valorText: STRING>>>>
"""

# Attribute ids of the two agencies that publish attribute lists.
ATTRIBUTE_IDS = {
    "agency_m": {"rooms": (3,), "rooms_fallback": (5,), "baths": (6,), "parking": (4, 15), "area_private": 9, "area_total": (27,)},
    "agency_p": {"rooms": (89,), "rooms_fallback": (103,), "baths": (84,), "parking": (104,), "area_private": 124, "area_total": (109, 107, 123, 106)},
}


def filled(col: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(col, F.lit(""))


def attribute_number(attributes: Column, key: int) -> Column:
    """Number of the first attribute with this id; empty, "0" and unusable text are null."""
    first = F.get(F.filter(attributes, lambda a: a["idCaracteristica"] == key), F.lit(0))["valor"]
    return F.when(first != "0", parse_plain(first))


def attribute_text(attributes: Column, keys: tuple[int, ...]) -> Column:
    """First filled representation of the first attribute with one of these ids."""
    a = F.get(F.filter(attributes, lambda a: a["idCaracteristica"].isin(*keys)), F.lit(0))
    return F.coalesce(*[filled(a[name]) for name in ("valor", "valorFormatado", "valorText", "descricao")])


def _with_areas(df: DataFrame) -> DataFrame:
    """Copy the known area to the missing one and derive the price per area."""
    total, private = F.col("area_total"), F.col("area_private")
    df = df.withColumns({"area_total": backfill(total, private), "area_private": backfill(private, total)})
    return df.withColumn("price_m2", price_per_area(F.col("price"), F.col("area_private"), F.col("area_total")))


def detail_records(pages: DataFrame, body: str = "body", ids: dict = ATTRIBUTE_IDS["agency_m"], base_url: str = "") -> DataFrame:
    """One listing per response with an attribute list (entity-attribute-value)."""
    # Exploding the first result parses each body once and drops empty answers.
    results = F.from_json(F.col(body), DETAIL_SCHEMA)["result"]
    parsed = pages.select(F.explode(F.slice(results, 1, 1)).alias("__r"))
    r, attrs = F.col("__r"), F.col("__r.caracteristicas")
    image = F.get(r["imagens"], F.lit(0))
    raw_image = F.coalesce(*[filled(image[c]) for c in ("urlCDN", "url", "url_original", "url_small")])
    rooms = F.coalesce(attribute_text(attrs, ids["rooms"]), attribute_text(attrs, ids["rooms_fallback"]))
    total = F.coalesce(*[F.nullif(attribute_number(attrs, key), F.lit(0.0)) for key in ids["area_total"]])
    out = parsed.select(
        r["id"].cast("string").alias("id"),
        parse_plain(r["configVenda"]["valor"]).alias("price"),
        r["bairro"].alias("district"),
        format_address(r["endereco"], r["numero"], r["complemento"]).alias("address"),
        absolute_url(F.lit(base_url), raw_image).alias("image_url"),
        r["cidade"].alias("city"),
        r["categoria"]["descricao"].alias("kind"),
        total.alias("area_total"),
        attribute_number(attrs, ids["area_private"]).alias("area_private"),
        F.nullif(parse_rooms(rooms, "su"), F.lit(0)).alias("rooms"),
        F.nullif(attribute_text(attrs, ids["baths"]).try_cast("int"), F.lit(0)).alias("baths"),
        F.nullif(attribute_text(attrs, ids["parking"]).try_cast("int"), F.lit(0)).alias("parking"),
        r["dataPublicacao"].alias("registered_at"),
    )
    return _with_areas(out)


HIT_SCHEMA = """
    id STRING, price_sale DOUBLE, private_area DOUBLE, total_area DOUBLE, address_district STRING,
    address_street STRING, address_number STRING, address_complement STRING, address_city STRING,
    type STRING, qtd_bedrooms INT, qtd_bathrooms INT, qtd_parking_lots INT, date_registration STRING,
    cover_original_url STRING, cover_small_url STRING,
    images ARRAY<STRUCT<url_original: STRING, url_small: STRING>>
"""


def hit_records(hits: DataFrame, body: str = "body") -> DataFrame:
    """Flat search hits; the cover image falls back to the first gallery image."""
    p = F.from_json(F.col(body), HIT_SCHEMA)
    parsed = hits.withColumn("__p", p)
    r = F.col("__p")
    first = F.get(r["images"], F.lit(0))
    names = [r["cover_original_url"], r["cover_small_url"], first["url_original"], first["url_small"]]
    out = parsed.select(
        F.coalesce(r["id"], F.lit("")).alias("id"),
        r["price_sale"].alias("price"),
        r["address_district"].alias("district"),
        format_address(r["address_street"], r["address_number"], r["address_complement"]).alias("address"),
        F.coalesce(*[filled(n) for n in names]).alias("image_url"),
        r["address_city"].alias("city"),
        r["type"].alias("kind"),
        r["total_area"].alias("area_total"),
        r["private_area"].alias("area_private"),
        r["qtd_bedrooms"].alias("rooms"),
        r["qtd_bathrooms"].alias("baths"),
        r["qtd_parking_lots"].alias("parking"),
        r["date_registration"].alias("registered_at"),
    )
    return _with_areas(out)


CARD_SCHEMA = """
    codigo STRING, valor STRING, areainterna STRING, areaprincipal STRING, arealote STRING, bairro STRING,
    endereco STRING, numero STRING, complemento STRING, cidade STRING, tipo STRING, numeroquartos STRING,
    numerobanhos STRING, numerovagas STRING, datahoracadastro STRING, urlfotoprincipalp STRING,
    fotos ARRAY<STRUCT<urlp: STRING>>
"""


def card_records(cards: DataFrame, body: str = "body") -> DataFrame:
    """Flat cards with text numbers; the lot area stands in for a missing main area."""
    parsed = cards.withColumn("__p", F.from_json(F.col(body), CARD_SCHEMA))
    r = F.col("__p")
    main = F.nullif(parse_comma_float(r["areaprincipal"]), F.lit(0.0))
    counts = {"rooms": "numeroquartos", "baths": "numerobanhos", "parking": "numerovagas"}
    out = parsed.select(
        F.coalesce(r["codigo"], F.lit("")).alias("id"),
        parse_money(r["valor"], "digits").alias("price"),
        r["bairro"].alias("district"),
        format_address(r["endereco"], r["numero"], r["complemento"]).alias("address"),
        F.coalesce(filled(r["urlfotoprincipalp"]), F.get(r["fotos"], F.lit(0))["urlp"]).alias("image_url"),
        r["cidade"].alias("city"),
        r["tipo"].alias("kind"),
        F.coalesce(main, parse_comma_float(r["arealote"])).alias("area_total"),
        parse_comma_float(r["areainterna"]).alias("area_private"),
        *[F.nullif(r[name].try_cast("int"), F.lit(0)).alias(out) for out, name in counts.items()],
        r["datahoracadastro"].alias("registered_at"),
    )
    return _with_areas(out)


# Kinds that are not collected.
IGNORED_KINDS = ("barracao", "barraco", "sala comercial", "sala/conjunto", "sala-comercial", "sala")


def drop_ignored(df: DataFrame, kind: str = "kind", ignored: tuple[str, ...] = IGNORED_KINDS) -> DataFrame:
    """Remove ignored kinds, compared without accents or case."""
    names = df.sparkSession.createDataFrame([(k,) for k in ignored], "__k string")
    folded = df.withColumn("__k", fold_label(F.col(kind)))
    return folded.join(F.broadcast(names), "__k", "left_anti").drop("__k")
