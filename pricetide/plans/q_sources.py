"""Scans, JSON and HTML extraction, series, and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.numbers import safe_double
from ..operators import explore, index, merge, resolve
from ..sources import html, records, series, snapshots, tables
from . import bindings as B
from .registry import query

# ---------------------------------------------------------------- snapshots
SNAPSHOT = """'listings_' || strftime(CAST(date_trunc('quarter', l_shipdate) AS DATE), '%d_%m_%Y')"""


def _dated_observations(spark, sf):
    obs = B.observations(spark, sf)
    name = F.concat(F.lit("listings_"), F.date_format(F.date_trunc("quarter", "day"), "dd_MM_yyyy"))
    return obs.withColumn("snapshot", name)


@query(
    "snapshot_scan",
    f"""SELECT {SNAPSHOT} AS source_db, strftime(CAST(date_trunc('quarter', l_shipdate) AS DATE), '%Y-%m-%d') AS snapshot_date,
        count(*) AS n, round(sum(l_extendedprice), 2) AS price_sum, min(CAST(l_partkey AS VARCHAR)) AS first_code
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def snapshot_scan(spark, sf):
    """Write one dated folder per quarter, then read them back by pattern."""
    folder = B.shared_folder(spark, "snapshots")
    dated = _dated_observations(spark, sf).select("snapshot", "code", "price", "district", "kind")
    dated.repartition("snapshot").write.partitionBy("snapshot").parquet(folder)
    back = snapshots.read_snapshots(spark, folder, "*.parquet")
    return back.groupBy(F.regexp_extract("source_db", "(listings_.*)$", 1).alias("source_db"), F.col("snapshot_date").cast("string").alias("snapshot_date")).agg(
        F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price_sum"), F.min("code").alias("first_code")
    )


@query(
    "schema_drift_union",
    f"""WITH {B.OBS}
    SELECT year(day) < 1998 AS early, CASE WHEN year(day) < 1998 THEN NULL ELSE district END AS district, count(*) AS n,
           count(CASE WHEN year(day) < 1998 THEN NULL ELSE source END) AS with_address, round(sum(price), 2) AS price_sum
    FROM obs GROUP BY 1, 2""",
)
def schema_drift_union(spark, sf):
    """Early observations lack two columns; the union and the fixed column list fill them with null."""
    obs = B.observations(spark, sf).withColumn("early", F.year("day") < 1998)
    old = obs.filter("early").select("early", "code", "price")
    new = obs.filter("NOT early").select("early", "code", "price", "district", F.col("source").alias("address"))
    both = snapshots.union_drifting([old, new])
    fixed = snapshots.conform(both).withColumn("early", F.col("district").isNull())
    return fixed.groupBy("early", "district").agg(
        F.count("*").alias("n"), F.count("address").alias("with_address"), F.round(F.sum("price"), 2).alias("price_sum")
    )


@query(
    "training_frame",
    f"""WITH {B.OBS},
    typed AS (
        SELECT price, lower(district) AS district, ['Casa', 'Apartamento', 'Terreno'][l_linenumber % 3 + 1] AS kind,
               CASE l_linenumber % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE area END AS area_total,
               CASE l_linenumber % 3 WHEN 0 THEN 0.0 ELSE area END AS area_private, CAST(rooms AS DOUBLE) AS rooms
        FROM obs WHERE price > 0)
    SELECT district, kind, count(*) AS n, round(sum(price), 2) AS price_sum, round(sum(area_total), 2) AS area_total,
           round(sum(area_private), 2) AS area_private, round(sum(rooms), 2) AS rooms
    FROM typed WHERE area_total > 0 OR area_private > 0 GROUP BY 1, 2""",
)
def training_frame(spark, sf):
    line = F.col("l_linenumber")
    raw = B.observations(spark, sf).select(
        "price",
        F.upper("district").alias("district"),
        F.element_at(F.array(F.lit("Casas"), F.lit("Apartamento duplex"), F.lit("LOTE urbano")), line % 3 + 1).alias("kind"),
        F.when(line % 4 == 0, "").when(line % 4 == 1, "n/d").otherwise(F.col("area").cast("string")).alias("area_total"),
        F.when(line % 3 == 0, F.lit(None)).otherwise(F.col("area").cast("string")).alias("area_private"),
        F.col("rooms").cast("string").alias("rooms"),
        F.lit(None).cast("string").alias("baths"),
        F.lit("x").alias("parking"),
    )
    return snapshots.training_frame(raw).groupBy("district", "kind").agg(
        F.count("*").alias("n"),
        F.round(F.sum("price"), 2).alias("price_sum"),
        *[F.round(F.sum(c), 2).alias(c) for c in ("area_total", "area_private", "rooms")],
    )


# ---------------------------------------------------------------- JSON
def _k():
    return F.get_json_object("props", "$.k").cast("int")


K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query(
    "json_attr_extract",
    f"""WITH e AS (SELECT event_id, event_type, user_id, value, {K_SQL} AS k FROM events),
    f AS (
        SELECT *, CASE WHEN k % 4 = 0 THEN NULL ELSE value END AS private,
               CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS total FROM e),
    g AS (SELECT *, coalesce(nullif(total, 0), nullif(private, 0), total) AS t, coalesce(nullif(private, 0), nullif(total, 0), private) AS p FROM f)
    SELECT CAST(event_id AS VARCHAR) AS id, event_type AS district, value AS price, t AS area_total, p AS area_private,
           CASE WHEN value <> 0 AND coalesce(nullif(p, 0), nullif(t, 0)) > 0 THEN value / coalesce(nullif(p, 0), nullif(t, 0)) END AS price_m2,
           CAST(nullif(CASE WHEN k % 5 = 0 THEN user_id % 7 ELSE k % 6 + 1 END, 0) AS INTEGER) AS rooms,
           CAST(nullif(k % 3, 0) AS INTEGER) AS baths,
           'Rua ' || event_type || CASE WHEN k % 2 = 0 THEN ', ' || k ELSE '' END AS address,
           'http://host.example' || '/cdn/' || event_id || '.jpg' AS image_url
    FROM g""",
)
def json_attr_extract(spark, sf):
    """Responses with an attribute list, assembled from events and parsed back."""
    k = _k()

    def attribute(key: int, value):
        return F.struct(F.lit(key).alias("idCaracteristica"), F.lit("x").alias("descricao"), value.cast("string").alias("valor"))

    attributes = F.array(
        attribute(9, F.when(k % 4 == 0, F.lit("")).otherwise(F.col("value").cast("string"))),
        attribute(27, F.when(k % 3 == 0, F.lit("0")).otherwise(k.cast("string"))),
        F.when(k % 5 != 0, attribute(3, F.concat(F.lit("1 + "), (k % 6).cast("string"), F.lit(" suítes")))),
        attribute(5, F.col("user_id") % 7),
        attribute(6, k % 3),
        attribute(9, F.lit("999999")),
    )
    result = F.struct(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("bairro"),
        F.concat(F.lit("Rua "), F.col("event_type")).alias("endereco"),
        F.when(k % 2 == 0, k.cast("string")).otherwise(F.lit("##")).alias("numero"),
        F.struct(F.col("value").cast("string").alias("valor")).alias("configVenda"),
        F.array(F.struct(F.concat(F.lit("/cdn/"), B.text("event_id"), F.lit(".jpg")).alias("url"), F.lit("").alias("urlCDN"))).alias("imagens"),
        F.array_compact(attributes).alias("caracteristicas"),
    )
    events = B.spread_table(spark, sf, "events", "event_id")
    body = F.to_json(F.struct(F.lit(True).alias("success"), F.array(result).alias("result")))
    out = records.detail_records(events.select(body.alias("body")), base_url="http://host.example/api/detail")
    return out.select(
        "id", "district", "price", "area_total", "area_private", "price_m2", "rooms", "baths", "address", "image_url"
    )


@query(
    "json_flat_record",
    f"""WITH e AS (SELECT event_id, event_type, user_id, value, {K_SQL} AS k FROM events),
    g AS (
        SELECT *, CASE WHEN k % 2 = 0 THEN NULL ELSE CAST(k + 1 AS DOUBLE) END AS private, CASE WHEN k % 3 = 0 THEN 0.0 ELSE k + 2.0 END AS total FROM e)
    SELECT CAST(event_id AS VARCHAR) AS id, value AS price, coalesce(nullif(total, 0), private, total) AS area_total,
           coalesce(nullif(private, 0), nullif(total, 0), private) AS area_private,
           CASE WHEN k % 4 = 0 THEN 'g/' || event_id ELSE 'c/' || event_id END AS image_url,
           event_type AS kind, CAST(user_id % 5 AS INTEGER) AS rooms
    FROM g""",
)
def json_flat_record(spark, sf):
    k = _k()
    hit = F.struct(
        B.text("event_id").alias("id"),
        F.col("value").alias("price_sale"),
        F.when(k % 2 != 0, (k + 1).cast("double")).alias("private_area"),
        F.when(k % 3 == 0, F.lit(0.0)).otherwise((k + 2).cast("double")).alias("total_area"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("c/"), B.text("event_id"))).alias("cover_original_url"),
        F.array(F.struct(F.concat(F.lit("g/"), B.text("event_id")).alias("url_original"))).alias("images"),
        F.col("event_type").alias("type"),
        (F.col("user_id") % 5).cast("int").alias("qtd_bedrooms"),
    )
    hits = B.spread_table(spark, sf, "events", "event_id").select(F.to_json(hit).alias("body"))
    return records.hit_records(hits).select("id", "price", "area_total", "area_private", "image_url", "kind", "rooms")


@query(
    "json_card_record",
    f"""WITH e AS (SELECT event_id, value, {K_SQL} AS k FROM events),
    g AS (SELECT *, CASE WHEN k % 2 = 0 THEN nullif(CAST(k AS DOUBLE), 0) ELSE value END AS total, value + 0.0 AS private FROM e)
    SELECT CAST(event_id AS VARCHAR) AS id, round(value * 1000, 2) AS price,
           coalesce(nullif(total, 0), nullif(private, 0), total) AS area_total, private AS area_private,
           CAST(nullif(k % 4, 0) AS INTEGER) AS rooms
    FROM g""",
)
def json_card_record(spark, sf):
    """Cards with text numbers; the lot area stands in when the main one is missing."""
    k = _k()
    value = F.translate(F.col("value").cast("string"), ".", ",")
    card = F.struct(
        B.text("event_id").alias("codigo"),
        F.concat(F.lit("R$ "), F.translate(F.format_number(F.col("value") * 1000, 2), ",.", ".,")).alias("valor"),
        F.when(k % 2 == 0, k.cast("string")).otherwise(F.lit("")).alias("areaprincipal"),
        F.when(k == 0, F.lit("")).otherwise(value).alias("arealote"),
        value.alias("areainterna"),
        (k % 4).cast("string").alias("numeroquartos"),
    )
    cards = B.spread_table(spark, sf, "events", "event_id").select(F.to_json(card).alias("body"))
    return records.card_records(cards).select("id", F.round("price", 2).alias("price"), "area_total", "area_private", "rooms")


# ---------------------------------------------------------------- HTML
@query(
    "html_field_extract",
    r"""SELECT page_id, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
        trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS heading,
        nullif(regexp_extract(url, '://[^/]+/[a-z]+/(\d+)', 1), '') AS number,
        nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title,
        CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS paragraphs
        FROM pages""",
)
def html_field_extract(spark, sf):
    body = F.col("html")
    return B.table(spark, sf, "pages").select(
        "page_id",
        html.found(body, '<html lang="([^"]*)"').alias("lang"),
        html.strip_tags(F.regexp_extract(body, r"(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("heading"),
        html.found(F.col("url"), r"://[^/]+/[a-z]+/(\d+)").alias("number"),
        html.found(body, "<title>([^<]*)</title>").alias("title"),
        F.size(F.regexp_extract_all(body, F.lit("(<p[ >])"), F.lit(1))).alias("paragraphs"),
    )


def _listing_pages(spark, sf):
    """Listing pages in the collected markup, one per part."""
    part = B.spread_table(spark, sf, "part", "p_partkey")
    key = B.text("p_partkey")
    total = F.col("p_size").cast("string")
    page = F.concat(
        F.lit('<html><head><meta property="og:image" content="/img/'), key, F.lit('.jpg"></head><body><div class="titulos_pagina"><h1><span>Casa à venda</span> Código: '),
        key, F.lit(" Bairro "), F.col("p_brand"), F.lit(" em Chapecó | Casas</h1></div><div id=\"valores_resp\"><div class=\"valor\"><span>R$ <span>"),
        F.translate(F.format_number("p_retailprice", 2), ",.", ".,"),
        F.lit('</span></span></div></div><ul class="caracteristicas"><li><use href="#icone-dormitorio"></use> '),
        (F.col("p_size") % 5 + 1).cast("string"), F.lit(' Quartos</li><li>Wi-Fi</li><li>'), (F.col("p_size") % 3 + 1).cast("string"),
        F.lit(' Banheiros</li><li><use href="#icone-area"></use> <strong>'), total, F.lit(",5 m²</strong> Área total</li>"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<li><use href="#icone-area"></use> Área privativa <strong>1.'), F.lpad(total, 3, "0"), F.lit(",25 m²</strong></li>"))).otherwise(F.lit("")),
        F.lit("</ul></body></html>"),
    )
    return part.select("p_partkey", F.concat(F.lit("https://agency.example/imovel/"), key, F.lit("/x")).alias("url"), page.alias("html"))


@query(
    "html_listing_fields",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, round(p_retailprice, 2) AS price, p_brand AS district, 'Chapecó' AS city, 'Casa' AS kind,
       CAST(p_size + 0.5 AS DOUBLE) AS area_total, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1000 + p_size + 0.25 ELSE p_size + 0.5 END AS DOUBLE) AS area_private,
       CAST(p_size % 5 + 1 AS INTEGER) AS rooms, CAST(p_size % 3 + 1 AS INTEGER) AS baths, 0 AS parking,
       'https://agency.example/img/' || p_partkey || '.jpg' AS image_url FROM part""",
)
def html_listing_fields(spark, sf):
    out = html.title_records(_listing_pages(spark, sf))
    return out.withColumn("price", F.round("price", 2)).drop("price_m2")


def _label_pages(spark, sf):
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")

    def card(label, value):
        return F.concat(F.lit('<div class="carac"><span class="carac__title">'), label, F.lit('</span><span class="carac__value"><b>'), value, F.lit("</b></span></div>"))

    body = F.concat(
        F.lit('<html><body><div data-elementor-type="single-post" class="post bairro-'),
        F.lower(F.translate("p_brand", "#", "-")), F.lit(" cidade-chapeco tipo-"), F.lower("p_type"), F.lit('">Referência: '), key,
        F.lit(" R$ "), F.translate(F.format_number("p_retailprice", 2), ",.", ".,"), F.lit('<img src="i/'), key, F.lit('.png">'),
        card(F.lit("Área Construída"), F.concat(size, F.lit(",50"))),
        card(F.lit("Dormitórios"), F.lit("9")),
        card(F.lit("DORMITÓRIOS"), (F.col("p_size") % 5 + 1).cast("string")),
        F.when(F.col("p_partkey") % 2 == 0, card(F.lit("Vagas"), F.lit("2 cobertas"))).otherwise(F.lit("")),
        F.lit("</div></body></html>"),
    )
    return B.spread_table(spark, sf, "part", "p_partkey").select("p_partkey", F.lit("https://agency.example/lista/p1?x=1").alias("url"), body.alias("html"))


@query(
    "html_label_map",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, round(p_retailprice, 2) AS price, 'Brand ' || substr(p_brand, 7) AS district, 'Chapeco' AS city,
       upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS kind, CAST(p_size + 0.5 AS DOUBLE) AS area_total, CAST(p_size + 0.5 AS DOUBLE) AS area_private,
       CAST(p_size % 5 + 1 AS INTEGER) AS rooms, 0 AS baths, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS parking,
       'https://agency.example/lista/i/' || p_partkey || '.png' AS image_url FROM part""",
)
def html_label_map(spark, sf):
    out = html.slug_records(_label_pages(spark, sf))
    return out.withColumn("price", F.round("price", 2)).drop("price_m2")


@query(
    "html_links",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos FROM pages)
    SELECT page_id, link AS link_id, CAST(min(pos) - 1 AS INTEGER) AS position, count(*) AS occurrences FROM l WHERE link <> '' GROUP BY 1, 2""",
)
def html_links(spark, sf):
    return html.links(B.spread_table(spark, sf, "pages", "page_id"), identifier="^(.+)$").drop("link")


@query(
    "absolute_url",
    r"""WITH l AS (SELECT page_id, url, nullif(regexp_extract(html, '<a[^>]*href="([^"]*)"', 1), '') AS link FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN link LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link
                    ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://.*/)', 1) || link END AS first_link,
           regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://.*/)', 1) || 'img/' || page_id || '.png' AS image_url
    FROM l""",
)
def absolute_url(spark, sf):
    pages = B.table(spark, sf, "pages")
    return pages.select(
        "page_id",
        html.first_image(F.col("html"), F.col("url"), (r'<img[^>]*data-none="([^"]*)"', r'<a[^>]*href="([^"]*)"')).alias("first_link"),
        html.absolute_url(F.col("url"), F.concat(F.lit("img/"), B.text("page_id"), F.lit(".png"))).alias("image_url"),
    )


def _tag_texts_sql() -> str:
    text = "regexp_replace(regexp_replace(split_part(piece, chr(2), 2), '(?is)</(?:title|h1|p)\\s*>.*$', ''), '<[^>]*>', ' ', 'g')"
    for reference, character in html.ENTITIES:
        text = f"replace({text}, '{reference}', '{character.replace(chr(39), chr(39) * 2)}')"
    return rf"""WITH marked AS (
        SELECT page_id, string_split(regexp_replace(regexp_replace(html, '{html.NO_TEXT}', '', 'g'), '(?i)<(title|h1|p)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS pieces FROM pages),
    cut AS (SELECT page_id, unnest(pieces[2:]) AS piece, unnest(range(len(pieces) - 1)) AS position FROM marked)
    SELECT page_id, lower(split_part(piece, chr(2), 1)) AS tag, CAST(position AS INTEGER) AS position, trim(regexp_replace({text}, '\s+', ' ', 'g')) AS text FROM cut"""


@query("html_tag_texts", _tag_texts_sql())
def html_tag_texts(spark, sf):
    """Title, headings and paragraphs of every page."""
    return html.tag_texts(B.spread_table(spark, sf, "pages", "page_id"), ("title", "h1", "p"))


def _summary_pages(spark, sf):
    """Pages with summary rows; parts of even key name their counts by title only."""
    key, size = B.text("p_partkey"), B.text("p_size")
    even = F.col("p_partkey") % 2 == 0

    def row(label, value):
        open_row = '<div class="flex flex-justify-space-between flex-align-center pv-2 border-bottom"><span class="icon">i</span><span class="font-alt">'
        return F.concat(F.lit(open_row), F.lit(label), F.lit('</span><span class="font-alt bold">'), value, F.lit("</span></div>"))

    def titled(label, value):
        return F.concat(F.lit(f'<div class="mini" title="{label}"><span>x</span><span>'), value, F.lit("</span></div>"))

    rooms, baths = (F.col("p_size") % 5 + 1).cast("string"), (F.col("p_size") % 3 + 1).cast("string")
    named = F.concat(row("Dormitórios", F.concat(rooms, F.lit(" + 1 suíte"))), row("Banheiros", baths), row("Garagens", F.lit("2 vagas")))
    body = F.concat(
        F.lit('<html><body><div class="flex flex-align-center"><span class="material-icons" title="'), F.lower("p_type"),
        F.lit('">home</span></div><div class="container wide"><div class="col-12 m"><h2>'), F.col("p_brand"), F.lit('</h2></div></div><h2 class="text-primary">R$ '),
        F.translate(F.format_number("p_retailprice", 2), ",.", ".,"), F.lit('</h2><a href="/cdn/'), key, F.lit('.jpg">f</a>'),
        F.when(even, F.concat(titled("Quartos", rooms), titled("BWC", baths), titled("Vagas de Garagem", F.lit("3")))).otherwise(named),
        row("Área Total", F.concat(size, F.lit(",50 m²"))), F.when(F.col("p_partkey") % 3 == 0, row("Área Privativa", F.concat(size, F.lit(",25")))).otherwise(""),
        F.lit("</body></html>"),
    )
    part = B.spread_table(spark, sf, "part", "p_partkey")
    return part.select(F.concat(F.lit("https://agency.example/imovel.php?id="), key).alias("url"), body.alias("html"))


@query(
    "html_summary_rows",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, round(p_retailprice, 2) AS price, p_brand AS district, 'Chapeco' AS city, lower(p_type) AS kind,
       CAST(p_size + 0.5 AS DOUBLE) AS area_total, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.25 ELSE p_size + 0.5 END AS DOUBLE) AS area_private,
       CAST(p_size % 5 + 1 + p_partkey % 2 AS INTEGER) AS rooms, CAST(p_size % 3 + 1 AS INTEGER) AS baths, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS parking,
       'https://agency.example/cdn/' || p_partkey || '.jpg' AS image_url FROM part""",
)
def html_summary_rows(spark, sf):
    out = html.summary_records(_summary_pages(spark, sf))
    return out.withColumn("price", F.round("price", 2)).drop("price_m2")


def _classed_pages(spark, sf):
    """Pages of classed list items; the district stands in a hidden paragraph or in the address only."""
    key, size = B.text("p_partkey"), B.text("p_size")

    def item(name, label, value):
        return F.concat(F.lit(f'<li class="{name}"><div>i</div><div>{label}<strong>'), value, F.lit("</strong></div></li>"))

    body = F.concat(
        F.lit("<html><head><title>"), F.lit("Casa de esquina"), F.lit('</title><meta property="og:image" content="/f/'), key, F.lit('.jpg"></head><body><ul>'),
        F.when(F.col("p_partkey") % 2 == 0, item("tipo x", "Tipo ", F.lower("p_type"))).otherwise(""),
        item("area", "Lote | ", F.concat(size, F.lit(",50 m²"))), F.when(F.col("p_partkey") % 3 == 0, item("area", "Medida | ", F.concat(size, F.lit(",25 m²")))).otherwise(""),
        item("quarto", "", (F.col("p_size") % 5 + 1).cast("string")), item("banheiro", "", (F.col("p_size") % 3 + 1).cast("string")), item("vaga", "", F.lit("2")),
        F.lit('</ul><span class="vtotalvenda"><b>R$ '), F.translate(F.format_number("p_retailprice", 2), ",.", ".,"), F.lit("</b></span>"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit('<p class="visually-hidden">Casa no bairro Jardim Sul em Chapecó</p>')).otherwise(""), F.lit("</body></html>"),
    )
    url = F.concat(F.lit("https://agency.example/imovel/"), key, F.lit("/casa-venda-3-quartos-vila-nova-chapeco"))
    return B.spread_table(spark, sf, "part", "p_partkey").select(url.alias("url"), body.alias("html"))


@query(
    "html_classed_items",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, round(p_retailprice, 2) AS price, CASE WHEN p_partkey % 5 = 0 THEN 'Jardim Sul' ELSE 'Vila Nova' END AS district, 'Chapecó' AS city,
       CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE 'Casa' END AS kind,
       CAST(p_size + 0.5 AS DOUBLE) AS area_total, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.25 ELSE p_size + 0.5 END AS DOUBLE) AS area_private,
       CAST(p_size % 5 + 1 AS INTEGER) AS rooms, CAST(p_size % 3 + 1 AS INTEGER) AS baths, 2 AS parking, 'https://agency.example/f/' || p_partkey || '.jpg' AS image_url FROM part""",
)
def html_classed_items(spark, sf):
    out = html.classed_records(_classed_pages(spark, sf))
    return out.withColumn("price", F.round("price", 2)).drop("price_m2")


# ---------------------------------------------------------------- series and files
@query(
    "series_monthly",
    f"WITH {B.MONTHLY} SELECT series, strftime(month, '%Y-%m') AS month, total AS value FROM monthly",
)
def series_monthly(spark, sf):
    """Stored series documents, with every month given twice; the first value counts."""
    monthly = B.monthly_orders(spark, sf)

    def point(day: str, value):
        return F.struct(F.date_format("month", day).alias("data"), value.alias("valor"))

    twice = monthly.select("series", "month", F.array(point("'01'/MM/yyyy", F.col("total")), point("'15'/MM/yyyy", F.col("total") + 1)).alias("p"))
    # One document per series, bounded by the calendar.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("month", "p"))), lambda x: x["p"])
    documents = twice.groupBy("series").agg(F.to_json(F.flatten(ordered)).alias("body"))
    first = index.first_per_month(series.parse_series(documents), ["series"])
    return first.select("series", F.date_format("month", "yyyy-MM").alias("month"), "value")


@query(
    "csv_roundtrip",
    """SELECT p_partkey AS code, CASE WHEN p_partkey % 3 = 0 THEN 'NA' ELSE p_brand END AS district,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS price FROM part""",
)
def csv_roundtrip(spark, sf):
    part = B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("code"),
        F.when(F.col("p_partkey") % 3 == 0, "NA").otherwise(F.col("p_brand")).alias("district"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("name"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"),
    )
    folder = B.shared_folder(spark, "csv")
    tables.write_csv(part, folder)
    return tables.read_csv(spark, folder, "code long, district string, name string, price double")


@query(
    "signature_hash",
    """WITH m AS (SELECT vec_id // 2 AS media, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1),
    g AS (SELECT media, list_concat(e, e[1:8]) AS g FROM m),
    b AS (SELECT media, list_transform(list_filter(range(1, 73), lambda i: (i - 1) % 9 <> 0), lambda i: CASE WHEN g[i] > g[i - 1] THEN 1 ELSE 0 END) AS b FROM g),
    h AS (SELECT media, array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', CAST(8 * b[4*i+1] + 4 * b[4*i+2] + 2 * b[4*i+3] + b[4*i+4] + 1 AS BIGINT), 1)), '') AS hash FROM b)
    SELECT e.vec_id, h.hash FROM embeddings e JOIN h ON h.media = e.vec_id // 2""",
)
def signature_hash(spark, sf):
    """Grey grids of 9 x 8: each distinct medium is hashed once and joined back to its users."""
    vectors = B.table(spark, sf, "embeddings").withColumn("media", F.floor(F.col("vec_id") / 2))
    media = vectors.groupBy("media").agg(F.min_by("embedding", "vec_id").alias("e"))
    grid = F.concat("e", F.slice("e", 1, 8))
    hashed = media.select("media", H.bits_to_hex(H.difference_bits(grid, 9)).alias("hash"))
    return vectors.select("vec_id", "media").join(hashed, "media").select("vec_id", "hash")


# ---------------------------------------------------------------- sinks
def _event_rows(spark, sf):
    k = _k()
    return B.table(spark, sf, "events").select(
        F.when(k % 10 == 0, "").otherwise(B.text("user_id")).alias("id"),
        F.col("value").alias("price"),
        F.col("event_type").alias("district"),
        F.when(k % 2 == 0, "").otherwise(F.lit("Xaxim")).alias("city"),
        k.alias("rooms"),
        "ts",
        "event_id",
    )


@query(
    "upsert_latest",
    f"""WITH e AS (SELECT *, {K_SQL} AS k FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, min(ts) OVER (PARTITION BY user_id) AS t0, max(ts) OVER (PARTITION BY user_id) AS t1 FROM e WHERE k % 10 <> 0)
    SELECT 'SM-' || user_id AS id, value AS price, event_type AS district, CASE WHEN k % 2 = 0 THEN 'Chapecó' ELSE 'Xaxim' END AS city, k AS rooms,
           strftime(t0, '%Y-%m-%d %H:%M:%S') AS inserted_at, strftime(t1, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM r WHERE rn = 1""",
)
def upsert_latest(spark, sf):
    out = merge.upsert_latest(_event_rows(spark, sf), F.struct("ts", "event_id"), F.col("ts"), "SM-", "Chapecó")
    stamp = "yyyy-MM-dd HH:mm:ss"
    return out.withColumns({c: F.date_format(c, stamp) for c in ("inserted_at", "updated_at")})


@query(
    "replace_latest",
    """SELECT CAST(l_partkey AS VARCHAR) AS code, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS price,
       arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS area, strftime(max(l_shipdate), '%Y-%m-%d') AS day
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def replace_latest(spark, sf):
    obs = B.observations(spark, sf).select("code", "price", "area", F.col("day").cast("string").alias("day"), "l_orderkey", "l_linenumber", "l_suppkey")
    out = merge.replace_latest(obs, "code", F.struct("day", "l_orderkey", "l_linenumber", "l_suppkey"))
    return out.select("code", "price", "area", "day")


HISTORY_ORDER = "(l_orderkey, l_linenumber, l_extendedprice, l_suppkey)"


def _history_rows(spark, sf):
    obs = B.spread_observations(spark, sf)
    snapshot = F.concat(F.lit("listings_"), F.date_format("day", "dd_MM_yyyy"))
    return obs.select(
        "code",
        F.concat_ws("-", "source", "code").alias("id"),
        "price",
        F.col("area").alias("area_total"),
        F.lit(0.0).alias("area_private"),
        F.when(F.col("l_linenumber") % 2 == 0, snapshot).otherwise(F.concat(F.lit("batch"), (F.col("l_suppkey") % 3).cast("string"))).alias("source_db"),
        F.lit("").alias("updated_at"),
        F.concat(F.col("day").cast("string"), F.lit("T08:00:00")).alias("inserted_at"),
        F.struct("l_orderkey", "l_linenumber", "price", "l_suppkey").alias("order"),
    )


@query(
    "history_dedup",
    f"""WITH {B.OBS}, h AS (
        SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'listings_' || strftime(day, '%d_%m_%Y') ELSE 'batch' || (l_suppkey % 3) END AS source_db FROM obs),
    r AS (SELECT *, row_number() OVER (PARTITION BY code, day, source_db ORDER BY l_orderkey DESC, l_linenumber DESC, price DESC, l_suppkey DESC) AS rn FROM h)
    SELECT code, strftime(day, '%Y-%m-%d') AS day, price, {B.half_up('price / area', 6)} AS price_m2, source || '-' || code AS source_id, source_db FROM r WHERE rn = 1""",
)
def history_dedup(spark, sf):
    out = merge.price_history(_history_rows(spark, sf), F.col("order"))
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "run_summary",
    f"""WITH RECURSIVE {B.COMPONENTS}
    SELECT key, value FROM (
        SELECT 'source_db' AS key, 'part' AS value UNION ALL SELECT 'source_rows', CAST(count(*) AS VARCHAR) FROM part
        UNION ALL SELECT 'price_rows', CAST(count(*) FILTER (p_retailprice > 0) AS VARCHAR) FROM part
        UNION ALL SELECT 'normalized_rows', CAST(count(DISTINCT component) AS VARCHAR) FROM components
        UNION ALL SELECT 'generated_at', '2026-09-03')""",
)
def run_summary(spark, sf):
    rows = B.entities(spark, sf)
    assigned, _, _ = resolve.deduplicate(rows, visual=False)
    clusters = assigned.select("cluster").distinct()
    return merge.run_summary(rows, clusters, "part", "2026-09-03")


@query(
    "district_lists",
    f"""WITH {B.OBS}, c AS (SELECT kind, district, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(*) >= 400)
    SELECT kind, string_agg(district, '|' ORDER BY district) AS districts, count(*) AS n FROM c GROUP BY 1""",
)
def district_lists(spark, sf):
    """Districts per kind with enough listings, as published in one JSON object."""
    out = explore.district_lists(B.observations(spark, sf), 400)
    return out.select("kind", F.array_join("districts", "|").alias("districts"), F.size("districts").cast("long").alias("n"))
