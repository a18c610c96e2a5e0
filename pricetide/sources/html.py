"""Field extraction from stored pages with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import backfill, first_int, parse_decimal, parse_money, parse_rooms, price_per_area
from ..functions.text import fold_label, slug_title


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def absolute_url(base: Column, value: Column) -> Column:
    """Resolve a link against the page address; null for an empty link."""
    text = F.trim(value)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    path = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), text)
        .when(text.startswith("//"), F.concat(scheme, text))
        .when(text.startswith("/"), F.concat(root, text))
        .when(text.startswith("?"), F.concat(plain, text))
        .when(text.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), text))
        .when(text != "", F.concat(root, folder, text))
    )


def strip_tags(html: Column) -> Column:
    """Text content with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def links(pages: DataFrame, html: str = "html", keys: list[str] | None = None, pattern: str = r'href="([^"]*)"', identifier: str | None = None) -> DataFrame:
    """Every link of every page once, at its first position.

    ``identifier`` extracts an id from the link; without it the link itself is the id.
    """
    keys = keys or ["page_id"]
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("position", "link"))
    rows = rows.withColumn("link_id", found(F.col("link"), identifier) if identifier else F.col("link"))
    return (
        rows.filter("link_id IS NOT NULL")
        .groupBy(*keys, "link_id")
        .agg(F.min(F.struct("position", "link")).alias("first"), F.count("*").alias("occurrences"))
        .select(*keys, "link_id", "first.position", "first.link", "occurrences")
    )


def first_image(html: Column, base: Column, patterns: tuple[str, ...]) -> Column:
    """First filled image of an ordered list of patterns, made absolute."""
    return absolute_url(base, F.coalesce(*[found(html, p) for p in patterns]))


# Markup patterns of image links, in order of preference.
IMAGE_PATTERNS = (
    r'<meta[^>]*property="og:image"[^>]*content="([^"]*)"',
    r'<a[^>]*data-fancybox="galeria"[^>]*href="([^"]*)"',
    r'<img[^>]*src="([^"]*)"',
)


def label_map(html: Column, pair_pattern: str) -> Column:
    """Map of accent-free label to text from markup pairs; a repeated label keeps its last value.

    ``pair_pattern`` matches one pair with the label in group 1 and the value in group 2.
    """
    labels = F.regexp_extract_all(html, F.lit(pair_pattern), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(pair_pattern), F.lit(2))
    return last_entries(
        F.zip_with(labels, values, lambda k, v: F.struct(fold_label(strip_tags(k)).alias("key"), strip_tags(v).alias("value")))
    )


def last_entries(entries: Column) -> Column:
    """Map of (key, value) structs: empty keys are dropped, of equal keys the last one counts."""
    entries = F.filter(entries, lambda e: e["key"] != "")
    last = F.filter(
        F.transform(
            entries,
            lambda e, i: F.struct(
                e["key"].alias("key"),
                e["value"].alias("value"),
                F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda o: o["key"] == e["key"]).alias("again"),
            ),
        ),
        lambda e: ~e["again"],
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def titled_value(html: Column, titles: list[str]) -> Column:
    """Last span inside the first div whose ``title`` attribute names one of the titles, tried in order."""

    def named(title: str) -> Column:
        block = F.regexp_extract(html, rf'(?is)<div[^>]*\btitle="[^"]*{title}[^"]*"[^>]*>(.*?)</div>', 1)
        return strip_tags(F.try_element_at(F.regexp_extract_all(block, F.lit(r"(?is)<span[^>]*>(.*?)</span>"), F.lit(1)), F.lit(-1)))

    return F.coalesce(*[F.nullif(named(title), F.lit("")) for title in titles])


def map_lookup(labels: Column, parts: list[str]) -> Column:
    """Value of the first label containing one of the parts, tried in order."""

    def first_with(part: str) -> Column:
        return F.get(F.map_values(F.map_filter(labels, lambda k, _: k.contains(part))), F.lit(0))

    return F.coalesce(*[first_with(part) for part in parts])


# Patterns of the listing pages (title code, location, labelled numbers, class slugs).
TITLE_CODE = r"C[oó]digo[:\s]+(\d+)"
TITLE_PLACE = r"(?i)Bairro\s+(.+?)\s+em\s+(.+?)(?:\s*\||\s*$)"
REFERENCE_CODE = r"Refer[eê]ncia[:\s]+(\d+)"
# A card without a value does not take the next card's.
CARD_PAIR = r'(?s)class="carac__title"[^>]*>(.*?)</[a-z]+>(?:(?!carac__title).)*?class="carac__value"[^>]*>(.*?)</[a-z]+>'


def list_items(html: Column) -> Column:
    """Inner markup of every list item."""
    return F.regexp_extract_all(html, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))


def item_count(items: Column, *marks: str) -> Column:
    """First number of the first numbered item carrying one of the icon or text marks."""

    def carries(item: Column) -> Column:
        text = F.lower(item)
        hit = F.lit(False)
        for mark in marks:
            hit = hit | text.contains(mark)
        return hit & strip_tags(item).rlike(r"\d")

    return found(strip_tags(F.get(F.filter(items, carries), F.lit(0))), r"(\d+)").try_cast("int")


def title_records(pages: DataFrame) -> DataFrame:
    """Listings whose heading names code, district and city; numbers sit in icon-marked list items."""
    html = F.col("html")
    heading = strip_tags(found(html, r"(?s)<h1[^>]*>(.*?)</h1>"))
    items = F.col("__items")
    sized = F.filter(items, lambda i: i.contains("#icone-area") & ~i.contains("servico") & i.rlike(r"(?s)<strong[^>]*>\s*[\d.,]+\s*m"))

    def area(private: bool) -> Column:
        named = F.filter(sized, lambda i: F.lower(i).rlike(r"privativa|privado|edif\.") == F.lit(private))
        raw = found(F.try_element_at(named, F.lit(-1)), r"(?s)<strong[^>]*>\s*([\d.,]+)\s*m")
        # With a comma, dots group thousands; without one the dot is decimal.
        return F.when(raw.contains(","), F.translate(raw, ",.", ".")).otherwise(raw).try_cast("double")

    df = pages.withColumn("__items", list_items(html))
    df = df.withColumns({"__total": area(False), "__private": area(True)})
    out = df.select(
        F.coalesce(found(heading, TITLE_CODE), found(F.col("url"), r"/imovel/(\d+)/")).alias("id"),
        parse_money(strip_tags(found(html, r'(?s)id="valores_resp".*?class="valor"[^>]*>(.*?)</div>')), "first").alias("price"),
        found(heading, TITLE_PLACE, 1).alias("district"),
        found(heading, TITLE_PLACE, 2).alias("city"),
        F.split(strip_tags(found(html, r"(?s)<h1[^>]*>.*?<span[^>]*>(.*?)</span>")), " ")[0].alias("kind"),
        backfill(F.col("__total"), F.col("__private")).alias("area_total"),
        backfill(F.col("__private"), F.col("__total")).alias("area_private"),
        item_count(items, "icone-dormitorio", "quarto", "dormit").alias("rooms"),
        item_count(items, "icone-banheiro", "banheiro").alias("baths"),
        F.coalesce(item_count(items, "icone-vagas", "vaga"), F.lit(0)).alias("parking"),
        first_image(html, F.col("url"), IMAGE_PATTERNS).alias("image_url"),
    )
    return out.withColumn("price_m2", price_per_area(F.col("price"), F.col("area_private"), F.col("area_total")))


def slug_records(pages: DataFrame) -> DataFrame:
    """Listings described by class slugs (district, city, kind) and a label/value card list."""
    html = F.col("html")
    df = pages.withColumn("__labels", label_map(html, CARD_PAIR))
    labels = F.col("__labels")
    container = F.coalesce(
        found(html, r'<[^>]*data-elementor-type="single-post"[^>]*class="([^"]*)"'),
        found(html, r'<[^>]*class="([^"]*)"[^>]*data-elementor-type="single-post"'),
    )
    total = parse_decimal(map_lookup(labels, ["areatotal", "area construida", "area total"]))
    private = parse_decimal(map_lookup(labels, ["areaprivativa", "area privativa", "area do terreno"]))
    counts = {"rooms": ["dormitorio", "quarto"], "baths": ["banheiro"], "parking": ["estacionamento", "vaga"]}
    text = strip_tags(html)
    out = df.select(
        found(text, REFERENCE_CODE).alias("id"),
        parse_money(text, "labelled").alias("price"),
        *[slug_title(found(container, rf"(?:^|\s){p}-(\S+)")).alias(n) for n, p in (("district", "bairro"), ("city", "cidade"), ("kind", "tipo"))],
        backfill(total, private).alias("area_total"),
        backfill(private, total).alias("area_private"),
        *[F.coalesce(found(map_lookup(labels, parts), r"(\d+)").try_cast("int"), F.lit(0)).alias(n) for n, parts in counts.items()],
        first_image(html, F.col("url"), IMAGE_PATTERNS).alias("image_url"),
    )
    return out.withColumn("price_m2", price_per_area(F.col("price"), F.col("area_private"), F.col("area_total")))


# Markup of the pages with summary rows and of the pages with classed list items.
SUMMARY_ROW = r'(?s)<div[^>]*class="[^"]*flex-justify-space-between[^"]*pv-2 border-bottom[^"]*"[^>]*>(.*?)</div>'
SUMMARY_SPAN = r'(?s)<span[^>]*class="[^"]*\bfont-alt\b[^"]*"[^>]*>(.*?)</span>'
SUMMARY_KIND = r'<span[^>]*class="[^"]*\bmaterial-icons\b[^"]*"[^>]*title="([^"]*)"'
SUMMARY_DISTRICT = r'(?s)<div[^>]*class="[^"]*\bcontainer\b.*?<div[^>]*class="[^"]*\bcol-12\b[^"]*"[^>]*>.*?<h2[^>]*>(.*?)</h2>'
SUMMARY_PRICE = r'(?s)<h2[^>]*class="[^"]*\btext-primary\b[^"]*"[^>]*>(.*?)</h2>'
SUMMARY_IMAGES = (
    r'<meta[^>]*property="og:image"[^>]*content="([^"]*)"',
    r'<a[^>]*href="([^"]*/cdn/[^"]*)"',
    r'<img[^>]*src="([^"]*)"',
)
CLASSED_PRICE = r'(?s)<[^>]*class="[^"]*\bvtotalvenda\b[^"]*"[^>]*>(.*?)</'
CLASSED_TITLE = r"^([A-Za-zÀ-ÿ\s]+?)\s+de\s+"
CLASSED_PLACE = r"(?is)bairro\s+(.+?)\s+em\s"


def summary_records(pages: DataFrame) -> DataFrame:
    """Listings with label/value summary rows; counts missing there are read from blocks named by their title."""
    html = F.col("html")
    rows = F.transform(F.regexp_extract_all(html, F.lit(SUMMARY_ROW), F.lit(1)), lambda r: F.regexp_extract_all(r, F.lit(SUMMARY_SPAN), F.lit(1)))
    pairs = F.transform(
        F.filter(rows, lambda r: F.size(r) >= 2),
        lambda r: F.struct(fold_label(strip_tags(F.element_at(r, -2))).alias("key"), strip_tags(F.element_at(r, -1)).alias("value")),
    )
    df = pages.withColumn("__labels", last_entries(pairs))

    def value(label: str, *titles: str) -> Column:
        known = F.nullif(F.try_element_at(F.col("__labels"), F.lit(label)), F.lit(""))
        return F.coalesce(known, titled_value(html, list(titles))) if titles else known

    total, private = parse_decimal(value("area total")), parse_decimal(value("area privativa"))
    out = df.select(
        found(F.col("url"), r"[?&]id=(\d+)").alias("id"),
        parse_money(strip_tags(found(html, SUMMARY_PRICE)), "first").alias("price"),
        F.nullif(strip_tags(found(html, SUMMARY_DISTRICT)), F.lit("")).alias("district"),
        F.lit("Chapeco").alias("city"),
        F.trim(found(html, SUMMARY_KIND)).alias("kind"),
        backfill(total, private).alias("area_total"),
        backfill(private, total).alias("area_private"),
        parse_rooms(value("dormitorios", "Quartos")).alias("rooms"),
        first_int(value("banheiros", "BWC", "Banheiros")).alias("baths"),
        first_int(value("garagens", "Vagas de Garagem", "Garagens", "Vagas")).alias("parking"),
        first_image(html, F.col("url"), SUMMARY_IMAGES).alias("image_url"),
    )
    return out.withColumn("price_m2", price_per_area(F.col("price"), F.col("area_private"), F.col("area_total")))


def classed_records(pages: DataFrame) -> DataFrame:
    """Listings whose facts are list items told apart by their class."""
    html = F.col("html")

    def items(name: str) -> Column:
        return F.regexp_extract_all(html, F.lit(rf'(?s)<li[^>]*class="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</li>'), F.lit(1))

    def strong(item: Column) -> Column:
        return F.nullif(strip_tags(F.regexp_extract(item, r"(?s)<strong[^>]*>(.*?)</strong>", 1)), F.lit(""))

    def first_strong(name: str) -> Column:
        return strong(F.get(items(name), F.lit(0)))

    # Areas in page order: a named one replaces its kind, an unnamed one fills what is still open, the private area first.
    areas = F.transform(
        items("area"),
        lambda i: F.struct(
            fold_label(F.split_part(strip_tags(F.regexp_extract(i, r"(?s)</div>\s*<div[^>]*>(.*?)</div>", 1)), F.lit("|"), F.lit(1))).alias("label"),
            parse_decimal(strong(i)).alias("value"),
        ),
    )
    none = F.lit(None).cast("double")

    def step(state: Column, area: Column) -> Column:
        label, value = area["label"], area["value"]
        named_private = label.contains("privativa") | label.contains("privada")
        named_total = ~named_private & (label.contains("lote") | label.contains("total") | label.contains("terreno"))
        other = ~named_private & ~named_total
        private = F.when(named_private | (other & state["private"].isNull()), value).otherwise(state["private"])
        total = F.when(named_total | (other & state["private"].isNotNull() & state["total"].isNull()), value).otherwise(state["total"])
        return F.struct(private.alias("private"), total.alias("total"))

    both = F.aggregate(F.filter(areas, lambda a: a["value"].isNotNull()), F.struct(none.alias("private"), none.alias("total")), step)
    df = pages.withColumn("__areas", both)
    private, total = F.col("__areas.private"), F.col("__areas.total")
    slug = F.regexp_replace(found(F.col("url"), r"/imovel/\d+/([^/]+)-chapeco"), r"^[a-z-]+-venda(-\d+-quartos)?-", "")
    hidden = strip_tags(found(html, r'(?s)<p[^>]*class="[^"]*\bvisually-hidden\b[^"]*"[^>]*>(.*?)</p>'))
    out = df.select(
        found(F.col("url"), r"/imovel/(\d+)").alias("id"),
        parse_money(strip_tags(found(html, CLASSED_PRICE)), "first").alias("price"),
        F.coalesce(F.trim(found(hidden, CLASSED_PLACE)), slug_title(slug)).alias("district"),
        F.lit("Chapecó").alias("city"),
        F.coalesce(first_strong("tipo"), F.trim(found(strip_tags(found(html, r"(?s)<title[^>]*>(.*?)</title>")), CLASSED_TITLE))).alias("kind"),
        backfill(total, private).alias("area_total"),
        backfill(private, total).alias("area_private"),
        parse_rooms(first_strong("quarto")).alias("rooms"),
        first_int(first_strong("banheiro")).alias("baths"),
        first_int(first_strong("vaga")).alias("parking"),
        first_image(html, F.col("url"), IMAGE_PATTERNS).alias("image_url"),
    )
    return out.withColumn("price_m2", price_per_area(F.col("price"), F.col("area_private"), F.col("area_total")))


# ---------------------------------------------------------------- texts by tag
# Character references that are decoded, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
NO_TEXT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def tag_texts(pages: DataFrame, tags: tuple[str, ...], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, tag, position, text) of every wanted element in page order.

    An element ends where a wanted tag closes or the next one opens, so unclosed paragraphs end at the next paragraph.
    Scripts, styles and comments are left out.
    """
    names = "|".join(tags)
    marked = F.regexp_replace(F.regexp_replace(F.col(html), NO_TEXT, ""), rf"(?i)<({names})(?:\s[^>]*)?>", "\u0001$1\u0002")
    pieces = F.split(marked, "\u0001")
    rows = pages.select(key, F.posexplode(F.slice(pieces, F.lit(2), F.size(pieces))).alias("position", "piece"))
    body = F.regexp_replace(F.split_part("piece", F.lit("\u0002"), F.lit(2)), rf"(?is)</(?:{names})\s*>.*$", "")
    text = F.regexp_replace(body, r"<[^>]*>", " ")
    for reference, character in ENTITIES:
        text = F.replace(text, F.lit(reference), F.lit(character))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return rows.select(key, F.lower(F.split_part("piece", F.lit("\u0002"), F.lit(1))).alias("tag"), "position", text.alias("text"))
