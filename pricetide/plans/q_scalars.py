"""Scalar functions and row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fuzzy as Z
from ..functions import hashing as H
from ..functions import numbers as N
from ..functions import text as T
from ..operators import clean, explore, resolve
from ..operators.ordered import Quantile, aggregate
from ..sources import records
from . import bindings as B
from .registry import query

# ---------------------------------------------------------------- text
FOLD = r"trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\x00-\x7F]', '', 'g')), '\s+', ' ', 'g'))"


@query("normalize_text", f"SELECT doc_id, {FOLD.format('text')} AS folded FROM documents")
def normalize_text(spark, sf):
    return B.spread_table(spark, sf, "documents", "doc_id").select("doc_id", T.fold_text(F.col("text")).alias("folded"))


RAW_NUMBER = "CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'n/d' WHEN 3 THEN NULL ELSE CAST(l_extendedprice AS VARCHAR) END"


@query(
    "safe_numbers",
    f"""WITH r AS (SELECT {B.ROW_ID} AS row_id, {RAW_NUMBER} AS raw FROM lineitem)
    SELECT row_id, coalesce(try_cast(nullif(raw, '') AS DOUBLE), 0.0) AS as_double, CAST(trunc(coalesce(try_cast(nullif(raw, '') AS DOUBLE), 0.0)) AS INTEGER) AS as_int
    FROM r""",
)
def safe_numbers(spark, sf):
    line = F.col("l_linenumber")
    raw = F.when(line == 1, "").when(line == 2, "n/d").when(line != 3, B.text("l_extendedprice"))
    row_id = F.concat_ws("-", *[B.text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    rows = B.table(spark, sf, "lineitem").select(row_id.alias("row_id"), raw.alias("raw"))
    return rows.select("row_id", N.safe_double(F.col("raw")).alias("as_double"), N.safe_int(F.col("raw")).alias("as_int"))


KIND_CATALOG = T.KIND_CATALOG
ALIASES = [alias for _, _, aliases in KIND_CATALOG for alias in aliases]
ALIAS_LIST = "[" + ", ".join(f"'{a}'" for a in ALIASES) + "]"
# Every part carries one of the aliases, upper-cased for odd parts, with its own name behind it.
RAW_KIND = f"CASE WHEN p_partkey % 2 = 1 THEN upper({ALIAS_LIST}[p_partkey % {len(ALIASES)} + 1]) ELSE {ALIAS_LIST}[p_partkey % {len(ALIASES)} + 1] || '  ' END"


def _raw_kinds(spark, sf):
    pick = F.element_at(F.array(*[F.lit(a) for a in ALIASES]), (F.col("p_partkey") % len(ALIASES) + 1).cast("int"))
    raw = F.when(F.col("p_partkey") % 2 == 1, F.upper(pick)).otherwise(F.concat(pick, F.lit("  ")))
    return B.table(spark, sf, "part").select("p_partkey", "p_brand", raw.alias("raw"))


def _kind_sql(land: str) -> str:
    folded = FOLD.format("raw")
    return f"""WITH r AS (SELECT p_partkey, {RAW_KIND} AS raw FROM part), f AS (SELECT *, {folded} AS t FROM r)
    SELECT p_partkey, raw, CASE WHEN t = '' THEN '' WHEN t LIKE '%lanc%' THEN 'Lançamento'
        WHEN t LIKE '%comercial%' OR t = 'sala' OR t LIKE '%sala/%' THEN 'Comercial'
        WHEN t LIKE '%studio%' OR t LIKE '%loft%' OR t LIKE '%flat%' THEN 'Studio'
        WHEN t LIKE '%cobert%' OR t LIKE '%penthouse%' THEN 'Cobertura' WHEN t LIKE '%apart%' THEN 'Apartamento'
        WHEN t LIKE '%sobrado%' OR t LIKE '%geminad%' OR t LIKE '%casa%' THEN 'Casa'
        WHEN t LIKE '%terreno%' OR t LIKE '%lote%' THEN 'Terreno'
        WHEN {land} THEN 'Chácara' WHEN t LIKE '%predio%' THEN 'Prédio' ELSE 'Outros' END AS kind FROM f"""


@query("canonical_type", _kind_sql("t LIKE '%chacara%' OR t LIKE '%sitio%' OR t LIKE '%area de terra%' OR t LIKE '%area rural%' OR t = 'area'"))
def canonical_type(spark, sf):
    return _raw_kinds(spark, sf).select("p_partkey", "raw", T.canonical_kind(F.col("raw")).alias("kind"))


@query("canonical_type_narrow", _kind_sql("t LIKE '%chacara%' OR t LIKE '%sitio%' OR t LIKE '%area rural%' OR t = 'area'"))
def canonical_type_narrow(spark, sf):
    return _raw_kinds(spark, sf).select("p_partkey", "raw", T.canonical_kind(F.col("raw"), T.KIND_RULES_NARROW).alias("kind"))


CATALOG_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{about}' AS description, '{alias}' AS alias" for kind, about, aliases in KIND_CATALOG for alias in aliases
)


@query(
    "type_catalog",
    f"""WITH c AS ({CATALOG_SQL}), r AS (SELECT {FOLD.format(RAW_KIND)} AS t FROM part),
    n AS (SELECT t, count(*) AS listings FROM r GROUP BY 1)
    SELECT c.kind, c.description, c.alias, coalesce(n.listings, 0) AS listings FROM c LEFT JOIN n ON n.t = {FOLD.format('c.alias')}""",
)
def type_catalog(spark, sf):
    """The catalogue by alias, with how many listings use each alias."""
    return explore.type_usage(_raw_kinds(spark, sf), "raw")


@query(
    "alias_map",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Presidente Medici' WHEN p_partkey % 3 = 1 THEN '' ELSE p_brand END AS district,
       CASE WHEN p_partkey % 3 = 0 THEN 'presidente medice' WHEN p_partkey % 3 = 1 THEN 'sem bairro' ELSE lower(p_brand) END AS canonical FROM part""",
)
def alias_map(spark, sf):
    key = F.col("p_partkey") % 3
    raw = F.when(key == 0, "Presidente  Médice").when(key == 1, "").otherwise(F.col("p_brand"))
    rows = B.table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", T.unify_district(F.col("raw")).alias("district"), T.canonical_district(F.col("raw")).alias("canonical"))


@query(
    "canonical_address",
    """SELECT p_partkey, 'rua ' || p_name || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ', ' || p_size END AS address, 'rua ' || p_name AS street FROM part""",
)
def canonical_address(spark, sf):
    number = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit(", "), B.text("p_size")))
    tail = F.element_at(F.array(F.lit(" - Chapecó / SC"), F.lit(", CEP 89801-000"), F.lit(" -"), F.lit(" SC ")), (F.col("p_partkey") % 4 + 1).cast("int"))
    raw = F.concat(F.lit(" Rua  "), F.initcap("p_name"), number, tail)
    rows = B.table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    return rows.select(
        "p_partkey", T.canonical_address(F.col("raw")).alias("address"), T.canonical_address(F.col("raw"), street_only=True).alias("street")
    )


@query(
    "group_keys",
    f"WITH {B.KEYS} SELECT vertex, key FROM keys",
)
def group_keys(spark, sf):
    rows = B.entities(spark, sf)
    return rows.select(F.col("id").alias("vertex"), F.explode(resolve.group_keys()).alias("key"))


@query(
    "source_prefix",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE substr(p_type, 1, 1) END AS prefix,
       CASE WHEN p_partkey % 7 = 0 THEN 'X' || p_partkey WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE substr(p_type, 1, 1) || '-' || p_partkey END AS code FROM part""",
)
def source_prefix(spark, sf):
    key = B.text("p_partkey")
    rows = B.table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 5 == 0, key).otherwise(F.concat(F.substring("p_type", 1, 1), F.lit("-"), key)).alias("id"),
        F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" X"), key)).when(F.col("p_partkey") % 2 == 0, F.lit("")).alias("code"),
    )
    return rows.select("p_partkey", T.source_prefix(F.col("id")).alias("prefix"), T.listing_code(F.col("code"), F.col("id")).alias("code"))


# ---------------------------------------------------------------- dates
@query(
    "parse_datetime",
    """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 IN (1, 2) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000000'
       WHEN event_id % 6 = 3 THEN strftime(ts, '%Y-%m-%d 00:00:00.000000') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS parsed FROM events""",
)
def parse_datetime(spark, sf):
    """Every notation the sources use, one per row in turn."""
    ts, key = F.col("ts"), F.col("event_id") % 6
    raw = (
        F.when(key == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(key == 1, F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
        .when(key == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(key == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(key == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .otherwise(F.date_format(ts, "dd.MM.yy"))
    )
    rows = B.table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.date_format(D.parse_datetime(F.col("raw")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@query(
    "collection_date",
    """SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE) + 1 WHEN 2 THEN CAST(ts AS DATE) + 2 ELSE CAST(ts AS DATE) + 2 END, '%Y-%m-%d') AS day FROM events""",
)
def collection_date(spark, sf):
    """Date in the file name; an impossible one falls through to the update, then the insert date."""
    key = F.col("event_id") % 4
    name = F.when(key == 0, F.concat(F.lit("listings_"), F.date_format("ts", "dd_MM_yyyy"), F.lit(".db"))).when(key == 3, F.lit("listings_31_02_2024.db")).otherwise(F.lit("manual.db"))
    updated = F.when(key == 1, F.date_format(F.date_add("ts", 1), "yyyy-MM-dd"))
    inserted = F.date_format(F.date_add("ts", 2), "yyyy-MM-dd'T'HH:mm:ss")
    rows = B.table(spark, sf, "events").select("event_id", name.alias("n"), updated.alias("u"), inserted.alias("i"))
    return rows.select("event_id", D.collection_date(F.col("n"), F.col("u"), F.col("i")).cast("string").alias("day"))


# ---------------------------------------------------------------- hashes
_ID_SQL = """SELECT p_partkey, 'NR-' || substr({digest}('["chapeco","' || p_name || '","Casa",' || p_size || '.0,' || (p_size % 5 + 1) || ',2,1,["A-' || p_partkey || '"]]'), 1, 16) AS id FROM part"""


def _group_id(spark, sf, digest):
    parts = [
        H.json_text(F.lit("chapeco")),
        H.json_text(F.col("p_name")),
        H.json_text(F.lit("Casa")),
        F.format_string("%.1f", F.col("p_size").cast("double")),
        (F.col("p_size") % 5 + 1).cast("string"),
        F.lit("2"),
        F.lit("1"),
        F.to_json(F.array(F.concat(F.lit("A-"), B.text("p_partkey")))),
    ]
    return B.table(spark, sf, "part").select("p_partkey", H.group_id(parts, digest=digest).alias("id"))


@query("group_id", _ID_SQL.format(digest="sha1"))
def group_id(spark, sf):
    return _group_id(spark, sf, "sha1")


@query("group_id_md5", _ID_SQL.format(digest="md5"))
def group_id_md5(spark, sf):
    return _group_id(spark, sf, "md5")


@query(
    "hamming_distance",
    """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings)
    SELECT l.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(l.b[i] - r.b[i]))) AS INTEGER) AS distance
    FROM b l JOIN b r ON r.vec_id = l.vec_id + 1""",
)
def hamming_distance(spark, sf):
    """Distance of each signature to the next one."""
    hashed = B.table(spark, sf, "embeddings").select("vec_id", H.bits_to_hex(F.transform("embedding", lambda x: x > 0)).alias("h"))
    following = hashed.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("next"))
    return hashed.join(following, "vec_id").select("vec_id", H.hamming_distance(F.col("h"), F.col("next")).alias("distance"))


# ---------------------------------------------------------------- numbers
@query(
    "parse_money",
    """SELECT p_partkey, round(p_retailprice * 1000, 2) AS first, round(p_retailprice * 1000, 2) AS labelled, round(p_retailprice * 1000, 2) AS strip,
       round(p_retailprice * 1000, 2) AS digits, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size * 1000.0 ELSE p_size * 1000000.0 END AS DOUBLE) AS words,
       CAST(p_size * 1000.0 AS DOUBLE) AS words_strict FROM part""",
)
def parse_money(spark, sf):
    written = F.concat(F.lit("R$ "), F.translate(F.format_number(F.col("p_retailprice") * 1000, 2), ",.", ".,"))
    words = F.concat(F.lit("R$ "), B.text("p_size"), F.when(F.col("p_partkey") % 2 == 0, " mil").otherwise(" milhões"))
    rows = B.table(spark, sf, "part").select("p_partkey", written.alias("w"), words.alias("m"))
    styles = [F.round(N.parse_money(F.col("w"), s), 2).alias(s) for s in ("first", "labelled", "strip", "digits")]
    return rows.select(
        "p_partkey",
        *styles,
        F.round(N.parse_money(F.col("m"), "words"), 2).alias("words"),
        F.round(N.parse_money(F.col("m"), "words", strict=True), 2).alias("words_strict"),
    )


@query(
    "parse_number",
    """SELECT p_partkey, round(p_retailprice * 1000, 2) AS many_dots, p_retailprice AS comma, CAST(p_size AS INTEGER) AS first_int,
       CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS plain FROM part""",
)
def parse_number(spark, sf):
    dotted = F.concat(F.translate(F.format_number(F.col("p_retailprice") * 1000, 2), ",", "."), F.lit(" m²"))
    comma = F.translate(B.text("p_retailprice"), ".", ",")
    first = F.concat(F.lit("ap. "), B.text("p_size"), F.lit(" / 12"))
    plain = F.when(F.col("p_partkey") % 2 == 0, comma).otherwise(F.lit("sob consulta"))
    rows = B.table(spark, sf, "part").select("p_partkey", dotted.alias("d"), comma.alias("c"), first.alias("f"), plain.alias("p"))
    return rows.select(
        "p_partkey",
        F.round(N.parse_decimal(F.col("d")), 2).alias("many_dots"),
        N.parse_comma_float(F.col("c")).alias("comma"),
        N.first_int(F.col("f")).alias("first_int"),
        N.parse_comma_float(F.col("p")).alias("plain"),
    )


@query(
    "parse_rooms",
    """SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size + 2 WHEN 2 THEN 1 + p_size WHEN 3 THEN p_size WHEN 4 THEN 1 ELSE p_size END AS INTEGER) AS rooms,
       CAST(CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 5 THEN p_size END AS INTEGER) AS labelled FROM part""",
)
def parse_rooms(spark, sf):
    size = B.text("p_size")
    forms = F.array(
        size,
        F.concat(size, F.lit(" + 2 Suítes")),
        F.concat(F.lit("+"), size, F.lit(" suíte")),
        F.concat(size, F.lit(" suite")),
        F.lit("suíte master"),
        F.concat(size, F.lit("  quartos e 1 sala")),
    )
    rows = B.table(spark, sf, "part").select("p_partkey", F.element_at(forms, (F.col("p_partkey") % 6 + 1).cast("int")).alias("raw"))
    return rows.select("p_partkey", N.parse_rooms(F.col("raw")).alias("rooms"), N.labelled_rooms(F.col("raw")).alias("labelled"))


@query(
    "format_address",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'Rua ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ', ' || p_size ELSE '' END
       || CASE WHEN p_partkey % 3 = 0 THEN ' - ' || p_brand ELSE '' END END AS address FROM part""",
)
def format_address(spark, sf):
    key = F.col("p_partkey")
    rows = B.table(spark, sf, "part").select(
        "p_partkey",
        F.when(key % 5 == 0, "***").otherwise(F.concat(F.lit(" Rua  "), F.col("p_name"))).alias("s"),
        F.when(key % 2 == 0, B.text("p_size")).otherwise(F.lit("x/x")).alias("n"),
        F.when(key % 3 == 0, F.col("p_brand")).when(key % 3 == 1, F.lit("")).alias("c"),
    )
    return rows.select("p_partkey", T.format_address(F.col("s"), F.col("n"), F.col("c")).alias("address"))


@query(
    "price_per_area",
    """WITH r AS (SELECT p_partkey, p_retailprice AS price, CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS private,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size + 5.0 END AS total FROM part)
    SELECT p_partkey, CAST(coalesce(nullif(total, 0), nullif(private, 0), total) AS DOUBLE) AS area_total, CAST(coalesce(nullif(private, 0), nullif(total, 0), private) AS DOUBLE) AS area_private,
           CAST(price / coalesce(nullif(private, 0), nullif(total, 0)) AS DOUBLE) AS price_m2 FROM r""",
)
def price_per_area(spark, sf):
    private = F.when(F.col("p_partkey") % 2 == 0, 0.0).otherwise(F.col("p_size").cast("double"))
    total = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") + 5.0)
    return B.table(spark, sf, "part").select(
        "p_partkey",
        N.backfill(total, private).alias("area_total"),
        N.backfill(private, total).alias("area_private"),
        N.price_per_area(F.col("p_retailprice"), private, total).alias("price_m2"),
    )


@query(
    "relative_difference",
    """SELECT p_partkey, CAST(CASE WHEN greatest(p_size * 20.0, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_retailprice END) > 0 THEN
       abs(p_size * 20.0 - CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_retailprice END) / greatest(p_size * 20.0, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_retailprice END) ELSE 0 END AS DOUBLE) AS difference FROM part""",
)
def relative_difference(spark, sf):
    other = F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice"))
    return B.table(spark, sf, "part").select("p_partkey", N.relative_difference(F.col("p_size") * 20.0, other).alias("difference"))


@query("safe_expm1", "SELECT p_partkey, round(exp(greatest(0, least(21, p_size - 10))) - 1, 2) AS value FROM part")
def safe_expm1(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", F.round(N.safe_expm1((F.col("p_size") - 10).cast("double")), 2).alias("value"))


@query(
    "rate_conversion",
    "SELECT p_partkey, round(100 * (exp(12 * p_size / 1000.0) - 1), 6) AS annual_pct, round(ln(1 + p_size / 100.0) / 12, 9) AS monthly FROM part",
)
def rate_conversion(spark, sf):
    return B.table(spark, sf, "part").select(
        "p_partkey",
        F.round(N.annual_pct(F.col("p_size") / 1000.0), 6).alias("annual_pct"),
        F.round(N.monthly_log(F.col("p_size").cast("double")), 9).alias("monthly"),
    )


@query(
    "direction_class",
    f"WITH {B.CHANGES} SELECT code, month_n, CASE WHEN dlog > 0.005 THEN 1 WHEN dlog < -0.005 THEN -1 ELSE 0 END AS direction FROM changes",
)
def direction_class(spark, sf):
    from ..operators.panel import monthly_changes

    return monthly_changes(B.panel(spark, sf)).select("code", "month_n", N.direction(F.col("dlog")).alias("direction"))


@query(
    "format_currency",
    """SELECT o_orderkey, 'R$ ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS price,
       (CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END) || translate(format('{:,.2f}', o_custkey / 8.0), ',.', '.,') || '%' AS change,
       ['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][month(o_orderdate)] || '/' || year(o_orderdate) AS month FROM orders WHERE o_custkey > 0""",
)
def format_currency(spark, sf):
    signed = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(-F.col("o_custkey")) / 8.0
    orders = B.table(spark, sf, "orders").filter("o_custkey > 0")
    return orders.select(
        "o_orderkey",
        T.format_currency(F.col("o_totalprice")).alias("price"),
        T.format_percent(signed).alias("change"),
        T.format_month(F.col("o_orderdate")).alias("month"),
    )


@query(
    "slug_title",
    """SELECT p_partkey, 'Brand ' || substr(p_brand, 7) AS title, CASE WHEN p_partkey % 3 = 0 THEN '(sem bairro)' ELSE upper(p_type[1]) || lower(p_type[2:]) END AS label FROM part""",
)
def slug_title(spark, sf):
    slug = F.concat(F.lit("bairro-"), F.lower(F.translate("p_brand", "#", "-")))
    label = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.lower("p_type"))
    return B.table(spark, sf, "part").select("p_partkey", T.slug_title(slug, "bairro-").alias("title"), T.district_label(label).alias("label"))


def _trapezoid_sql(x: str, shape) -> str:
    a, b, c, d = shape
    up = "1.0" if b == -Z.OPEN else f"({x} - ({a})) / ({b} - ({a}))"
    down = "1.0" if c == Z.OPEN else f"(({d}) - {x}) / ({d} - ({c}))"
    return f"greatest(0.0, least(1.0, {up}, {down}))"


@query(
    "fuzzy_membership",
    "WITH r AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 25 AS district_price, CAST(p_size AS DOUBLE) / 20 AS area, CAST(p_size AS DOUBLE) / 10 - 2.5 AS trend FROM part) SELECT p_partkey, "
    + ", ".join(f"round({_trapezoid_sql(n, s)}, 9) AS {n}_{t}" for n, terms in Z.INPUT_SETS.items() for t, s in terms.items())
    + " FROM r",
)
def fuzzy_membership(spark, sf):
    size = F.col("p_size").cast("double")
    inputs = {"district_price": size / 25, "area": size / 20, "trend": size / 10 - 2.5}
    degrees = Z.memberships(inputs)
    return B.table(spark, sf, "part").select("p_partkey", *[F.round(d, 9).alias(f"{n}_{t}") for (n, t), d in degrees.items()])


# ---------------------------------------------------------------- predicates
@query("type_subset", f"WITH {B.OBS} SELECT kind, count(*) AS n, round(sum(price), 2) AS price_sum FROM obs WHERE kind IN ('ECONOMY', 'PROMO') GROUP BY 1")
def type_subset(spark, sf):
    kept = B.observations(spark, sf).filter(F.col("kind").isin("ECONOMY", "PROMO"))
    return kept.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price_sum"))


@query(
    "plausible_band",
    f"""WITH {B.OBS} SELECT district, kind, count(*) AS n, round(avg(price / area), 6) AS mean_price_m2 FROM obs
    WHERE price BETWEEN 50000 AND 20000000 AND area BETWEEN 20 AND 2000 GROUP BY 1, 2""",
)
def plausible_band(spark, sf):
    kept = explore.plausible(B.observations(spark, sf).withColumn("area_ref", F.col("area")))
    return kept.groupBy("district", "kind").agg(F.count("*").alias("n"), F.round(F.avg("price_m2"), 6).alias("mean_price_m2"))


@query(
    "ignored_types",
    f"""WITH r AS (SELECT p_partkey, {RAW_KIND} AS raw FROM part)
    SELECT p_partkey, raw FROM r WHERE trim(lower(strip_accents(raw))) NOT IN ('barracao', 'barraco', 'sala comercial', 'sala/conjunto', 'sala-comercial', 'sala')""",
)
def ignored_types(spark, sf):
    rows = _raw_kinds(spark, sf).select("p_partkey", F.col("raw").alias("kind"))
    return records.drop_ignored(rows).withColumnRenamed("kind", "raw")


@query(
    "dataset_slice",
    f"""WITH {B.OBS}, s AS (
        SELECT kind, price, price / area AS price_m2 FROM obs
        WHERE kind IN ('ECONOMY', 'LARGE') AND district IN ('Brand#1', 'Brand#2', 'Brand#3') AND price >= 20000 AND price <= 90000)
    SELECT kind, count(*) AS n, round(quantile_cont(price, 0.5), 4) AS median_price, round(quantile_cont(price_m2, 0.5), 4) AS median_price_m2,
           (SELECT CAST((floor(quantile_cont(price, 0.99) / 50000) + 1) * 50000 AS DOUBLE) FROM obs) AS ceiling
    FROM s GROUP BY 1""",
)
def dataset_slice(spark, sf):
    """Interactive filter with the medians of the slice and the top of the price control."""
    obs = B.observations(spark, sf)
    part = explore.dataset_slice(obs, ["ECONOMY", "LARGE"], ["Brand#1", "Brand#2", "Brand#3"], 20_000.0, 90_000.0)
    quantiles = [Quantile("median_price", F.col("price")), Quantile("median_price_m2", F.col("price") / F.col("area"))]
    out = aggregate(part, ["kind"], [F.count("*").alias("n")], quantiles)
    out = out.withColumns({q.name: F.round(q.name, 4) for q in quantiles})
    return out.withColumn("ceiling", explore.slider_ceiling(obs).scalar())


@query(
    "completeness",
    f"""WITH {B.OBS}, c AS (
        SELECT 100.0 * avg(CASE WHEN parking = 0 THEN 1.0 ELSE 0.0 END) AS parking, 100.0 * avg(CASE WHEN area < 10 THEN 1.0 ELSE 0.0 END) AS area,
               100.0 * avg(CASE WHEN district = 'Brand#7' THEN 1.0 ELSE 0.0 END) AS district FROM obs)
    SELECT field, round(missing_pct, 6) AS missing_pct FROM (UNPIVOT c ON parking, area, district INTO NAME field VALUE missing_pct)""",
)
def completeness(spark, sf):
    obs = B.observations(spark, sf)
    tests = {"parking": F.col("parking") == 0, "area": F.col("area") < 10, "district": F.col("district") == "Brand#7"}
    return explore.completeness(obs, tests).withColumn("missing_pct", F.round("missing_pct", 6))


WARN_SQL = B.SPLIT + """,
tr AS (SELECT * FROM split WHERE part = 'train'),
rare AS (SELECT kind, district FROM tr GROUP BY 1, 2 HAVING count(*) < 320),
bounds AS (SELECT kind, quantile_cont(area, 0.02) AS lo, quantile_cont(area, 0.98) AS hi, quantile_cont(rooms, 0.02) AS rlo, quantile_cont(rooms, 0.98) AS rhi FROM tr WHERE true GROUP BY 1)"""


@query(
    "input_warnings",
    f"""WITH {WARN_SQL}
    SELECT s.row_id, concat_ws(';', CASE WHEN s.area > 0 AND s.area > b.hi THEN 'area_total:above' WHEN s.area > 0 AND s.area < b.lo THEN 'area_total:below' END,
        CASE WHEN s.rooms > 0 AND s.rooms > b.rhi THEN 'rooms:above' WHEN s.rooms > 0 AND s.rooms < b.rlo THEN 'rooms:below' END,
        CASE WHEN s.l_linenumber % 2 = 0 THEN 'area_private:over_total' END,
        CASE WHEN r.kind IS NOT NULL THEN 'district:rare' END) AS warnings
    FROM split s LEFT JOIN bounds b ON b.kind = s.kind LEFT JOIN rare r ON r.kind = s.kind AND r.district = s.district WHERE s.part = 'test'""",
)
def input_warnings(spark, sf):
    """Held-out rows against bounds and rare districts learned on the train part."""
    row = F.concat_ws("-", *[B.text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    obs = B.observations(spark, sf).withColumn("row_id", row).withColumnRenamed("area", "area_total")
    obs = obs.withColumn("area_private", F.when(F.col("l_linenumber") % 2 == 0, F.col("area_total") + 1).otherwise(F.col("area_total")))
    split = clean.holdout_split(obs, "row_id")
    train, test = split.filter("part = 'train'"), split.filter("part = 'test'")
    columns = ("area_total", "rooms")
    rare = clean.learn_rare(train, "district", ["kind"], 320)
    bounds = clean.learn_clip(train, columns, ["kind"])
    out = clean.input_warnings(test, rare, bounds, ["kind"], columns)
    notes = F.transform("warnings", lambda w: F.concat_ws(":", w["field"], w["direction"]))
    return out.select("row_id", F.array_join(notes, ";").alias("warnings"))
