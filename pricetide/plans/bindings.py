"""The driver tables in the roles the operators expect, for Spark and as SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.hashing import bits_to_hex
from ..session import checkpoint_dir, spread, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows are costly to process, on every core even when it is one file."""
    rows = table(spark, sf_dir, name)
    return spread(rows, rows, key)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, where every executor can write."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text(col: str) -> Column:
    return F.col(col).cast("string")


# ---------------------------------------------------------------- listing observations
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as one observation of a listing (the part), seen on its ship date."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(
        F.col("l_partkey").cast("string").alias("code"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("area"),
        F.col("p_brand").alias("district"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("rooms"),
        F.col("l_linenumber").alias("baths"),
        (F.col("l_suppkey") % 4).cast("int").alias("parking"),
        F.col("l_suppkey").cast("string").alias("source"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


def spread_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations on every core, for costly work on each of them."""
    return spread(observations(spark, sf_dir), table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


OBS = """obs AS (
    SELECT CAST(l_partkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS price,
           l_quantity AS area, p_brand AS district, p_type AS kind, p_size AS rooms, l_linenumber AS baths,
           CAST(l_suppkey % 4 AS INTEGER) AS parking, CAST(l_suppkey AS VARCHAR) AS source,
           l_orderkey, l_linenumber, l_partkey, l_suppkey
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices of each part over time."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("code"),
        F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing features of each part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("code"),
        F.col("p_brand").alias("district"),
        F.col("p_type").alias("kind"),
        F.col("p_size").cast("double").alias("area_ref"),
        (F.col("p_size") % 5 + 1).cast("int").alias("rooms"),
        (F.col("p_size") % 3 + 1).cast("int").alias("baths"),
        (F.col("p_partkey") % 4).cast("int").alias("parking"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.panel import monthly_panel

    return monthly_panel(history(spark, sf_dir), features(spark, sf_dir))


def stored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a table, for jobs that read it more than once."""
    return stored(panel(spark, sf_dir))


FEATURES = """features AS (
    SELECT CAST(p_partkey AS VARCHAR) AS code, p_brand AS district, p_type AS kind,
           CAST(p_size AS DOUBLE) AS area_ref, CAST(p_size % 5 + 1 AS INTEGER) AS rooms,
           CAST(p_size % 3 + 1 AS INTEGER) AS baths, CAST(p_partkey % 4 AS INTEGER) AS parking
    FROM part)"""

PANEL = (
    FEATURES
    + """,
medians AS (
    SELECT CAST(l_partkey AS VARCHAR) AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
           quantile_cont(l_extendedprice / l_quantity, 0.5) AS price
    FROM lineitem WHERE l_extendedprice / l_quantity > 0 GROUP BY 1, 2),
panel AS (
    SELECT m.code, m.month, CAST(year(m.month) * 12 + month(m.month) AS INTEGER) AS month_n, m.price,
           f.district, f.kind, f.area_ref, f.rooms, f.baths, f.parking, m.price / f.area_ref AS price_m2
    FROM medians m JOIN features f ON m.code = f.code WHERE f.area_ref > 0)"""
)

STEPS = (
    PANEL
    + """,
steps AS (
    SELECT *, month_n - lag(month_n) OVER w AS gap, ln(price / lag(price) OVER w) AS dlog
    FROM panel WINDOW w AS (PARTITION BY code ORDER BY month_n))"""
)
CHANGES = STEPS + """,
changes AS (SELECT * FROM steps WHERE gap = 1 AND abs(dlog) <= ln(1.5))"""
REPEATS = STEPS + """,
repeats AS (SELECT * FROM steps WHERE gap > 0 AND abs(dlog) <= ln(1.5) * gap)"""

# Two pairs are enough for a segment here: no segment reaches the default of eight.
MIN_PAIRS = 2
INDEX = CHANGES + f""",
seg_index AS (
    SELECT district, kind, month, avg(dlog) AS mean_dlog, count(*) AS pairs
    FROM changes GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_PAIRS}),
kind_index AS (SELECT kind, month, avg(dlog) AS mean_dlog, count(*) AS pairs FROM changes GROUP BY 1, 2),
all_index AS (SELECT month, avg(dlog) AS mean_dlog, count(*) AS pairs FROM changes GROUP BY 1)"""

SECTIONS = """sec_seg AS (
    SELECT district, kind, month, quantile_cont(price_m2, 0.5) AS median_price_m2, count(*) AS n
    FROM panel GROUP BY 1, 2, 3),
sec_kind AS (
    SELECT kind, month, quantile_cont(price_m2, 0.5) AS median_price_m2, count(*) AS n FROM panel GROUP BY 1, 2)"""

PANEL_FEATURES = INDEX + ",\n" + SECTIONS + """,
pf AS (
    SELECT s.*, s.month_n - min(s.month_n) OVER (PARTITION BY s.code) AS months_listed,
           CASE WHEN s.gap = 1 THEN greatest(-ln(1.5), least(ln(1.5), s.dlog)) ELSE 0.0 END AS previous_change,
           coalesce(s.price_m2 / coalesce(q.median_price_m2, k.median_price_m2), 1.0) AS relative_price,
           ln(greatest(s.price_m2, 1.0)) AS log_price_m2,
           coalesce(a.mean_dlog, b.mean_dlog, c.mean_dlog, 0.0) AS segment_momentum,
           coalesce(b.mean_dlog, c.mean_dlog, 0.0) AS kind_momentum
    FROM steps s
    LEFT JOIN sec_seg q ON q.district = s.district AND q.kind = s.kind AND q.month = s.month AND q.n >= 5
    LEFT JOIN sec_kind k ON k.kind = s.kind AND k.month = s.month
    LEFT JOIN seg_index a ON a.district = s.district AND a.kind = s.kind AND a.month = s.month
    LEFT JOIN kind_index b ON b.kind = s.kind AND b.month = s.month
    LEFT JOIN all_index c ON c.month = s.month)"""


def pairs_sql(horizon: int) -> str:
    return PANEL_FEATURES + f""",
pairs AS (
    SELECT f.*, p.price AS future_price, ln(p.price / f.price) AS target,
           CAST(f.month + INTERVAL {horizon} MONTH AS DATE) AS target_month
    FROM pf f JOIN panel p ON p.code = f.code AND p.month_n = f.month_n + {horizon}
    WHERE abs(ln(p.price / f.price)) <= ln(1.5) * {max(1, horizon)})"""


def pairs(spark: SparkSession, sf_dir: str, horizon: int = 1) -> DataFrame:
    from ..operators import panel as P

    frame = stored_panel(spark, sf_dir)
    index = stored(P.repeat_index(P.monthly_changes(frame), MIN_PAIRS))
    return P.horizon_pairs(P.panel_features(frame, index), horizon, prices=frame)


# ---------------------------------------------------------------- predictions without a model
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out observations priced by the train mean of their segment."""
    from ..operators.clean import holdout_split
    from ..operators.panel import segment_mean_baseline

    obs = observations(spark, sf_dir)
    row = F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"))
    split = holdout_split(obs.withColumn("row_id", row), "row_id")
    test = segment_mean_baseline(split.filter("part = 'train'"), split.filter("part = 'test'"), "price", "y_pred")
    return test.withColumnRenamed("price", "y")


def uniform_sql(*parts: str, place: str = "0") -> str:
    """The md5 draw of ``functions.hashing.uniform``, or draw ``place`` of ``hash_draws``."""
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({joined}), CAST(8 * ({place}) + 1 AS BIGINT), 8) AS UBIGINT) / 4294967296.0)"


def half_up(expr: str, digits: int) -> str:
    """Rounding of the shortest decimal text, half away from zero, as Spark rounds doubles."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 15)), {digits}) AS DOUBLE)"


ROW_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
SPLIT = OBS + f""",
split AS (
    SELECT *, {ROW_ID} AS row_id,
           CASE WHEN {uniform_sql("(" + ROW_ID + ")", "'42'")} < 0.2 THEN 'test' ELSE 'train' END AS part
    FROM obs)"""
PREDICTIONS = SPLIT + """,
m1 AS (SELECT district, kind, avg(price) AS v FROM split WHERE part = 'train' GROUP BY 1, 2),
m2 AS (SELECT kind, avg(price) AS v FROM split WHERE part = 'train' GROUP BY 1),
m3 AS (SELECT avg(price) AS v FROM split WHERE part = 'train'),
pred AS (
    SELECT s.* EXCLUDE (price), s.price AS y, coalesce(m1.v, m2.v, (SELECT v FROM m3)) AS y_pred
    FROM split s LEFT JOIN m1 ON m1.district = s.district AND m1.kind = s.kind
    LEFT JOIN m2 ON m2.kind = s.kind WHERE s.part = 'test')"""


# ---------------------------------------------------------------- monthly series
def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, month, total, orders): order value and count by priority and month."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    return orders.groupBy(
        F.col("o_orderpriority").alias("series"), month_start(F.col("o_orderdate").cast("date")).alias("month")
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("orders"))


MONTHLY = """monthly AS (
    SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           round(sum(o_totalprice), 2) AS total, count(*) AS orders
    FROM orders GROUP BY 1, 2)"""

# Order totals move far more than prices; a twentieth of the change gives usual monthly rates.
DAMPING = 20.0


def changes_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly percentage change of each series, damped to the size of a price index."""
    from ..operators.index import pct_change

    moved = pct_change(monthly_orders(spark, sf_dir), ["series"], "total", "change_pct")
    return moved.withColumn("value", F.col("change_pct") / DAMPING)


SERIES = MONTHLY + f""",
moved AS (
    SELECT series, month, total, orders, 100.0 * (total / lag(total) OVER (PARTITION BY series ORDER BY month) - 1) AS change_pct
    FROM monthly),
changes_m AS (SELECT *, change_pct / {DAMPING} AS value FROM moved WHERE change_pct IS NOT NULL)"""


def market_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index (month, index_level) blended from all order priorities."""
    from ..operators.index import index_level

    changes = changes_by_series(spark, sf_dir).groupBy("month").agg(F.avg("value").alias("value"))
    return index_level(changes.withColumn("series", F.lit("market")), ["series"]).select("month", "value", "index_level")


LEVELS = SERIES + """,
market AS (SELECT month, avg(value) AS value FROM changes_m GROUP BY 1),
levels AS (SELECT month, value, exp(sum(ln(1 + value / 100.0)) OVER (ORDER BY month)) AS index_level FROM market)"""


# ---------------------------------------------------------------- entities
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings that may describe the same property, on every core: their texts are costly to fold."""
    return spread_table(spark, sf_dir, "part", "p_partkey").select(
        F.concat(F.substring("p_type", 1, 1), F.lit("-"), text("p_partkey")).alias("id"),
        F.col("p_retailprice").alias("price"),
        F.col("p_brand").alias("district"),
        F.concat(F.lit("Rua "), F.col("p_name"), F.lit(", "), text("p_size")).alias("address"),
        F.lit(None).cast("string").alias("image_url"),
        F.lit("Chapecó").alias("city"),
        F.when(F.col("p_partkey") % 2 == 0, "Casa").otherwise("Apartamento").alias("kind"),
        F.col("p_size").cast("double").alias("area_total"),
        F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(F.col("p_size").cast("double")).alias("area_private"),
        (F.col("p_size") % 5 + 1).cast("int").alias("rooms"),
        F.lit(2).alias("baths"),
        F.lit(1).alias("parking"),
        F.concat(F.lit("1998-01-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")).alias("registered_at"),
        F.concat(F.lit("1999-01-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")).alias("inserted_at"),
    )


ENTITIES = """entities AS (
    SELECT substr(p_type, 1, 1) || '-' || p_partkey AS id, p_retailprice AS price, p_brand AS district,
           'Rua ' || p_name || ', ' || p_size AS address, 'Chapecó' AS city,
           CASE WHEN p_partkey % 2 = 0 THEN 'Casa' ELSE 'Apartamento' END AS kind,
           CAST(p_size AS DOUBLE) AS area_total,
           CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS area_private,
           CAST(p_size % 5 + 1 AS INTEGER) AS rooms, 2 AS baths, 1 AS parking,
           '1998-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS registered_at,
           '1999-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS inserted_at,
           p_name, p_size
    FROM part)"""

# Keys written out by hand: district key, full address key, street key.
KEYS = ENTITIES + """,
based AS (
    SELECT id, 'chapeco|' || kind || '|' || CAST(area_total AS VARCHAR) || '|' || rooms || '|2|1|' AS base,
           lower(district) AS d, 'rua ' || p_name || ', ' || p_size AS a, 'rua ' || p_name AS s
    FROM entities WHERE area_total > 0),
keys AS (
    SELECT id AS vertex, 'district|' || base || d AS key FROM based
    UNION ALL SELECT id, 'address|' || base || a FROM based
    UNION ALL SELECT id, 'street|' || base || s FROM based)"""



def pictured_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the signature of a picture: fifty pictures, each retouched a little more from copy to copy."""
    bits = F.transform("embedding", lambda x: x > 0)
    pictures = table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("bits"))
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    flipped = F.transform("bits", lambda b, i: F.when(i < F.floor(number / 50) % 12, ~b).otherwise(b))
    rows = entities(spark, sf_dir)
    joined = rows.join(pictures, number % 50 == F.col("vec_id"), "left")
    return joined.withColumn("image_hash", F.coalesce(bits_to_hex(flipped), F.lit(""))).select(*rows.columns, "image_hash")


# Pairs that look alike, written out: same kind and counts, near area and price, at most eight differing bits.
LOOKS = """,
pictured AS (
    SELECT e.id, e.kind, e.rooms, e.price, greatest(e.area_total, e.area_private) AS area, list_transform(range(1, 65), lambda i:
        CASE WHEN i <= (CAST(regexp_extract(e.id, '(\\d+)$', 1) AS BIGINT) // 50) % 12 THEN 1 - CAST(v.embedding[i] > 0 AS INTEGER) ELSE CAST(v.embedding[i] > 0 AS INTEGER) END) AS b
    FROM entities e JOIN embeddings v ON v.vec_id = CAST(regexp_extract(e.id, '(\\d+)$', 1) AS BIGINT) % 50),
look_edges AS (
    SELECT l.id AS src, r.id AS dst FROM pictured l JOIN pictured r ON l.kind = r.kind AND l.rooms = r.rooms AND l.id < r.id
    WHERE l.area > 0 AND r.area > 0 AND abs(l.area - r.area) / greatest(l.area, r.area) <= 0.18
      AND (l.price = 0 OR r.price = 0 OR abs(l.price - r.price) / greatest(l.price, r.price) <= 0.25)
      AND list_sum(list_transform(range(1, 65), lambda i: abs(l.b[i] - r.b[i]))) <= 8)"""

COMPONENTS = KEYS + """,
key_edges AS (
    SELECT DISTINCT a.vertex AS src, b.vertex AS dst
    FROM (SELECT key, min(vertex) AS vertex FROM keys GROUP BY key) a JOIN keys b ON a.key = b.key),
both_edges AS (SELECT src, dst FROM key_edges UNION SELECT dst, src FROM key_edges),
reach AS (
    SELECT id AS vertex, id AS label FROM entities
    UNION
    SELECT e.dst, r.label FROM reach r JOIN both_edges e ON r.vertex = e.src),
components AS (SELECT vertex, min(label) AS component FROM reach GROUP BY 1)"""

LOOK_COMPONENTS = COMPONENTS.replace("both_edges AS (SELECT src, dst FROM key_edges UNION SELECT dst, src FROM key_edges)", LOOKS.lstrip(",\n") + """,
both_edges AS (SELECT src, dst FROM key_edges UNION SELECT dst, src FROM key_edges UNION SELECT src, dst FROM look_edges UNION SELECT dst, src FROM look_edges)""")
