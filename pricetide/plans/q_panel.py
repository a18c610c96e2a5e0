"""Merge, panel, index, features, pairs and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket
from ..operators import clean, merge, metrics, resolve
from ..operators import panel as P
from ..session import stored
from . import bindings as B
from .registry import query


def month_text(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM") for c in columns})


def rounded(df, digits=9, *skip):
    doubles = [n for n, t in df.dtypes if t == "double" and n not in skip]
    return df.withColumns({n: F.round(n, digits) for n in doubles})


def _index(spark, sf):
    panel = B.stored_panel(spark, sf)
    return panel, stored(P.repeat_index(P.monthly_changes(panel), B.MIN_PAIRS))


# ---------------------------------------------------------------- merge by code
MERGE_ROWS = B.OBS + """,
listings AS (
    SELECT code, source || '-' || code AS id, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE 0.0 END AS price_m2, price,
           CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE district END AS district, CASE WHEN l_linenumber % 3 = 0 THEN kind END AS kind,
           CASE WHEN l_linenumber % 4 = 0 THEN 0.0 ELSE area END AS area_total, CASE WHEN l_linenumber % 3 <> 0 THEN 0.0 ELSE area + 1 END AS area_private,
           CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE rooms END AS rooms, 0 AS baths, parking,
           CAST(day AS TIMESTAMP) + INTERVAL 8 HOUR AS inserted, CASE WHEN l_suppkey % 3 = 0 THEN CAST(day AS TIMESTAMP) + INTERVAL 60 HOUR END AS updated,
           'listings_' || strftime(date_trunc('month', day), '%d_%m_%Y') AS source_db
    FROM obs),
ranked AS (
    SELECT *, {rank} AS rk,
        CASE WHEN updated IS NOT NULL THEN updated ELSE inserted END AS best,
        1 + (district <> '')::INT + coalesce((kind <> '')::INT, 0) + (area_total <> 0)::INT + (area_private <> 0)::INT + (rooms <> 0)::INT + (parking <> 0)::INT AS filled
    FROM listings)"""
RANK = "row(CASE WHEN updated IS NOT NULL THEN updated ELSE inserted END, 1 + (district <> '')::INT + coalesce((kind <> '')::INT, 0) + (area_total <> 0)::INT + (area_private <> 0)::INT + (rooms <> 0)::INT + (parking <> 0)::INT, source_db, id, {value})"


def _pick(value: str, test: str) -> str:
    return f"arg_max({value}, {RANK.format(value=value)}) FILTER ({test})"


@query(
    "merge_by_code",
    f"""WITH {MERGE_ROWS.format(rank='0')},
    m AS (
        SELECT code, {_pick('price', 'price <> 0')} AS price, {_pick('district', "district <> ''")} AS district, {_pick('kind', "kind <> ''")} AS kind,
               coalesce({_pick('area_total', 'area_total <> 0')}, 0.0) AS area_total, coalesce({_pick('area_private', 'area_private <> 0')}, 0.0) AS area_private,
               coalesce({_pick('rooms', 'rooms <> 0')}, 0) AS rooms, coalesce({_pick('parking', 'parking <> 0')}, 0) AS parking,
               strftime(min(inserted), '%Y-%m-%d %H:%M:%S') AS inserted_at, strftime(coalesce(max(updated), TIMESTAMP '2026-09-03 00:00:00'), '%Y-%m-%d %H:%M:%S') AS updated_at,
               count(DISTINCT id) AS ids, string_agg(DISTINCT source_db, '|' ORDER BY source_db) AS source_dbs, count(*) AS source_count
        FROM ranked GROUP BY code)
    SELECT *, CASE WHEN coalesce(nullif(area_private, 0), nullif(area_total, 0)) IS NOT NULL
                   THEN {B.half_up('price / coalesce(nullif(area_private, 0), nullif(area_total, 0))', 6)} ELSE 0.0 END AS price_m2 FROM m""",
)
def merge_by_code(spark, sf):
    """One record per part out of observations with holes."""
    line, supp = F.col("l_linenumber"), F.col("l_suppkey")
    obs = B.observations(spark, sf)  # the merge combines before it shuffles
    rows = obs.select(
        "code",
        F.concat_ws("-", "source", "code").alias("id"),
        F.when(line % 5 != 0, 0.0).alias("price_m2"),
        "price",
        F.when(line % 2 == 0, "").otherwise(F.col("district")).alias("district"),
        F.lit("").alias("address"),
        F.lit(None).cast("string").alias("image_url"),
        F.lit(None).cast("string").alias("city"),
        F.when(line % 3 == 0, F.col("kind")).alias("kind"),
        F.when(line % 4 == 0, 0.0).otherwise(F.col("area")).alias("area_total"),
        F.when(line % 3 != 0, 0.0).otherwise(F.col("area") + 1).alias("area_private"),
        F.when(supp % 2 == 0, 0).otherwise(F.col("rooms")).alias("rooms"),
        F.lit(0).alias("baths"),
        "parking",
        F.lit(None).cast("string").alias("registered_at"),
        F.concat(F.col("day").cast("string"), F.lit("T08:00:00")).alias("inserted_at"),
        F.when(supp % 3 == 0, F.concat(F.date_add("day", 2).cast("string"), F.lit(" 12:00:00"))).alias("updated_at"),
        F.concat(F.lit("listings_"), F.date_format(F.trunc("day", "month"), "dd_MM_yyyy")).alias("source_db"),
    )
    out, _ = merge.merge_by_code(rows, F.lit("2026-09-03").cast("timestamp_ntz"))
    stamp = "yyyy-MM-dd HH:mm:ss"
    return out.select(
        "code", "price", "district", "kind", "area_total", "area_private", "rooms", "parking", "price_m2",
        F.date_format("inserted_at", stamp).alias("inserted_at"),
        F.date_format("updated_at", stamp).alias("updated_at"),
        F.col("source_id_count").alias("ids"),
        F.array_join("source_dbs", "|").alias("source_dbs"),
        "source_count",
    )


@query(
    "mode_tiebreak",
    f"""WITH {B.OBS}, c AS (SELECT code, baths, count(*) AS n FROM obs GROUP BY 1, 2)
    SELECT code, arg_min(baths, (-n, CAST(baths AS VARCHAR))) AS mode FROM c GROUP BY 1""",
)
def mode_tiebreak(spark, sf):
    return resolve.mode_by(B.observations(spark, sf), ["code"], "baths")


@query(
    "address_consensus",
    """WITH r AS (
        SELECT l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'Rua ' || p_name ELSE 'RUA ' || p_name || ', SC' END AS raw, 'rua ' || p_name AS canonical
        FROM lineitem JOIN part ON l_partkey = p_partkey),
    g AS (SELECT l_suppkey, canonical, raw, count(*) AS n FROM r GROUP BY 1, 2, 3),
    h AS (SELECT l_suppkey, canonical, CAST(sum(n) AS BIGINT) AS n, arg_min(raw, (-length(raw), raw)) AS raw FROM g GROUP BY 1, 2)
    SELECT CAST(l_suppkey AS VARCHAR) AS cluster, arg_min(raw, (-n, -length(canonical), canonical)) AS address FROM h GROUP BY 1""",
)
def address_consensus(spark, sf):
    part = B.table(spark, sf, "part").select("p_partkey", "p_name")
    lines = B.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Rua "), "p_name")).otherwise(F.concat(F.lit("RUA "), "p_name", F.lit(", SC")))
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(B.text("l_suppkey").alias("cluster"), raw.alias("address"))
    return resolve.address_consensus(rows, ["cluster"])


# ---------------------------------------------------------------- panel and index
@query(
    "monthly_panel",
    f"WITH {B.PANEL} SELECT code, strftime(month, '%Y-%m') AS month, month_n, price, district, kind, area_ref, rooms, baths, parking, price_m2 FROM panel",
)
def monthly_panel(spark, sf):
    return month_text(B.panel(spark, sf), "month")


@query(
    "monthly_changes",
    f"WITH {B.CHANGES} SELECT code, strftime(month, '%Y-%m') AS month, district, kind, round(dlog, 9) AS dlog FROM changes",
)
def monthly_changes(spark, sf):
    out = P.monthly_changes(B.panel(spark, sf)).select("code", "month", "district", "kind", "dlog")
    return rounded(month_text(out, "month"))


@query(
    "repeat_pairs",
    f"WITH {B.REPEATS} SELECT code, strftime(month, '%Y-%m') AS month, CAST(gap AS INTEGER) AS gap, round(dlog, 9) AS dlog FROM repeats",
)
def repeat_pairs(spark, sf):
    out = P.repeat_pairs(B.panel(spark, sf)).select("code", "month", "gap", "dlog")
    return rounded(month_text(out, "month"))


INDEX_ROWS = """index_rows AS (
    SELECT 'segment' AS level, district, kind, month, mean_dlog, pairs FROM seg_index
    UNION ALL SELECT 'kind', NULL, kind, month, mean_dlog, pairs FROM kind_index
    UNION ALL SELECT 'overall', NULL, NULL, month, mean_dlog, pairs FROM all_index)"""


@query(
    "repeat_index",
    f"WITH {B.INDEX}, {INDEX_ROWS} SELECT level, district, kind, strftime(month, '%Y-%m') AS month, round(mean_dlog, 9) AS mean_dlog, pairs FROM index_rows",
)
def repeat_index(spark, sf):
    return rounded(month_text(P.repeat_index(P.monthly_changes(B.panel(spark, sf)), B.MIN_PAIRS), "month"))


@query(
    "fallback_lookup",
    f"""WITH {B.INDEX}
    SELECT p.code, strftime(p.month, '%Y-%m') AS month, round(coalesce(a.mean_dlog, b.mean_dlog, c.mean_dlog, 0.0), 9) AS segment_momentum,
           round(coalesce(b.mean_dlog, c.mean_dlog, 0.0), 9) AS kind_momentum
    FROM panel p LEFT JOIN seg_index a ON a.district = p.district AND a.kind = p.kind AND a.month = p.month
    LEFT JOIN kind_index b ON b.kind = p.kind AND b.month = p.month LEFT JOIN all_index c ON c.month = p.month""",
)
def fallback_lookup(spark, sf):
    panel, index = _index(spark, sf)
    out = P.with_momentum(panel.select("code", "month", "district", "kind"), index).drop("district", "kind")
    return rounded(month_text(out, "month"))


CUMULATIVE = B.INDEX + """,
grid AS (
    SELECT s.district, s.kind, s.listings, m.month, CASE WHEN m.month = (SELECT min(month) FROM panel) THEN 0.0 ELSE coalesce(a.mean_dlog, b.mean_dlog, c.mean_dlog, 0.0) END AS step
    FROM (SELECT district, kind, count(*) AS listings FROM panel GROUP BY 1, 2) s CROSS JOIN (SELECT DISTINCT month FROM panel) m
    LEFT JOIN seg_index a ON a.district = s.district AND a.kind = s.kind AND a.month = m.month
    LEFT JOIN kind_index b ON b.kind = s.kind AND b.month = m.month LEFT JOIN all_index c ON c.month = m.month),
cumulative AS (
    SELECT district, kind, listings, month, 100 * exp(sum(step) OVER (PARTITION BY district, kind ORDER BY month)) AS index_level,
           100 * exp(sum(step) OVER (PARTITION BY district, kind)) - 100 AS total_change_pct FROM grid)"""


@query(
    "cumulative_index",
    f"WITH {CUMULATIVE} SELECT district, kind, listings, strftime(month, '%Y-%m') AS month, round(index_level, 6) AS index_level, round(total_change_pct, 6) AS total_change_pct FROM cumulative",
)
def cumulative_index(spark, sf):
    panel, index = _index(spark, sf)
    return rounded(month_text(P.cumulative_index(panel, index), "month"), 6)


# Every month of the calendar the observations come from.
TABLE_MONTHS = [f"{year}-{month:02d}" for year in range(1995, 2002) for month in range(1, 13)]


@query(
    "cumulative_index_table",
    f"""WITH {CUMULATIVE}, t AS (
        SELECT district, kind, listings, round(total_change_pct, 2) AS total_change_pct, """
    + ", ".join(f"max(round(index_level, 2)) FILTER (strftime(month, '%Y-%m') = '{m}') AS \"{m}\"" for m in TABLE_MONTHS)
    + """ FROM cumulative WHERE listings >= 300 GROUP BY district, kind, listings, total_change_pct)
    SELECT * FROM t ORDER BY kind, total_change_pct DESC, district LIMIT 30""",
)
def cumulative_index_table(spark, sf):
    """The published table: a column for every month, best segments of each kind first, 30 rows."""
    panel, index = _index(spark, sf)
    wide = P.index_table(P.cumulative_index(panel, index), TABLE_MONTHS)
    return wide.filter("listings >= 300").orderBy("kind", F.desc("total_change_pct"), "district").limit(30)


@query(
    "cross_section",
    f"""WITH {B.PANEL}, {B.SECTIONS}
    SELECT 'segment' AS level, district, kind, strftime(month, '%Y-%m') AS month, median_price_m2, n FROM sec_seg
    UNION ALL SELECT 'kind', NULL, kind, strftime(month, '%Y-%m'), median_price_m2, n FROM sec_kind""",
)
def cross_section(spark, sf):
    return month_text(P.cross_section(B.stored_panel(spark, sf)), "month")


@query(
    "panel_features",
    f"""WITH {B.PANEL_FEATURES}
    SELECT code, strftime(month, '%Y-%m') AS month, CAST(months_listed AS INTEGER) AS months_listed, round(previous_change, 9) AS previous_change,
           round(relative_price, 9) AS relative_price, round(log_price_m2, 9) AS log_price_m2, round(segment_momentum, 9) AS segment_momentum, round(kind_momentum, 9) AS kind_momentum FROM pf""",
)
def panel_features(spark, sf):
    panel, index = _index(spark, sf)
    out = P.panel_features(panel, index).select(
        "code", "month", "months_listed", "previous_change", "relative_price", "log_price_m2", "segment_momentum", "kind_momentum"
    )
    return rounded(month_text(out, "month"))


@query(
    "horizon_pairs",
    f"""WITH {B.pairs_sql(3)}
    SELECT code, strftime(month, '%Y-%m') AS month, strftime(target_month, '%Y-%m') AS target_month, future_price, round(target, 9) AS target, round(relative_price, 9) AS relative_price FROM pairs""",
)
def horizon_pairs(spark, sf):
    out = B.pairs(spark, sf, 3).select("code", "month", "target_month", "future_price", "target", "relative_price")
    return rounded(month_text(out, "month", "target_month"), 9, "future_price")


TEMPORAL = B.pairs_sql(1) + """,
parted AS (
    SELECT *, CASE WHEN target_month >= (SELECT min(m) FROM (SELECT DISTINCT target_month AS m FROM pairs ORDER BY m DESC LIMIT {months})) THEN 'test' ELSE 'train' END AS part FROM pairs)"""
TEST_MONTHS = 6


@query(
    "temporal_split",
    f"""WITH {TEMPORAL.format(months=TEST_MONTHS)}
    SELECT part, count(*) AS n, strftime(min(target_month), '%Y-%m') AS first_month, strftime(max(target_month), '%Y-%m') AS last_month, round(avg(target), 9) AS mean_target FROM parted GROUP BY 1""",
)
def temporal_split(spark, sf):
    parted = P.temporal_split(stored(B.pairs(spark, sf, 1)), TEST_MONTHS)
    out = parted.groupBy("part").agg(
        F.count("*").alias("n"), F.min("target_month").alias("first_month"), F.max("target_month").alias("last_month"), F.avg("target").alias("mean_target")
    )
    return rounded(month_text(out, "first_month", "last_month"))


BASELINE = TEMPORAL.format(months=TEST_MONTHS) + """,
b1 AS (SELECT district, kind, avg(target) AS v FROM parted WHERE part = 'train' GROUP BY 1, 2),
b2 AS (SELECT kind, avg(target) AS v FROM parted WHERE part = 'train' GROUP BY 1),
growth AS (
    SELECT p.*, coalesce(b1.v, b2.v, (SELECT avg(target) FROM parted WHERE part = 'train')) AS prediction
    FROM parted p LEFT JOIN b1 ON b1.district = p.district AND b1.kind = p.kind LEFT JOIN b2 ON b2.kind = p.kind WHERE p.part = 'test')"""


def _baseline(spark, sf):
    parted = P.temporal_split(stored(B.pairs(spark, sf, 1)), TEST_MONTHS)
    return P.segment_mean_baseline(parted.filter("part = 'train'"), parted.filter("part = 'test'"))


@query(
    "segment_mean_baseline",
    f"WITH {BASELINE} SELECT code, strftime(month, '%Y-%m') AS month, round(target, 9) AS target, round(prediction, 9) AS prediction FROM growth",
)
def segment_mean_baseline(spark, sf):
    return rounded(month_text(_baseline(spark, sf).select("code", "month", "target", "prediction"), "month"))


GROWTH_SQL = """round(avg(abs(100 * (exp(target) - 1) - 100 * (exp({p}) - 1))), 6) AS mae_pp,
    round(sqrt(avg(pow(100 * (exp(target) - 1) - 100 * (exp({p}) - 1), 2))), 6) AS rmse_pp,
    round(1 - sum(pow(target - ({p}), 2)) / (var_pop(target) * count(*)), 6) AS r2,
    round(avg(CASE WHEN (CASE WHEN target > 0.005 THEN 1 WHEN target < -0.005 THEN -1 ELSE 0 END) = (CASE WHEN ({p}) > 0.005 THEN 1 WHEN ({p}) < -0.005 THEN -1 ELSE 0 END) THEN 1.0 ELSE 0.0 END), 6) AS direction_accuracy,
    round(avg(abs(price * (exp(target) - 1) - price * (exp({p}) - 1))), 4) AS mae_money, count(*) AS n"""


@query("growth_metrics", f"WITH {BASELINE} SELECT kind, {GROWTH_SQL.format(p='prediction')} FROM growth GROUP BY kind")
def growth_metrics(spark, sf):
    out = metrics.growth_metrics(_baseline(spark, sf), ["kind"], "target", "prediction")
    return rounded(out.withColumn("mae_money", F.round("mae_money", 4)), 6, "mae_money")


@query(
    "growth_baselines",
    f"""WITH {BASELINE} SELECT 'no_change' AS model, {GROWTH_SQL.format(p='0.0')} FROM growth
    UNION ALL SELECT 'segment_mean', {GROWTH_SQL.format(p='prediction')} FROM growth""",
)
def growth_baselines(spark, sf):
    """Both naive forecasts every model has to beat."""
    options = F.array(
        F.struct(F.lit("no_change").alias("model"), F.lit(0.0).alias("p")),
        F.struct(F.lit("segment_mean").alias("model"), F.col("prediction").alias("p")),
    )
    rows = _baseline(spark, sf).select("target", "price", F.inline(options))
    out = metrics.growth_metrics(rows, ["model"], "target", "p")
    return rounded(out.withColumn("mae_money", F.round("mae_money", 4)), 6, "mae_money")


@query(
    "change_shares",
    f"""WITH {B.REPEATS}
    SELECT kind, count(*) AS n, round(100 * avg(CASE WHEN abs(100 * (exp(dlog) - 1)) < 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS unchanged_pct,
           round(100 * avg(CASE WHEN 100 * (exp(dlog) - 1) > 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS rose_pct, round(100 * avg(CASE WHEN 100 * (exp(dlog) - 1) < -1e-9 THEN 1.0 ELSE 0.0 END), 6) AS fell_pct,
           round(avg(CASE WHEN dlog < -0.005 THEN 1.0 ELSE 0.0 END), 6) AS cut_rate FROM repeats GROUP BY 1""",
)
def change_shares(spark, sf):
    return rounded(metrics.change_shares(P.repeat_pairs(B.panel(spark, sf)), ["kind"]), 6)


@query(
    "latest_rulers",
    f"""WITH {B.INDEX}, last AS (SELECT max(month) AS m FROM panel),
    segs AS (SELECT DISTINCT district, kind FROM panel), kinds AS (SELECT DISTINCT kind FROM panel),
    ls AS (SELECT district, kind, count(*) AS n, quantile_cont(price_m2, 0.5) AS v FROM panel WHERE month = (SELECT m FROM last) GROUP BY 1, 2),
    lk AS (SELECT kind, count(*) AS n, quantile_cont(price_m2, 0.5) AS v FROM panel WHERE month = (SELECT m FROM last) GROUP BY 1)
    SELECT s.district, s.kind, round(coalesce(a.mean_dlog, b.mean_dlog, c.mean_dlog, 0.0), 9) AS momentum, ls.n, ls.v AS median_price_m2
    FROM segs s LEFT JOIN seg_index a ON a.district = s.district AND a.kind = s.kind AND a.month = (SELECT m FROM last)
    LEFT JOIN kind_index b ON b.kind = s.kind AND b.month = (SELECT m FROM last) LEFT JOIN all_index c ON c.month = (SELECT m FROM last)
    LEFT JOIN ls ON ls.district = s.district AND ls.kind = s.kind
    UNION ALL
    SELECT NULL, s.kind, round(coalesce(b.mean_dlog, c.mean_dlog, 0.0), 9), lk.n, lk.v
    FROM kinds s LEFT JOIN kind_index b ON b.kind = s.kind AND b.month = (SELECT m FROM last) LEFT JOIN all_index c ON c.month = (SELECT m FROM last)
    LEFT JOIN lk ON lk.kind = s.kind""",
)
def latest_rulers(spark, sf):
    fine, coarse = P.latest_rulers(*_index(spark, sf))
    fine = fine.select("district", "kind", F.col("segment_momentum").alias("momentum"), "n", "median_price_m2")
    coarse = coarse.select(
        F.lit(None).cast("string").alias("district"), "kind", F.col("kind_momentum").alias("momentum"), "n", "median_price_m2"
    )
    return rounded(fine.unionByName(coarse), 9, "median_price_m2")


# ---------------------------------------------------------------- splits and folds
@query(
    "holdout_split",
    f"WITH {B.SPLIT} SELECT part, kind, count(*) AS n, round(sum(price), 2) AS price_sum FROM split GROUP BY 1, 2",
)
def holdout_split(spark, sf):
    row = F.concat_ws("-", *[B.text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    split = clean.holdout_split(B.observations(spark, sf).withColumn("row_id", row), "row_id")
    return split.groupBy("part", "kind").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price_sum"))


@query(
    "group_folds",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS code, CAST(floor({B.uniform_sql('p_partkey', "'folds'")} * 5) AS INTEGER) AS fold, count(*) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def group_folds(spark, sf):
    return clean.group_folds(B.observations(spark, sf), "code").groupBy("code", "fold").agg(F.count("*").alias("n"))


@query(
    "train_only_semi",
    f"""WITH {B.OBS}, kept AS (SELECT DISTINCT code FROM obs WHERE {B.uniform_sql('code', "'origins'")} < 0.8)
    SELECT district, count(*) AS n, round(sum(price), 2) AS price_sum FROM obs WHERE code IN (SELECT code FROM kept) GROUP BY 1""",
)
def train_only_semi(spark, sf):
    """Observations of the codes behind the train entities, whose origins are arrays of codes."""
    obs = B.observations(spark, sf)
    codes = obs.select("code").distinct().filter(hash_bucket(10, F.col("code"), F.lit("origins")) < 8)
    train = codes.withColumn("origins", F.array("code")).select(F.explode("origins").alias("code")).distinct()
    kept = obs.join(train, "code", "left_semi")
    return kept.groupBy("district").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price_sum"))
