"""Keyed merges of repeated observations: one record per listing, price history, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import collection_date, parse_datetime
from ..functions.numbers import safe_double, safe_int
from ..functions.text import listing_code, unify_district

TEXT_FIELDS = ("district", "address", "image_url", "city", "kind")
AREA_FIELDS = ("area_total", "area_private")
COUNT_FIELDS = ("rooms", "baths", "parking")
STAMP_FIELDS = ("registered_at", "inserted_at", "updated_at")
# A record is more complete the more of these it fills.
COMPLETENESS_FIELDS = ("price", *TEXT_FIELDS, *AREA_FIELDS, *COUNT_FIELDS)
MERGED_FIELDS = ("price", "price_m2", *TEXT_FIELDS, *AREA_FIELDS, *COUNT_FIELDS, *STAMP_FIELDS)
UPSERT_FIELDS = ("price", "price_m2", *TEXT_FIELDS, *AREA_FIELDS, *COUNT_FIELDS, "registered_at")


def has_value(df: DataFrame, name: str) -> Column:
    """Not null, not empty, not zero."""
    col = F.col(name)
    if dict(df.dtypes)[name] == "string":
        return col.isNotNull() & (col != "")
    return col.isNotNull() & (col != 0)


def with_code(listings: DataFrame) -> DataFrame:
    """Priced rows with their listing code; rows without any code are dropped."""
    code = listing_code(F.col("code"), F.col("id"))
    return listings.filter("price IS NOT NULL AND price > 0").withColumn("code", code).filter("code <> ''")


def code_origins(listings: DataFrame) -> DataFrame:
    """Every id under every code, as rows."""
    return with_code(listings).filter("id <> ''").select("code", "id").distinct()


def merge_by_code(listings: DataFrame, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, origins): one record per code, each field its newest, most complete filled value, and the ids it came from.

    Rows are ordered by (newest of update/insert/registration date, filled fields, snapshot, id).
    The per-field choice is an aggregate, so a code seen in any number of snapshots combines on
    the map side. ``as_of`` fills dates no row provides.
    """
    rows = with_code(listings)
    stamps = {name: parse_datetime(F.col(name)) for name in STAMP_FIELDS}
    best = F.coalesce(stamps["updated_at"], stamps["inserted_at"], stamps["registered_at"])
    filled = sum(has_value(rows, name).cast("int") for name in COMPLETENESS_FIELDS)
    rows = rows.withColumn(
        "__rank",
        F.struct(
            F.coalesce(best, F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"),
            filled.alias("filled"),
            F.coalesce(F.col("source_db"), F.lit("")).alias("source_db"),
            F.coalesce(F.col("id"), F.lit("")).alias("id"),
        ),
    )
    picks = [
        F.max_by(F.col(name), F.when(has_value(rows, name), F.col("__rank"))).alias(name) for name in MERGED_FIELDS
    ]
    merged = rows.groupBy("code").agg(
        *picks,
        F.min(stamps["inserted_at"]).alias("__first"),
        F.max(stamps["updated_at"]).alias("__last"),
        # One entry per collection file.
        F.array_sort(F.collect_set(F.nullif("source_db", F.lit("")))).alias("source_dbs"),
        F.count("*").alias("source_count"),
    )
    # Counted apart: a distinct count beside the picks would shuffle their wide buffers twice more, by code and id.
    ids = rows.groupBy("code").agg(F.count_distinct(F.nullif("id", F.lit(""))).alias("source_id_count"))
    merged = merged.join(ids, "code")
    now = as_of if as_of is not None else F.localtimestamp()
    area = F.coalesce(F.nullif("area_private", F.lit(0.0)), F.nullif("area_total", F.lit(0.0)))
    records = (
        merged.withColumn("district", unify_district(F.col("district")))
        .withColumns({name: safe_int(F.col(name)) for name in COUNT_FIELDS})
        .withColumns({name: safe_double(F.col(name)) for name in AREA_FIELDS})
        .withColumn(
            "price_m2",
            F.when(area.isNotNull() & (F.col("price") > 0), F.round(F.col("price") / area, 6)).otherwise(
                safe_double(F.col("price_m2"))
            ),
        )
        .withColumn("inserted_at", F.coalesce("__first", now))
        .withColumn("updated_at", F.coalesce("__last", now))
        .withColumn("id", F.col("code"))
        .select("code", "id", *MERGED_FIELDS, "source_id_count", "source_dbs", "source_count")
    )
    return records, code_origins(listings)


def price_history(listings: DataFrame, order: Column, keep_order: bool = False) -> DataFrame:
    """One price per (code, day, source file); the last row by ``order`` wins, and may stay as ``order_key``."""
    rows = with_code(listings)
    day = collection_date(F.col("source_db"), F.col("updated_at"), F.col("inserted_at"))
    area = F.coalesce(F.nullif("area_private", F.lit(0.0)), F.nullif("area_total", F.lit(0.0)))
    picked = F.struct(
        F.col("price"),
        F.round(F.col("price") / area, 6).alias("price_m2"),
        F.coalesce(F.col("id"), F.lit("")).alias("source_id"),
    )
    return (
        rows.withColumn("day", day)
        .filter("day IS NOT NULL")
        .groupBy("code", "day", F.coalesce("source_db", F.lit("")).alias("source_db"))
        .agg(F.max_by(picked, order).alias("p"), F.max(order).alias("order_key"))
        .select("code", "day", "p.price", "p.price_m2", "p.source_id", "source_db", *(["order_key"] if keep_order else []))
    )


def upsert_latest(
    rows: DataFrame, order: Column, collected_at: Column, prefix: str = "", default_city: str | None = None, keep_order: bool = False
) -> DataFrame:
    """Newest row per id by ``order`` wins every field, the first insert date survives; rows without id are dropped.

    ``keep_order``: the winner's place in the order stays as ``order_key``, so that later batches can be compared with it.
    """
    keyed = rows.filter("id IS NOT NULL AND id <> ''").withColumn("id", F.concat(F.lit(prefix), F.col("id")))
    if default_city is not None:
        keyed = keyed.withColumn("city", F.coalesce(F.nullif("city", F.lit("")), F.lit(default_city)))
    fields = [name for name in UPSERT_FIELDS if name in keyed.columns]
    return (
        keyed.groupBy("id")
        .agg(
            F.max_by(F.struct(*fields), order).alias("r"),
            F.min(collected_at).alias("inserted_at"),
            F.max(collected_at).alias("updated_at"),
            F.max(order).alias("order_key"),
        )
        .select("id", "r.*", "inserted_at", "updated_at", *(["order_key"] if keep_order else []))
    )


def fold_latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of rows that are one per key and part each: the larger ``order_key`` wins, first and last dates of all survive.

    The order of the parts and the way they are grouped don't matter.
    """
    dates = {"inserted_at": F.min("inserted_at"), "updated_at": F.max("updated_at")}
    dates = {c: agg.alias(c) for c, agg in dates.items() if c in rows.columns}
    fields = [c for c in rows.columns if c not in (*keys, *dates, "order_key")]
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "order_key").alias("r"), *dates.values(), F.max("order_key").alias("order_key"))
    return merged.select(*keys, *[f"r.{f}" for f in fields], *dates, "order_key").select(*rows.columns)


def replace_latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The newest whole row per key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def run_summary(source: DataFrame, normalized: DataFrame, source_name: str, as_of: str) -> DataFrame:
    """Key/value counts of a deduplication run."""
    left = source.agg(
        F.count("*").alias("source_rows"), F.count_if(F.coalesce(F.col("price"), F.lit(0.0)) > 0).alias("price_rows")
    )
    right = normalized.agg(F.count("*").alias("normalized_rows"))
    wide = left.withColumn("normalized_rows", right.scalar())
    pairs = {
        "source_db": F.lit(source_name),
        "source_rows": F.col("source_rows").cast("string"),
        "normalized_rows": F.col("normalized_rows").cast("string"),
        "price_rows": F.col("price_rows").cast("string"),
        "generated_at": F.lit(as_of),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return wide.select(F.inline(entries))
