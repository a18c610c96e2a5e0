"""Dated listing snapshots with drifting columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import snapshot_date
from ..functions.numbers import parse_plain, reference_area
from ..functions.text import canonical_kind, fold_text

# Stored column names of a snapshot and the names used here.
STORED_NAMES = {
    "codigo": "code",
    "id": "id",
    "preco": "price",
    "preco_m2": "price_m2",
    "bairro": "district",
    "endereco": "address",
    "imagem_url": "image_url",
    "cidade": "city",
    "tipo_imovel": "kind",
    "area_total": "area_total",
    "area_privada": "area_private",
    "quartos": "rooms",
    "banheiros": "baths",
    "vagas": "parking",
    "date_registration": "registered_at",
    "data_insercao": "inserted_at",
    "data_atualizacao": "updated_at",
}
NUMBERS = ("price", "price_m2", "area_total", "area_private")
COUNTS = ("rooms", "baths", "parking")
LISTING_SCHEMA = T.StructType(
    [
        T.StructField(
            name, T.DoubleType() if name in NUMBERS else T.IntegerType() if name in COUNTS else T.StringType()
        )
        for name in STORED_NAMES.values()
    ]
)


def conform(df: DataFrame, names: dict[str, str] = STORED_NAMES) -> DataFrame:
    """Fixed column list in fixed types: stored names are translated, absent columns become null."""
    back = {new: old for old, new in names.items()}
    out = []
    for field in LISTING_SCHEMA:
        name = field.name if field.name in df.columns else back.get(field.name)
        col = F.col(name) if name in df.columns else F.lit(None)
        out.append(col.try_cast(field.dataType).alias(field.name))
    return df.select(*out, *[c for c in ("source_db", "snapshot_date") if c in df.columns])


def union_drifting(frames: list[DataFrame]) -> DataFrame:
    """Union by name where older frames lack columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_snapshots(spark: SparkSession, folder: str, pattern: str = "*_??_??_????*", fmt: str = "parquet", names: dict[str, str] = STORED_NAMES) -> DataFrame:
    """All dated files of a folder (derived tables do not match the pattern), tagged with their file.

    The file name carries the date; rows keep it as ``source_db`` and ``snapshot_date``.
    """
    reader = spark.read.format(fmt).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if fmt == "parquet":
        reader = reader.option("mergeSchema", "true")
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.load(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    folder_name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    # Spark writes a folder per table, so the dated name may be the folder.
    dated = F.when(snapshot_date(name).isNotNull(), name).otherwise(folder_name)
    tagged = df.select("*", dated.alias("source_db")).withColumn("snapshot_date", snapshot_date(F.col("source_db")))
    return conform(tagged, names)


def training_frame(listings: DataFrame) -> DataFrame:
    """Priced rows with a known area, numbers filled with 0 and canonical text."""
    numbers = ("area_total", "area_private", "rooms", "baths", "parking")
    out = listings.filter("price IS NOT NULL AND price > 0")
    out = out.withColumns({c: F.coalesce(parse_plain(F.col(c)), F.lit(0.0)) for c in numbers})
    out = out.filter("area_total > 0 OR area_private > 0")
    return out.withColumn("district", fold_text(F.col("district"))).withColumn("kind", canonical_kind(F.col("kind")))


def listing_features(unified: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Per-code features for the panel: folded district, canonical kind, reference area."""
    zero = F.lit(0.0)
    out = unified.select(
        "code",
        fold_text(F.col("district")).alias("district"),
        canonical_kind(F.col("kind")).alias("kind"),
        reference_area(F.coalesce("area_private", zero), F.coalesce("area_total", zero)).alias("area_ref"),
        *[F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in COUNTS],
    )
    return out.filter(F.col("kind").isin(kinds)) if kinds is not None else out
