"""Stored monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_start

POINTS = "array<struct<data: string, valor: double>>"


def parse_series(documents: DataFrame, body: str = "body", name: str = "series") -> DataFrame:
    """(series, position, month, value) from JSON arrays of ``{data: dd/MM/yyyy, valor}``."""
    points = F.posexplode(F.from_json(F.col(body), POINTS)).alias("position", "p")
    rows = documents.select(name, points)
    day = F.regexp_replace(F.col("p.data"), r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1").try_cast("date")
    return rows.select(name, "position", month_start(day).alias("month"), F.col("p.valor").alias("value"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """One file per series, named after it; a month given twice keeps its first value."""
    from ..operators.index import first_per_month

    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return first_per_month(parse_series(files.select(name.alias("series"), F.col("value").alias("body"))), ["series"])


def read_series_bundle(spark: SparkSession, path: str) -> DataFrame:
    """One file holding ``{series name: [points]}``."""
    from ..operators.index import first_per_month

    files = spark.read.text(path, wholetext=True)
    bundle = F.from_json(F.col("value"), f"map<string, {POINTS}>")
    rows = files.select(F.explode(bundle).alias("series", "points"))
    return first_per_month(parse_series(rows.select("series", F.to_json("points").alias("body"))), ["series"])
