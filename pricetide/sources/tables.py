"""Published tables: CSV with explicit nulls, JSON lists, Parquet outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Only the empty field is null; texts such as ``NA`` stay text."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="", emptyValue='""', encoding="UTF-8")


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Header and empty fields for nulls; range-partitioned when an order is asked for."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue='""')


def write_district_lists(lists: DataFrame, path: str) -> None:
    """One JSON object ``{kind: [districts]}``; the number of kinds is fixed by the classifier."""
    entries = F.map_from_entries(F.collect_list(F.struct("kind", "districts")))
    lists.agg(F.to_json(entries).alias("value")).write.mode("overwrite").text(path)
