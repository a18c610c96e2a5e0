"""Published tables: a columnar table and a CSV from one computation, which readers get together or not at all.

``publish`` writes both into a folder of their own and then puts a manifest in place that names it. Readers go by the manifest,
so a broken or running export is never seen, and the CSV has the rows of the table it stands beside. The version before stays
for readers that are still at it; older ones and what broken runs left are deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .files import SharedFiles
from .tables import read_csv, write_csv

KEPT = 2


def publish(df: DataFrame, target: str, name: str, order: list[str] | None = None, kept: int = KEPT) -> dict:
    """Write ``df`` as table and CSV, range-sorted by ``order``; gives the manifest: version, rows, schema, bytes, versions before."""
    files = SharedFiles(df.sparkSession, f"{target.rstrip('/')}/{name}")
    before = files.read_json("manifest.json")["versions"] if files.exists("manifest.json") else []
    version = uuid.uuid4().hex
    (df.orderBy(*order) if order else df).write.parquet(files.path(f"{version}/table"))
    table = df.sparkSession.read.schema(df.schema).parquet(files.path(f"{version}/table"))
    write_csv(table, files.path(f"{version}/csv"), order)
    size = {form: files.size(f"{version}/{form}") for form in ("table", "csv")}
    manifest = {"versions": [*before, version][-kept:], "rows": table.count(), "schema": df.schema.json(), "bytes": size}
    files.replace_json("manifest.json", manifest)
    for found in files.names("."):
        if found != "manifest.json" and found not in manifest["versions"]:
            files.delete(found)
    return manifest


def read_published(spark: SparkSession, target: str, name: str, form: str = "table") -> DataFrame:
    """The last published rows; ``form`` is table or csv."""
    files = SharedFiles(spark, f"{target.rstrip('/')}/{name}")
    manifest = files.read_json("manifest.json")
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    path = files.path(f"{manifest['versions'][-1]}/{form}")
    return spark.read.schema(schema).parquet(path) if form == "table" else read_csv(spark, path, schema)
