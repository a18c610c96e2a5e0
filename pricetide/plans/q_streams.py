"""Incremental twins of the upsert and the price history: raw rows in shuffled deliveries, some of them twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import ingest
from . import bindings as B
from .q_sources import _event_rows, _history_rows
from .registry import ORACLES, query

DELIVERIES = 6
#: Rows to a file of a delivery; a task writes one file at a time.
FILE_ROWS = 500_000
UPSERT_COLUMNS = ("id", "price", "district", "city", "rooms", "inserted_at", "updated_at")


def _deliver(rows: DataFrame, source: DataFrame, folder: str, *key: str) -> int:
    """Files of rows of all ages and ties in any order; a sixth of the rows is delivered again with the next file.

    ``source``: the table behind the rows. Returns the files of a delivery, which grow in number with the source.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(DELIVERIES))
    first = rows.withColumn("delivery", place)
    again = first.where("delivery = 0").withColumn("delivery", F.lit(1).cast("long"))
    files = max(1, -(-source.count() // (DELIVERIES * FILE_ROWS)))
    piece = F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(files))
    first.unionByName(again).repartition(DELIVERIES * files, "delivery", piece).write.partitionBy("delivery").parquet(folder)
    return files


@query("stream_upsert", ORACLES["upsert_latest"])
def stream_upsert(spark, sf):
    """Events in shuffled deliveries, folded batch by batch."""
    source, target, state = (B.shared_folder(spark, f"stream-{n}") for n in ("in", "out", "state"))
    events = _event_rows(spark, sf)
    files = _deliver(events, B.table(spark, sf, "events"), source, "event_id")
    stream = ingest.snapshot_stream(spark, source, events.schema, "*.parquet", files_per_trigger=2 * files)
    ingest.start_upsert(stream, target, state, F.struct("ts", "event_id"), F.col("ts"), "SM-", "Chapecó").awaitTermination()
    out = ingest.latest_version(spark, target)
    stamp = "yyyy-MM-dd HH:mm:ss"
    return out.withColumns({c: F.date_format(c, stamp) for c in ("inserted_at", "updated_at")}).select(*UPSERT_COLUMNS)


@query("stream_history", ORACLES["history_dedup"])
def stream_history(spark, sf):
    """Raw observations of seven years in shuffled deliveries; the last by order wins, whenever it arrives."""
    source, target, state = (B.shared_folder(spark, f"history-{n}") for n in ("in", "out", "state"))
    rows = _history_rows(spark, sf)
    files = _deliver(rows, B.table(spark, sf, "lineitem"), source, "order")
    stream = ingest.snapshot_stream(spark, source, rows.schema, "*.parquet", files_per_trigger=2 * files)
    ingest.start_history(stream, target, state, F.col("order")).awaitTermination()
    return ingest.latest_version(spark, target).withColumn("day", F.col("day").cast("string"))
