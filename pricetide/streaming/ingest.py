"""Incremental snapshot ingest with the results of its batch twins.

A table of one row per key is kept as runs. A micro-batch writes one run: its own rows, one per key, and nothing else. When
``FAN`` runs of a level have gathered they are merged into one run of the next level, so a row is rewritten once per level and
what a batch writes follows the size of the batch, not of the table. Readers fold the runs: the larger ``order_key`` wins a
key, first and last dates of all survive; folding any runs in any order gives the same rows. Rows keep their place in the
caller's order, so equal stamps, late rows and rows years old end where one batch over everything would put them; nothing is
dropped by age.

Which runs are live stands in a manifest, one small file per batch that is written beside and renamed into place: readers take
the newest manifest and see a whole table, before a batch or after it. A replayed batch starts from the manifest before its
own and writes runs under new names. Runs that neither of the last ``KEPT`` manifests names are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import fold_latest, price_history, upsert_latest
from ..sources.files import SharedFiles

FAN = 4
KEPT = 3
FILE_BYTES = 128 << 20


def snapshot_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*", files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


class RunTable:
    """Runs and manifests of one table below ``target``."""

    def __init__(self, spark: SparkSession, target: str) -> None:
        self.spark, self.files = spark, SharedFiles(spark, target)

    # ------------------------------------------------------------ manifests
    def _manifest_name(self, batch_id: int) -> str:
        return f"manifests/{batch_id:020d}.json"

    def batches(self) -> list[int]:
        """Batches that have a manifest, oldest first."""
        return [int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, batch_id: int | None = None) -> dict:
        """The manifest of a batch, or the newest; a missing one is an error."""
        if batch_id is None:
            found = self.batches()
            if not found:
                raise FileNotFoundError(f"no manifest below {self.files.root}")
            batch_id = found[-1]
        return self.files.read_json(self._manifest_name(batch_id))

    # ------------------------------------------------------------ runs
    def write_run(self, rows: DataFrame, batch_id: int, level: int) -> dict:
        """Rows as a run of their own; its name is never used again."""
        name = f"{batch_id:020d}-{level}-{uuid.uuid4().hex}"
        rows.write.parquet(self.files.path(f"runs/{name}"))
        return {"name": name, "level": level, "bytes": self.files.size(f"runs/{name}")}

    def read_runs(self, runs: list[dict], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self.files.path(f"runs/{r['name']}") for r in runs])

    def compact(self, runs: list[dict], keys: list[str], schema: StructType, batch_id: int, fan: int = FAN) -> list[dict]:
        """Merges ``fan`` runs of a level into one of the next until no level has so many; files grow in number with the run."""
        runs = list(runs)
        while full := [level for level, n in Counter(r["level"] for r in runs).items() if n >= fan]:
            level = min(full)
            merged = [r for r in runs if r["level"] == level]
            files = max(1, -(-sum(r["bytes"] for r in merged) // FILE_BYTES))
            rows = fold_latest(self.read_runs(merged, schema), keys).repartition(files, *keys)
            runs = [r for r in runs if r["level"] != level] + [self.write_run(rows, batch_id, level + 1)]
        return runs

    def vacuum(self, batch_id: int, kept: int = KEPT) -> None:
        """Deletes manifests older than the last ``kept`` and every run that those kept do not name.

        Only the writer calls this, after its commit, so no run is on its way into a manifest.
        """
        batches = [b for b in self.batches() if b <= batch_id]
        for old in batches[:-kept]:
            self.files.delete(self._manifest_name(old))
        live = {r["name"] for b in self.batches() for r in self.manifest(b)["runs"]}
        for name in self.files.names("runs"):
            if name not in live:
                self.files.delete(f"runs/{name}")

    # ------------------------------------------------------------ batches and readers
    def fold(self, batch: DataFrame, batch_id: int, keys: list[str], fan: int = FAN) -> None:
        """Adds a batch of one row per key. Only batch 0 may start from nothing; a later one needs its predecessor's manifest."""
        before = [] if batch_id == 0 else self.manifest(batch_id - 1)["runs"]
        runs = [*before, self.write_run(batch, batch_id, 0)]
        runs = self.compact(runs, keys, batch.schema, batch_id, fan)
        self.files.replace_json(self._manifest_name(batch_id), {"batch": batch_id, "keys": keys, "schema": batch.schema.json(), "runs": runs})
        self.vacuum(batch_id)

    def latest(self) -> DataFrame:
        """The table as of the newest manifest, with ``order_key``."""
        found = self.manifest()
        schema = StructType.fromJson(json.loads(found["schema"]))
        return fold_latest(self.read_runs(found["runs"], schema), found["keys"])


def start_keyed(stream: DataFrame, target: str, checkpoint: str, keys: list[str], reduce: Callable[[DataFrame], DataFrame], fan: int = FAN) -> StreamingQuery:
    """Fold every micro-batch into a table of one row per key; ``reduce`` turns a batch into one row per key with an ``order_key``."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        RunTable(batch.sparkSession, target).fold(reduce(batch), batch_id, keys, fan)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_upsert(stream: DataFrame, target: str, checkpoint: str, order: Column, collected_at: Column, prefix: str = "", default_city: str | None = None) -> StreamingQuery:
    """``upsert_latest`` over everything that has arrived."""
    return start_keyed(stream, target, checkpoint, ["id"], lambda rows: upsert_latest(rows, order, collected_at, prefix, default_city, keep_order=True))


def start_history(stream: DataFrame, target: str, checkpoint: str, order: Column) -> StreamingQuery:
    """``price_history`` over everything that has arrived."""
    keys = ["code", "day", "source_db"]
    return start_keyed(stream, target, checkpoint, keys, lambda rows: price_history(rows, order, keep_order=True))


def latest_version(spark: SparkSession, target: str) -> DataFrame:
    """The current rows of a table kept by ``start_keyed``."""
    return RunTable(spark, target).latest().drop("order_key")
