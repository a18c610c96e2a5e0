"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "pricetide") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session of one process may do without: it gets a temporary folder that goes when Python ends.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="pricetide-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write a table several branches read, and continue from the columnar copy.

    The copy lives in the shared checkpoint folder, so it survives executors and later stages see
    its true size and only the columns they need. ``options`` go to the Parquet writer.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Below so many rows a table may lie in few row groups, as narrow ones do, and is worth dealing out before costly work on each row.
SPREAD_ROWS = 20_000_000


def spread(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """Use every core for costly row work on a small input; larger ones have enough splits and are left alone.

    ``source`` is the table behind ``df``; counting its rows reads file footers only.
    """
    if source.count() > SPREAD_ROWS:
        return df
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)
