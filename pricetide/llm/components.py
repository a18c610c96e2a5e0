"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _lowest(edges: DataFrame) -> DataFrame:
    """For each u the smallest of itself and its neighbours; combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("at"), F.least("u", "low").alias("low"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v): every node of a link with the smallest node it can reach, the node itself included; no nodes without links.

    Both stars are a minimum per node joined back to its links, so a node with any number of links is a skewed join, which
    Spark splits, and never one row. Every round is written to the shared folder; a lost executor repeats part of a round.
    """
    edges = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), F.col("u") == F.col("at")).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        joined = large.join(_lowest(large), F.col("u") == F.col("at"))
        small = joined.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(joined.select("u", F.col("low").alias("v"))).distinct()
        edges = stored(small)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.unionByName(edges.select(F.col("v").alias("u"), "v").distinct())
