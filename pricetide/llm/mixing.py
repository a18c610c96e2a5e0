"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled (hash) order. A document's virtual finish time is the source's words up to its
end divided by the source's target, so every source reaches 1 when it has given its target; one pass after another is
queued behind the first. The mix is all queued words in the order of finish times, cut where the total budget is spent: the
document in service at the cut gives the words before it.

Targets: sources ranked by code point (null last) weigh 5, 2, 1 and so on again and share the total size; no target
exceeds ``MAX_PASSES`` times its source, and what is left over is shared anew by weight until none does.

* Size is the number of words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have size 0 and give nothing.
* Order within a source: md5 of the id, then id, then size, so reruns agree; rows equal in all of these are interchangeable.
* Repeated rows are documents of their own. An empty table gives an empty mix; a table of empty texts gives targets of 0.

A source may hold a third of all rows: running sums go over buckets of (source, hash) first and inside a bucket after,
so no window holds a whole source. A bucket is a range of the hash. There is one row per source in the target table and ``n_buckets`` in the bucket table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BUCKET_ROWS = 5_000
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget: float = 1.0) -> DataFrame:
    """source, source_size and target of each source; ``sizes`` has source and size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = per.withColumn("_w", F.element_at(weights, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double"))
    # Water level: sources in the order in which they reach their limit; the level after the first j of them are full.
    ranked = ranked.withColumn("_limit", MAX_PASSES * F.col("source_size")).withColumn("_full_at", F.col("_limit") / F.col("_w"))
    order = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    weight = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("_level", left / weight).withColumn("_place", F.row_number().over(order))
    opens = F.when(F.col("_level") <= F.col("_full_at"), F.struct("_place", "_level"))
    level = level.withColumn("_open", F.coalesce(F.min(opens).over(every)["_level"], F.lit(float("inf"))))
    target = F.when(F.col("_full_at") <= F.col("_open"), F.col("_limit").cast("double")).otherwise(F.col("_open") * F.col("_w"))
    return level.select("source", "source_size", target.alias("target"))


def queue(docs: DataFrame, budget: float = 1.0) -> DataFrame:
    """One row per document: its size, source, target, the words before it in its source, words taken and first finish time."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = stored(rows)  # sizes without texts, read by each of the sums below
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)))
    per_bucket = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    along = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_start"))
    targets = source_targets(per_bucket.select("source", F.col("_sum").alias("size")), budget)
    starts = starts.join(targets, F.col("_s").eqNullSafe(F.col("source")), "left").drop("source")
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
    before = F.col("_start") + F.col("_inside")
    spent = F.floor("target")
    taken = F.lit(0)
    for passes in range(MAX_PASSES):
        begin = before + passes * F.col("source_size")
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), spent - begin))
    finish = F.when(F.col("target") > 0, (before + F.col("size")) / F.col("target"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), finish.alias("finish"), before.alias("before"))


def mix(docs: DataFrame, budget: float = 1.0) -> DataFrame:
    """The mix's documents, each once with the words taken from it, range-sorted by their first virtual finish time."""
    return queue(docs, budget).repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")
