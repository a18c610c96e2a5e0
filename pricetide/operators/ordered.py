"""Exact order statistics that do not depend on a group fitting into one task.

Values of a group are counted per distinct value. Distinct values fall into fine bins, four thousand to a coarse bin that
spans about 0.14 % of its value; NaN and the infinities have bins of their own at the ends (NaN above everything). Prefix
sums run over the coarse bins of a group (a bounded number), over the fine bins of a coarse bin (at most 4,096) and inside
a fine bin, so a group with any share of the rows, packed as densely as prices in cents are, is spread over many tasks.

Where no group can have more than ``BUFFER_VALUES`` rows, which counts over buckets of groups tell, quantiles are aggregates
beside the others, in one shuffle. Else they read their counts from a written table, so each group's number of distinct values is known: groups of at most
``BUFFER_VALUES`` are solved by one aggregate whose buffer holds that many counts, all others by the bins. All ways give the
same numbers (tests run each).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

FINE_BITS = 12
BINS_PER_OCTAVE = 512
BIN_BASE = 600_000
#: Distinct values of a group that one aggregate may hold.
BUFFER_VALUES = 100_000
#: Buckets whose counts bound the rows of the groups in them.
GROUP_BUCKETS = 1 << 16


@dataclass(frozen=True)
class Quantile:
    """Linear-interpolated quantile ``p`` of ``value``; null values are ignored."""

    name: str
    value: Column
    p: float = 0.5


def fine_bin(col: Column) -> Column:
    """Monotone bin of a number; ``FINE_BITS`` fewer bits give its coarse bin."""
    x = col.cast("double")
    size = F.floor(F.log2(F.abs(x)) * (BINS_PER_OCTAVE << FINE_BITS)) + (BIN_BASE << FINE_BITS)
    end = F.lit(4 * BIN_BASE << FINE_BITS)
    edges = F.when(F.isnan(x), 2 * end).when(x == float("inf"), end).when(x == float("-inf"), -end)
    return edges.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("long")


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on key columns where null equals null; keys come from the left side."""
    if not keys:
        return attach(left, right, keys)
    renamed = right
    condition = None
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__key_{key}")
        test = left[key].eqNullSafe(F.col(f"__key_{key}"))
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"__key_{key}" for key in keys])


def attach(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a table of one row per group, null keys included; without keys the table is a single row."""
    if keys:
        return join_keys(df, table, keys, "left")
    row = table.select(F.struct(*table.columns)).scalar()
    return df.withColumn("__row", row).select(*df.columns, "__row.*")


def prefix_counts(
    counts: DataFrame, keys: list[str], value: str = "value", rows: str = "rows", measures: tuple[str, ...] = ()
) -> DataFrame:
    """Add rows strictly before each distinct value, and the group total, in value order.

    ``counts`` has one row per (keys, value). ``measures`` are further columns to accumulate the
    same way, as ``before_<name>`` and ``total_<name>``.
    """
    names = (rows, *measures)
    binned = counts.withColumn("__fine", fine_bin(F.col(value)))
    inside = Window.partitionBy(*keys, "__fine").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = join_keys(binned, _offsets(binned, keys, names), [*keys, "__fine"])
    for n in names:
        out = out.withColumn(f"before_{n}", F.col(f"__off_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return out.drop("__fine", *[f"__{kind}_{n}" for n in names for kind in ("off", "in")])


def _offsets(binned: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    """One row per fine bin: its sum, what lies before it in its group, and the group's total, for every measure."""
    fine = binned.groupBy(*keys, "__fine").agg(*[F.sum(n).alias(f"__in_{n}") for n in names])
    fine = fine.withColumn("__bin", F.shiftright("__fine", FINE_BITS))
    coarse = fine.groupBy(*keys, "__bin").agg(*[F.sum(f"__in_{n}").alias(f"__sum_{n}") for n in names])
    group, bin_ = Window.partitionBy(*keys), Window.partitionBy(*keys, "__bin")
    earlier_bins = group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    earlier = bin_.orderBy("__fine").rowsBetween(Window.unboundedPreceding, -1)
    for n in names:
        coarse = coarse.withColumn(f"__base_{n}", F.coalesce(F.sum(f"__sum_{n}").over(earlier_bins), F.lit(0)))
        coarse = coarse.withColumn(f"total_{n}", F.sum(f"__sum_{n}").over(group))
        fine = fine.withColumn(f"__off_{n}", F.coalesce(F.sum(f"__in_{n}").over(earlier), F.lit(0)))
    out = join_keys(fine, coarse, [*keys, "__bin"])
    out = out.withColumns({f"__off_{n}": F.col(f"__off_{n}") + F.col(f"__base_{n}") for n in names})
    return out.drop("__bin", *[f"__{kind}_{n}" for n in names for kind in ("sum", "base")])


def average_ranks(counts: DataFrame, keys: list[str], value: str, rows: str = "rows") -> DataFrame:
    """One row per (keys, value) with the average rank of its ties, 1-based."""
    ranked = prefix_counts(counts, keys, value, rows)
    return ranked.withColumn("rank", F.col(f"before_{rows}") + (F.col(rows) + 1) / 2.0)


def aggregate(df: DataFrame, keys: list[str], aggs: list[Column], quantiles: list[Quantile]) -> DataFrame:
    """``groupBy(keys)`` with plain aggregates and exact quantiles."""
    if not quantiles:
        return df.groupBy(*keys).agg(*aggs)
    if _most_rows(df, keys) <= BUFFER_VALUES:
        return df.groupBy(*keys).agg(*aggs, *_percentiles(quantiles))
    picked = _quantiles(df, keys, quantiles)
    rest = df.groupBy(*keys).agg(*aggs) if aggs else df.groupBy(*keys).agg(F.count("*").alias("__n")).drop("__n")
    order = [*keys, *rest.columns[len(keys):], *[q.name for q in quantiles]]
    return join_keys(rest, picked, keys, "left").select(*order)


def _most_rows(df: DataFrame, keys: list[str]) -> int:
    """An upper bound on the rows of a group, counted over buckets of groups: a shuffle of a few numbers, whatever the groups."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(GROUP_BUCKETS)) if keys else F.lit(0)
    return df.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0


def _percentiles(quantiles: list[Quantile]) -> list[Column]:
    """Quantiles as aggregates beside others; adding zero makes -0.0 and 0.0 one value, as counting them does."""
    return [F.percentile(q.value.cast("double") + F.lit(0.0), float(q.p)).alias(q.name) for q in quantiles]


def _quantiles(df: DataFrame, keys: list[str], quantiles: list[Quantile]) -> DataFrame:
    """Quantiles of one value column share its counts."""
    shared: dict[int, list[Quantile]] = {}
    for q in quantiles:
        shared.setdefault(id(q.value), []).append(q)
    values = [group[0].value for group in shared.values()]
    entries = F.array(*[F.struct(F.lit(i).alias("__metric"), v.cast("double").alias("__value")) for i, v in enumerate(values)])
    long = df.select(*keys, F.explode(entries).alias("__e")).select(*keys, "__e.__metric", "__e.__value")
    group = [*keys, "__metric"]
    counts = long.filter("__value IS NOT NULL").groupBy(*group, "__value").agg(F.count("*").alias("__rows"))
    counts = stored(counts)
    shares = [[float(q.p) for q in g] for g in shared.values()]
    sizes = counts.groupBy(*group).agg(F.count("*").alias("__distinct"))
    most = sizes.agg(F.max("__distinct")).first()[0] or 0
    if most <= BUFFER_VALUES:
        solved = _buffered(counts, group, shares)
    else:
        heavy = sizes.filter(F.col("__distinct") > BUFFER_VALUES).drop("__distinct")
        light = join_keys(counts, heavy, group, "left_anti")
        solved = _buffered(light, group, shares).unionByName(_binned(join_keys(counts, heavy, group, "left_semi"), group, shares))
    return solved.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__metric") == m, F.get("__q", F.lit(i)))).alias(q.name) for m, g in enumerate(shared.values()) for i, q in enumerate(g)]
    )


def _buffered(counts: DataFrame, group: list[str], shares: list[list[float]]) -> DataFrame:
    """Column ``__q``: each group's quantiles from one buffer of counts; shares differ by metric."""
    every = sorted({p for ps in shares for p in ps})
    places = F.create_map(*[x for m, ps in enumerate(shares) for x in (F.lit(m), F.array(*[F.lit(every.index(p)) for p in ps]))])
    held = counts.groupBy(*group).agg(F.percentile("__value", every, F.col("__rows")).alias("__all"))
    return held.select(*group, F.transform(places[F.col("__metric")], lambda i: F.get("__all", i)).alias("__q"))


def _binned(counts: DataFrame, group: list[str], shares: list[list[float]]) -> DataFrame:
    """Column ``__q`` by prefix sums over bins, for groups of any size."""
    probs = F.create_map(*[x for m, ps in enumerate(shares) for x in (F.lit(m), F.array(*map(F.lit, ps)))])
    binned = counts.withColumn("__fine", fine_bin(F.col("__value")))
    offsets = _offsets(binned, group, ("__rows",))
    position = F.transform(probs[F.col("__metric")], lambda p: (F.col("total___rows") - 1) * p)
    ends = F.flatten(F.transform(position, lambda p: F.array(F.floor(p), F.ceil(p))))
    wanted = offsets.withColumn("__positions", position)
    low, high = F.col("__off___rows"), F.col("__off___rows") + F.col("__in___rows")
    wanted = wanted.filter(F.exists(ends, lambda e: (e >= low) & (e < high))).drop("__in___rows", "total___rows")
    inside = Window.partitionBy(*group, "__fine").orderBy("__value").rowsBetween(Window.unboundedPreceding, -1)
    picked = join_keys(binned, wanted, [*group, "__fine"]).withColumn(
        "__before", F.col("__off___rows") + F.coalesce(F.sum("__rows").over(inside), F.lit(0))
    )

    def at(i: int, end) -> Column:
        place = end(F.get("__positions", F.lit(i)))
        return F.max(F.when((place >= F.col("__before")) & (place < F.col("__before") + F.col("__rows")), F.col("__value")))

    most = max(map(len, shares))
    columns = [c for i in range(most) for c in (at(i, F.floor).alias(f"__lo{i}"), at(i, F.ceil).alias(f"__hi{i}"))]
    solved = picked.groupBy(*group).agg(*columns, F.first("__positions").alias("__positions"))

    def between(i: int) -> Column:
        lo, hi, place = F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.get("__positions", F.lit(i))
        share = place - F.floor(place)
        return F.when((share == 0) | (lo == hi), lo).otherwise((1 - share) * lo + share * hi)

    return solved.select(*group, F.array(*[between(i) for i in range(most)]).alias("__q"))
