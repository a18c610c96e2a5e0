"""Long-run rates: ratio of sums, bootstrap, credibility, district trend and fuzzy adjustment."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import fuzzy
from ..functions.hashing import DRAWS, poisson_thresholds
from ..functions.numbers import clamp
from ..session import stored
from .ordered import Quantile, aggregate, join_keys, prefix_counts

CREDIBILITY_K = 30
MIN_SEGMENT_ENTITIES = 5
BOOTSTRAP_REPLICAS = 1000
MIN_RULER_ENTITIES = 10
TREND_SHRINKAGE = 20
TREND_LIMIT = 50.0
SEGMENT = ["district", "kind"]


def entity_sums(pairs: DataFrame) -> DataFrame:
    """Total log change and months of each code."""
    return pairs.groupBy("code").agg(
        F.min("district").alias("district"),
        F.min("kind").alias("kind"),
        F.sum("dlog").alias("dlog"),
        F.sum("gap").alias("gap"),
    )


def segment_rates(sums: DataFrame) -> DataFrame:
    """Monthly rate (sum of changes over sum of months) by segment and by kind."""
    base = sums.groupBy(*SEGMENT).agg(
        F.sum("dlog").alias("d"), F.sum("gap").alias("g"), F.count("*").alias("n")
    )
    cols = [F.col(c) for c in SEGMENT]
    rolled = base.groupingSets([cols, [F.col("kind")]], *cols).agg(
        F.sum("d").alias("d"), F.sum("g").alias("months"), F.sum("n").alias("entities"), F.grouping_id().alias("gid")
    )
    level = F.when(F.col("gid") == 0, "segment").otherwise("kind")
    return rolled.select(level.alias("level"), *SEGMENT, (F.col("d") / F.col("months")).alias("monthly"), "months", "entities")


def bootstrap_sums(sums: DataFrame, replicas: int = BOOTSTRAP_REPLICAS, seed: str = "42") -> DataFrame:
    """Weighted sums of every (segment, replica): each code counts Poisson(1) times in a replica.

    Weights come from a hash of the code and a block of four replicas, so any engine or retry draws the same sample. Rows
    are dealt out by code and sorted by segment, so a task holds the sums of one segment at a time and sends one row for each.
    """
    # Every row makes a digest for each block, so few input rows are spread over all cores first.
    session = sums.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    rows = sums.select(*SEGMENT, F.col("code").cast("string").alias("code"), F.col("dlog").cast("double").alias("dlog"), F.col("gap").cast("double").alias("gap"))
    rows = rows.repartition(tasks, "code").sortWithinPartitions(*SEGMENT)
    types = dict(sums.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in SEGMENT), "d array<double>", "g array<double>"])
    held = rows.mapInArrow(lambda batches: _segment_sums(batches, replicas, seed), schema)
    each = held.select(*SEGMENT, F.posexplode(F.arrays_zip("d", "g")).alias("place", "s"))
    months = F.sum("s.g")
    months = months if types["gap"] in ("double", "float") else F.round(months).cast("long")
    return each.groupBy(*SEGMENT, (F.col("place") + 1).alias("replica")).agg(F.sum("s.d").alias("d"), months.alias("g"))


def _segment_sums(batches, replicas: int, seed: str):
    """Arrow batches sorted by segment to one row per segment: ``replicas`` weighted sums of ``dlog`` and of ``gap``."""
    bounds = np.array([math.ceil(b * 2**32) for b in poisson_thresholds()], dtype=np.uint64)
    tails = [f"{block}|{seed}".encode() for block in range(-(-replicas // DRAWS))]

    def weights(codes: list) -> np.ndarray:
        heads = [b"" if code is None else code.encode() + b"|" for code in codes]
        digests = b"".join(md5(head + tail).digest() for head in heads for tail in tails)
        draws = np.frombuffer(digests, dtype=">u4").reshape(len(codes), -1)[:, :replicas]
        return np.searchsorted(bounds, draws.astype(np.uint64), side="right").astype(np.float64)

    def row(key, sums, known):
        values = [pa.array([v.tolist() if k else None], pa.list_(pa.float64())) for v, k in zip(sums, known)]
        return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types)), *values], names=[*SEGMENT, "d", "g"])

    key, sums, known, types = None, None, None, None
    for batch in batches:
        types = [batch.schema.field(c).type for c in SEGMENT]
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            keys = list(zip(*(part.column(c).to_pylist() for c in SEGMENT)))
            columns = [part.column(c) for c in ("dlog", "gap")]
            given = [np.array(c.is_valid()) for c in columns]
            values = [np.array(c.fill_null(0.0)) for c in columns]
            drawn = weights(part.column("code").to_pylist())
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for lo, hi in zip([0, *ends], ends):
                if keys[lo] != key:
                    if sums is not None:
                        yield row(key, sums, known)
                    key, sums, known = keys[lo], np.zeros((2, replicas)), [False, False]
                sums += np.stack([(drawn[lo:hi] * v[lo:hi, None]).sum(axis=0) for v in values])
                known = [k or bool(g[lo:hi].any()) for k, g in zip(known, given)]
    if sums is not None:
        yield row(key, sums, known)


def replica_rates(boot: DataFrame) -> DataFrame:
    """Rate of each replica by segment and by kind; the kind adds up its segments."""
    cols = [F.col(c) for c in (*SEGMENT, "replica")]
    rolled = boot.groupingSets([cols, [F.col("kind"), F.col("replica")]], *cols).agg(
        F.sum("d").alias("d"), F.sum("g").alias("g"), F.grouping_id().alias("gid")
    )
    level = F.when(F.col("gid") == 0, "segment").otherwise("kind")
    return rolled.filter("g > 0").select(level.alias("level"), *SEGMENT, "replica", (F.col("d") / F.col("g")).alias("rate"))


def _interval(interval: tuple[float, float]) -> list[Quantile]:
    rate = F.col("rate")
    return [Quantile("monthly_low", rate, interval[0]), Quantile("monthly_high", rate, interval[1])]


def bootstrap_rates(sums: DataFrame, replicas: int = BOOTSTRAP_REPLICAS, seed: str = "42", interval=(0.10, 0.90)) -> DataFrame:
    """Point rate with the p10/p90 of its bootstrap, by segment and by kind."""
    rates = stored(replica_rates(bootstrap_sums(sums, replicas, seed)))  # read several times, and the draws are costly
    spread = aggregate(
        rates,
        ["level", *SEGMENT],
        [],
        _interval(interval),
    )
    point = segment_rates(sums)
    same = (
        (point["level"] == spread["level"])
        & (point["kind"] == spread["kind"])
        & point["district"].eqNullSafe(spread["district"])
    )
    return point.join(spread, same).select(
        point["level"], point["district"], point["kind"], "entities", "monthly", "monthly_low", "monthly_high"
    )


def credibility_rates(
    sums: DataFrame,
    replicas: int = BOOTSTRAP_REPLICAS,
    k: int = CREDIBILITY_K,
    min_entities: int = MIN_SEGMENT_ENTITIES,
    seed: str = "42",
    interval=(0.10, 0.90),
) -> DataFrame:
    """Segment rates pulled to their kind with weight n / (n + k): the point and every replica."""
    rates = stored(replica_rates(bootstrap_sums(sums, replicas, seed)))  # read several times, and the draws are costly
    points = segment_rates(sums)
    own = points.filter(f"level = 'segment' AND entities >= {int(min_entities)}").select(
        *SEGMENT, F.col("monthly").alias("raw"), "entities"
    )
    own = own.withColumn("weight", F.col("entities") / (F.col("entities") + F.lit(float(k))))
    kind_points = points.filter("level = 'kind'").select("kind", F.col("monthly").alias("kind_monthly"))
    fine = rates.filter("level = 'segment'").select(*SEGMENT, "replica", "rate")
    coarse = rates.filter("level = 'kind'").select("kind", "replica", F.col("rate").alias("kind_rate"))
    mixed = own.join(fine, SEGMENT).join(coarse, ["kind", "replica"])
    mixed = mixed.withColumn("rate", F.col("weight") * F.col("rate") + (1 - F.col("weight")) * F.col("kind_rate"))
    spread = aggregate(
        mixed,
        SEGMENT,
        [],
        _interval(interval),
    )
    blended = F.col("weight") * F.col("raw") + (1 - F.col("weight")) * F.col("kind_monthly")
    return (
        own.join(kind_points, "kind")
        .withColumn("monthly", blended)
        .join(spread, SEGMENT)
        .select(*SEGMENT, "entities", "weight", "raw", "monthly", "monthly_low", "monthly_high")
    )


def rate_lookup(rows: DataFrame, segment: DataFrame, kind: DataFrame, value: str = "monthly") -> DataFrame:
    """Rate of the row's segment, else of its kind, with where it came from."""
    fine = segment.select(*SEGMENT, F.col(value).alias("__fine"))
    coarse = kind.select("kind", F.col(value).alias("__coarse"))
    df = rows.join(fine, SEGMENT, "left").join(coarse, "kind", "left")
    source = F.when(F.col("__fine").isNotNull(), "district").otherwise("kind")
    return df.withColumn(value, F.coalesce("__fine", "__coarse")).withColumn("rate_source", source).drop("__fine", "__coarse")


# ---------------------------------------------------------------- trend and rulers
def district_trend(panel: DataFrame, features: DataFrame, limit: float = TREND_LIMIT) -> DataFrame:
    """Mean annualised change between the first and last month of each code, by kind and district."""
    ends = panel.groupBy("code").agg(
        F.min_by("price", "month_n").alias("p0"),
        F.max_by("price", "month_n").alias("p1"),
        F.min("month_n").alias("m0"),
        F.max("month_n").alias("m1"),
    )
    annual = F.log(F.col("p1") / F.col("p0")) * 12 / (F.col("m1") - F.col("m0")) * 100
    ends = ends.filter("m1 > m0").withColumn("annual", clamp(annual, -limit, limit))
    return (
        ends.join(features.select("code", *SEGMENT), "code")
        .groupBy("kind", "district")
        .agg(F.avg("annual").alias("trend_pct"), F.count("*").alias("entities"))
    )


def fuzzy_rulers(train: DataFrame, trend: DataFrame, min_entities: int = MIN_RULER_ENTITIES, shrink: int = TREND_SHRINKAGE) -> tuple[DataFrame, DataFrame]:
    """(by kind: median price per area and area; by district: relative price and shrunk trend)."""
    priced = train.withColumn("price_m2", F.col("price") / F.col("area_ref"))
    kinds = aggregate(
        priced, ["kind"], [], [Quantile("kind_price_m2", F.col("price_m2")), Quantile("kind_area", F.col("area_ref"))]
    )
    districts = aggregate(
        priced, ["kind", "district"], [F.count("*").alias("n")], [Quantile("district_price_m2", F.col("price_m2"))]
    )
    districts = (
        districts.filter(F.col("n") >= min_entities)
        .join(kinds.select("kind", "kind_price_m2"), "kind")
        .select("kind", "district", (F.col("district_price_m2") / F.col("kind_price_m2")).alias("district_price"))
    )
    n = F.col("entities")
    trends = trend.filter(n >= min_entities).select(
        "kind", "district", (F.col("trend_pct") * n / (n + F.lit(float(shrink)))).alias("trend")
    )
    return kinds, districts.join(trends, ["kind", "district"], "full")


def fuzzy_inputs(rows: DataFrame, kinds: DataFrame, districts: DataFrame) -> DataFrame:
    """Relative district price (default 1), relative area and trend (default 0) of each row."""
    df = rows.join(kinds, "kind").join(districts, ["kind", "district"], "left")
    return (
        df.withColumn("district_price", F.coalesce("district_price", F.lit(1.0)))
        .withColumn("trend", F.coalesce("trend", F.lit(0.0)))
        .withColumn("area", F.col("area_ref") / F.col("kind_area"))
        .drop("kind_price_m2", "kind_area")
    )


def fuzzy_columns() -> tuple[dict[tuple[str, str], Column], list[Column], Column]:
    """(degrees, rule strengths, raw adjustment) over the columns of ``fuzzy_inputs``."""
    degrees = fuzzy.memberships({name: F.col(name) for name in fuzzy.INPUT_SETS})
    strengths = fuzzy.rule_strengths(degrees, F.col("kind"))
    return degrees, strengths, fuzzy.centroid(fuzzy.term_heights(strengths))


def center_by(df: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """Deviation from the mean of the group; the mean combines on the map side and joins back."""
    means = df.groupBy(key).agg(F.avg(value).alias("__mean"))
    return join_keys(df, means, [key]).withColumn(out, F.col(value) - F.col("__mean")).drop("__mean")


def fuzzy_adjustment(inputs: DataFrame) -> DataFrame:
    """Raw adjustment of each row and the same with zero mean per kind."""
    _, _, raw = fuzzy_columns()
    # Centring reads the rows twice, so the costly column is written once.
    return center_by(stored(inputs.withColumn("raw_pp", raw)), "raw_pp", "kind", "adjustment_pp")


def fuzzy_explanation(inputs: DataFrame) -> DataFrame:
    """Degrees, fired rules with strengths, and the raw adjustment."""
    degrees, strengths, raw = fuzzy_columns()
    df = inputs
    for (name, term), degree in degrees.items():
        df = df.withColumn(f"{name}_{term}", degree)
    rules = []
    for (conditions, out), strength in zip(fuzzy.RULES, strengths):
        label = " & ".join(f"{k}={v}" for k, v in conditions.items()) + f" -> {out}"
        rules.append(F.struct(F.lit(label).alias("rule"), strength.alias("strength")))
    return df.withColumn("rules", F.array(*rules)).withColumn("raw_pp", raw)


def projected_rates(rows: DataFrame, weight: str = "data_weight") -> DataFrame:
    """Blended annual rates plus the share of the row's adjustment the index part carries."""
    share = (1 - F.col(weight)) * F.col("adjustment_pp")
    df = rows
    for name, rate in (("central_pct", "monthly"), ("low_pct", "monthly_low"), ("high_pct", "monthly_high")):
        df = df.withColumn(name, 100.0 * F.expm1(12.0 * F.col(rate)) + share)
    return df


def distribution(df: DataFrame, keys: list[str], value: str, min_n: int = 1) -> DataFrame:
    """n, min, p10, median, mean, p90, max of a column by group."""
    col = F.col(value)
    out = aggregate(
        df,
        keys,
        [F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean")],
        [Quantile("p10", col, 0.10), Quantile("median", col), Quantile("p90", col, 0.90)],
    )
    return out.filter(F.col("n") >= min_n).select(*keys, "n", "min", "p10", "median", "mean", "p90", "max")


def positional_sample(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Rows at positions 0, n/3, 2n/3 and n-1 of each group ordered by (value, tie).

    Prefix sums over distinct values find the values that hold a wanted position, prefix sums over the ties of those values
    the rows. ``tie`` is a number, unique in the group.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("rows"))
    placed = prefix_counts(counts, keys, value)
    n = F.col("total_rows")
    wanted = F.array(F.lit(0).cast("long"), F.floor(n / 3), F.floor(2 * n / 3), n - 1)
    holds = F.filter(F.array_distinct(wanted), lambda p: (p >= F.col("before_rows")) & (p < F.col("before_rows") + F.col("rows")))
    placed = placed.select(*keys, value, F.col("before_rows").alias("__off"), n.alias("group_rows"), holds.alias("__wanted")).filter(F.size("__wanted") > 0)
    hit = join_keys(df, placed, [*keys, value]).withColumn("rows", F.lit(1).cast("long"))
    hit = prefix_counts(hit, [*keys, value], tie).withColumn("position", F.col("__off") + F.col("before_rows"))
    return hit.filter(F.array_contains("__wanted", F.col("position"))).drop("__off", "__wanted", "rows", "before_rows", "total_rows")
