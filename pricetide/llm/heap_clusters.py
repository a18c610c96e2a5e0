"""Centroid clustering with heap-ordered bounds, exact to the integer.

Vectors lie in blocks of some thousands. A block keeps, for each cluster, a heap of its vectors keyed by the gap between the
lower bound of the distance to any other centroid and the upper bound of the distance to the own one. When centroids move, the
gap of every vector of a cluster shrinks by the same amount at most: the drift of the own centroid plus the largest drift of
another. So heaps are not touched; the cluster's accumulated drift is compared with the keys, which are stored as gap plus the
drift accumulated when the vector entered. Only vectors at the top of a heap whose gap has expired are popped, measured against
all centroids exactly, and pushed into the heap of their cluster.

On Spark: vectors are written once, as a table of blocks bucketed by block number. Each round joins it with the last round's
table of heaps, bucketed alike (no shuffle), and writes the next one with the change of each cluster's sums; the driver gets
k x (dimensions + 1) sums and gives back centroids and drifts. Tables lie in the shared checkpoint folder; a table of heaps goes
when the next one is written. A lost executor repeats tasks of one round only.

* Kept are vectors with exactly ``dimensions`` components, none null or non-finite; component x becomes floor(1024 x). Vectors
  whose integers reach 2**48 are not kept either. Distances are exact; one that does not fit a long is null, and so are sums with it.
* Centroids start as the k kept vectors with the smallest sha256 of ``3:<vec_id>`` (ties, as of repeated ids: the smaller
  vector); there are fewer if fewer are kept. A null id has empty digits. Repeated rows are vectors of their own; equal
  centroids are allowed, the smaller number takes all. An empty table gives an empty result.
* Other columns are not looked at. Every vector weighs one, so clusters of any share of the table are spread over all blocks.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, stored

K = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
BLOCK = 2048
BUCKET_VECTORS = 1 << 17
FAST = 1 << 20  # up to this size of integers, sums of products of doubles are exact
LARGEST = 2.0**48


# ---------------------------------------------------------------- vectors as integers
def integers(array: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept, and their components as integers."""
    sizes = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fits = sizes == dimensions
    flat = array.filter(pa.array(fits)).flatten().cast(pa.float64()) if fits.any() else pa.array([], pa.float64())
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).reshape(-1, dimensions))  # null is NaN here
        good = (np.abs(values) < LARGEST).all(axis=1)
    return np.flatnonzero(fits)[good], values[good].astype(np.int64)


def block_rows(dimensions: int):
    """Packs kept vectors into blocks: number, ids, components row by row, as integers of 32 bits if they fit, else of 64."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, values = integers(batch.column("embedding"), dimensions)
            ids = batch.column("vec_id").take(pa.array(rows))
            for lo in range(0, len(rows), BLOCK):
                part = values[lo : lo + BLOCK]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + done]), pa.array([len(part)], pa.int32()), pa.array([ids.slice(lo, len(part)).to_pylist()], pa.list_(ids.type)), pa.array([(part.astype(np.int32) if small(part) else part).tobytes()], pa.binary())],
                    ["block", "n", "ids", "vectors"],
                )
                done += 1

    return pack


# ---------------------------------------------------------------- distances
def small(*arrays: np.ndarray) -> bool:
    return all(not a.size or max(int(a.max()), -int(a.min())) <= FAST for a in arrays)


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors x centroids; whole numbers in doubles if they fit, else Python integers."""
    if small(vectors, centroids):
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return (v * v).sum(axis=1)[:, None] - 2.0 * (v @ c.T) + (c * c).sum(axis=1)
    v, c = vectors.astype(object), centroids.astype(object)
    return np.stack([((v - row) ** 2).sum(axis=1) for row in c], axis=1)


def own_squares(vectors: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> list:
    """Exact squared distance of each vector to its own centroid; null where it does not fit a long."""
    if small(vectors, centroids):
        away = vectors - centroids[cluster]
        return (away * away).sum(axis=1).tolist()
    away = (vectors.astype(object) - centroids.astype(object)[cluster]) ** 2
    return [int(x) if x < 2**63 else None for x in away.sum(axis=1)]


def gaps(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) of each row, and a safe lower estimate of second distance minus first."""
    nearest = np.argmin(squared, axis=1)
    if squared.shape[1] == 1:
        return nearest, np.full(len(squared), np.inf)
    rest = squared.copy()
    first = squared[np.arange(len(squared)), nearest].astype(np.float64)
    rest[np.arange(len(squared)), nearest] = np.max(squared, axis=1) + 1
    second = np.min(rest, axis=1).astype(np.float64)
    # The doubles below are off by less than a millionth of a millionth of the larger distance.
    return nearest, np.sqrt(second) * (1 - 1e-12) - np.sqrt(first) * (1 + 1e-12)


def shrinkage(old: list[list[int]], new: list[list[int]]) -> list[float]:
    """How much the gap of a cluster's vectors can shrink: own drift plus the largest of the others, rounded up."""
    drift = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5 * (1 + 1e-9) for x, y in zip(old, new, strict=True)]
    return [d + max([0.0, *drift[:j], *drift[j + 1 :]]) for j, d in enumerate(drift)]


# ---------------------------------------------------------------- heaps of a block
class Heaps:
    """A heap of (key, vector) for each cluster. key <= accumulated drift means that the gap has expired."""

    def __init__(self, heaps: list[list[tuple[float, int]]]) -> None:
        self.heaps = heaps

    @classmethod
    def load(cls, sizes: list[int], keys: bytes, members: bytes) -> Heaps:
        pairs = list(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(members, np.int32).tolist(), strict=True))
        ends = np.cumsum(sizes).tolist()
        return cls([pairs[e - s : e] for s, e in zip(sizes, ends, strict=True)])  # in heap order as they were stored

    def dump(self) -> tuple[list[int], bytes, bytes]:
        pairs = [p for heap in self.heaps for p in heap]
        return [len(h) for h in self.heaps], np.array([p[0] for p in pairs], np.float64).tobytes(), np.array([p[1] for p in pairs], np.int32).tobytes()

    def expired(self, drifted: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Pops every vector whose gap has expired; the vectors and the clusters they were in."""
        out, of = [], []
        for j, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drifted[j]:
                out.append(heapq.heappop(heap)[1])
                of.append(j)
        return np.array(out, np.int64), np.array(of, np.int64)

    def push(self, members: np.ndarray, clusters: np.ndarray, gap: np.ndarray, drifted: list[float]) -> None:
        for i, j, g in zip(members.tolist(), clusters.tolist(), gap.tolist(), strict=True):
            heapq.heappush(self.heaps[j], (g + drifted[j] * (1 - 1e-12), i))

    def clusters(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for j, heap in enumerate(self.heaps):
            out[[i for _, i in heap]] = j
        return out


def change(vectors: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> list[int]:
    """What a block adds to the counts and sums of each cluster, as one flat list: count and components by cluster."""
    out = np.zeros((k, 1 + vectors.shape[1]), np.int64)
    for j in range(k):
        for sign, of in ((1, new), (-1, old)):
            if of is not None and (mine := of == j).any():
                out[j, 0] += sign * int(mine.sum())
                out[j, 1:] += sign * vectors[mine].sum(axis=0)
    return out.ravel().tolist()


STATE = "block long, sizes array<int>, keys binary, members binary, added array<long>, scanned int"


def state_row(block: int, heaps: Heaps, added: list[int], scanned: int) -> pa.RecordBatch:
    sizes, keys, members = heaps.dump()
    return pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array([sizes], pa.list_(pa.int32())), pa.array([keys], pa.binary()), pa.array([members], pa.binary()), pa.array([added], pa.list_(pa.int64())), pa.array([scanned], pa.int32())],
        ["block", "sizes", "keys", "members", "added", "scanned"],
    )


def _blocks(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[dict, np.ndarray]]:
    for r in range(batch.num_rows):
        row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
        raw = row["vectors"]
        yield row, np.frombuffer(raw, np.int32 if len(raw) == 4 * row["n"] * dimensions else np.int64).reshape(row["n"], dimensions).astype(np.int64)


def first_round(centroids: list[list[int]]):
    """Every vector against every centroid; builds the heaps."""
    at = np.array(centroids, np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, vectors in _blocks(batch, at.shape[1]):
                nearest, gap = gaps(squares(vectors, at))
                heaps = Heaps([[] for _ in at])
                heaps.push(np.arange(len(vectors)), nearest, gap, [0.0] * len(at))
                yield state_row(row["block"], heaps, change(vectors, None, nearest, len(at)), len(vectors))

    return scan


def next_round(centroids: list[list[int]], drifted: list[float]):
    """Pops expired vectors, measures them exactly and pushes them where they belong now."""
    at = np.array(centroids, np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, vectors in _blocks(batch, at.shape[1]):
                heaps = Heaps.load(row["sizes"], row["keys"], row["members"])
                popped, old = heaps.expired(drifted)
                added = [0] * (len(at) * (1 + at.shape[1]))
                if len(popped):
                    nearest, gap = gaps(squares(vectors[popped], at))
                    heaps.push(popped, nearest, gap, drifted)
                    moved = nearest != old
                    added = change(vectors[popped[moved]], old[moved], nearest[moved], len(at))
                yield state_row(row["block"], heaps, added, len(popped))

    return scan


def results(centroids: list[list[int]]):
    """Cluster and exact distance of every vector of a block."""
    at = np.array(centroids, np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for r, (row, vectors) in enumerate(_blocks(batch.drop_columns("ids"), at.shape[1])):
                cluster = Heaps.load(row["sizes"], row["keys"], row["members"]).clusters(len(vectors))
                yield pa.RecordBatch.from_arrays([ids[r].values, pa.array(cluster.astype(np.int32)), pa.array(own_squares(vectors, at, cluster), pa.int64())], ["vec_id", "cluster", "distance"])

    return spread


# ---------------------------------------------------------------- rounds
class _Bucketed:
    """Tables of a run in the shared folder, bucketed by block; each goes when it is dropped."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.name = spark, buckets, f"clusters_{uuid.uuid4().hex}"
        self.root = re.sub(r"/+$", "", checkpoint_dir(spark))

    def write(self, df: DataFrame, what: str) -> DataFrame:
        table = f"{self.name}_{what}"
        df.write.bucketBy(self.buckets, "block").option("path", f"{self.root}/{table}").format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, what: str) -> None:
        """The table and its files, which lie outside the warehouse."""
        table = f"{self.name}_{what}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def starting(vectors: DataFrame, k: int, dimensions: int) -> list[list[int]]:
    """The components of the k kept vectors with the smallest hashes."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = integers(batch.column("embedding"), dimensions)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(values.tolist(), pa.list_(pa.int64()))], ["vec_id", "v"])

    rows = vectors.mapInArrow(kept, f"vec_id {kind}, v array<long>").orderBy(digest, "v").limit(k).collect()
    return [list(r["v"]) for r in rows]


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, cluster, distance) as a stored table, the final centroids, and how many vectors each round measured."""
    spark = table.sparkSession
    given = table.select("vec_id", "embedding")
    kind = given.schema["vec_id"].dataType.simpleString()
    centroids = starting(given, k, dimensions)
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), [], []
    packed = given.mapInArrow(block_rows(dimensions), f"block long, n int, ids array<{kind}>, vectors binary")
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    tables = _Bucketed(spark, min(most, max(spark.sparkContext.defaultParallelism, -(-given.count() // BUCKET_VECTORS))))
    vectors = tables.write(packed, "vectors")
    state = tables.write(vectors.select("block", "n", "vectors").mapInArrow(first_round(centroids), STATE), "heaps_0")
    sums = np.zeros((len(centroids), 1 + dimensions), object)
    drifted, scanned = [0.0] * len(centroids), []

    def heaps(*more: str) -> DataFrame:
        kept = state.select("block", "sizes", "keys", "members").hint("shuffle_hash")
        return vectors.select("block", "n", "vectors", *more).join(kept, "block")

    for turn in range(rounds + 1):
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if turn == rounds:
            break
        added = state.select(F.posexplode("added")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
        for r in added:
            sums[r["pos"] // (1 + dimensions), r["pos"] % (1 + dimensions)] += int(r["s"])
        moved = [[int(x) // int(s[0]) for x in s[1:]] if s[0] else c for s, c in zip(sums, centroids, strict=True)]
        drifted = [d + x for d, x in zip(drifted, shrinkage(centroids, moved), strict=True)]
        centroids = moved
        state = tables.write(heaps().mapInArrow(next_round(centroids, drifted), STATE), f"heaps_{turn + 1}")
        tables.drop(f"heaps_{turn}")
    out = stored(heaps("ids").mapInArrow(results(centroids), f"vec_id {kind}, cluster int, distance long"))
    tables.drop(f"heaps_{rounds}")
    tables.drop("vectors")
    return out, centroids, scanned


def heap_clusters(table: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """Per vector: cluster, squared distance, its sum over the cluster and over all, digest of the final centroid."""
    out, centroids, _ = cluster(table, k, rounds, dimensions)
    spark = table.sparkSession
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(whole.alias("s")).collect()}  # k rows at most
    fits = [None if s is None or s >= 2**63 else int(s) for s in (*per.values(), None if None in per.values() else sum(per.values()))]
    named = [(j, s, fits[-1], hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, s in zip(per, fits, strict=False)]
    named = spark.createDataFrame(named, "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), F.col("cluster") == F.col("_c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
