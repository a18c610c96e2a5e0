"""Regression trees over binned rows, grown beside the data.

Numbers fall into at most ``maxBins`` bins, categories are ordered by their mean target in a node, and the split with the greatest
fall of the squared error is taken, as MLlib does. Only what is kept of a node differs: a node of many rows is split from
histograms that tasks add up over their own rows, one of at most ``NODE_ROWS`` rows meets in one task and is finished there. So
no histogram of a small node travels, which is what deep forests are made of. Trees of a forest are rows of a table and never
reach the driver; the trees of boosting are small ones and do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Rows of a node that one task finishes, and the most rows in a block of the boosting's state.
NODE_ROWS = 100_000
BLOCK_ROWS = 500_000
# Up to so many blocks are smaller ones of ``NODE_ROWS``, so that few rows fill the cores.
BLOCKS = 12
# Rows whose distinct values are counted one by one, and distinct values counted so in more rows.
COUNTED_ROWS, COUNTED_VALUES = 10_000, 1_000
# Groups of trees that are grown and asked apart, trees whose upper nodes are split in one pass, distinct rows asked together.
GROUPS = 24
TOPS = 50
ASKED = 200_000
# Bins of a feature that are judged at once, and rows of trees that are grown together.
JUDGED = 1 << 15
TOGETHER = 20_000
# Rows times trees that are worth a task of their own.
GROUP_ROWS = 2_000_000
# Rounds after which the state of boosting is written, which ends its lineage.
KEEP_ROUNDS = 20
NOISE = 1e-13
TREES = "part int, tree int, leaf int, feature binary, cut binary, left binary, value binary, sets binary"


def blocks_for(rows: int) -> int:
    """How many blocks so many rows make; it follows from the rows alone, like the trees."""
    return max(1, min(-(-rows // NODE_ROWS), BLOCKS), -(-rows // BLOCK_ROWS))


# ---------------------------------------------------------------- bins
@dataclass(frozen=True)
class Bins:
    """Cut points of every number, None for categories, and how many bins each feature has.

    ``exact``: all values were counted, so the cut points do not depend on the order of the rows.
    """

    cuts: list
    sizes: list
    exact: bool = True

    @property
    def nominal(self) -> np.ndarray:
        return np.array([c is None for c in self.cuts])

    def of(self, rows: np.ndarray) -> np.ndarray:
        """(features, rows) of bin numbers."""
        kind = np.min_scalar_type(max(self.sizes))
        return np.stack([(rows[:, f] if c is None else np.searchsorted(c, rows[:, f])).astype(kind) for f, c in enumerate(self.cuts)])


def _cuts(values: list[tuple[float, int]], rows: int, most: int) -> list[float]:
    """Cut points between counted values: all, or those nearest to equal shares of the rows."""
    values = sorted(values)
    middles = [(a[0] + b[0]) / 2.0 for a, b in zip(values, values[1:])]
    if len(middles) < most:
        return middles
    stride, found = rows / most, []
    seen, target = values[0][1], rows / most
    for middle, (_, n) in zip(middles, values[1:], strict=True):
        if abs(seen - target) < abs(seen + n - target):
            found.append(middle)
            target += stride
        seen += n
    return found


def learn_bins(rows: DataFrame, features: str, most: int, n: int | None = None) -> tuple[Bins, int]:
    """Bins of the features, and the number of rows, which is ``n`` if that is known."""
    given = rows.schema[features].metadata.get("ml_attr", {})
    known = given.get("attrs", {}).get("nominal", [])
    nominal = {a["idx"]: len(a["vals"]) if "vals" in a else a["num_vals"] for a in known}
    array = vector_to_array(features)
    width = given.get("num_attrs") or rows.select(F.size(array)).first()[0]
    number = {f: F.get(array, F.lit(f)) for f in range(width) if f not in nominal}
    if n is not None and n <= COUNTED_ROWS:
        found = {"n": n}
    else:
        found = rows.agg(F.count("*").alias("n"), *[F.approx_count_distinct(c).alias(str(f)) for f, c in number.items()]).first()
    most = max(2, min(most, found["n"]))
    counted = [f for f in number if found["n"] <= COUNTED_ROWS or found[str(f)] <= COUNTED_VALUES]
    cuts: list = [None] * width
    if counted:
        entries = F.array(*[F.struct(F.lit(f).alias("f"), (number[f] + F.lit(0.0)).alias("x")) for f in counted])
        values: dict[int, list] = {f: [] for f in counted}
        for f, x, n in rows.select(F.inline(entries)).groupBy("f", "x").agg(F.count("*")).collect():
            values[f].append((x, n))
        cuts = [_cuts(values[f], found["n"], most) if f in values else c for f, c in enumerate(cuts)]
    if rest := [f for f in number if f not in counted]:
        shares = [i / most for i in range(1, most)]
        picked = rows.agg(*[F.percentile_approx(number[f], shares, 10_000).alias(str(f)) for f in rest]).first()
        for f in rest:
            cuts[f] = sorted(set(picked[str(f)]))
    return Bins([None if c is None else np.array(c, float) for c in cuts], [nominal[f] if c is None else len(c) + 1 for f, c in enumerate(cuts)], not rest), found["n"]


def binned_table(rows: DataFrame, features: str, label: str, bins: Bins) -> DataFrame:
    """(partition, bin numbers, labels) of every partition that has rows, as bytes."""

    def pack(batches):
        found = [(bins.of(np.stack(b["x"].to_numpy())), b["y"].to_numpy(float)) for b in batches if len(b)]
        if found:
            x, y = np.concatenate([x for x, _ in found], axis=1), np.concatenate([y for _, y in found])
            yield pd.DataFrame({"block": [TaskContext.get().partitionId()], "x": [x.tobytes()], "y": [y.tobytes()]})

    return rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).mapInPandas(pack, "block int, x binary, y binary")


def _unpacked(found, bins: Bins) -> list[tuple]:
    """Rows of ``binned_table`` as arrays, by block."""
    kind, width = np.min_scalar_type(max(bins.sizes)), len(bins.sizes)
    return sorted(((block, np.frombuffer(x, kind).reshape(width, -1), np.frombuffer(y)) for block, x, y in found), key=lambda b: b[0])


def binned_blocks(rows: DataFrame, features: str, label: str, bins: Bins) -> RDD:
    """(partition, bin numbers, labels) of every partition that has rows."""
    return binned_table(rows, features, label, bins).rdd.map(lambda r: _unpacked([r], bins)[0])


# ---------------------------------------------------------------- one tree
@dataclass
class Tree:
    """Nodes as arrays; the right child follows the left one. A cut is a bin of a number or a row of ``sets``, the categories that go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    sets: np.ndarray

    @classmethod
    def root(cls, bins: Bins) -> Tree:
        width = max([1, *(s for s, c in zip(bins.sizes, bins.cuts, strict=True) if c is None)])
        return cls(np.array([-1], np.int16), np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1), np.zeros((0, width), bool))

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, sets: np.ndarray, values: np.ndarray) -> None:
        """Gives nodes their two children with their values; ``cut`` counts categories from the first of ``sets``."""
        self.feature[nodes], self.cut[nodes] = feature, cut
        self.left[nodes] = len(self.feature) + 2 * np.arange(len(nodes))
        more = 2 * len(nodes)
        self.feature = np.concatenate([self.feature, np.full(more, -1, np.int16)])
        self.cut, self.left = (np.concatenate([a, np.zeros(more, np.int32)]) for a in (self.cut, self.left))
        self.value = np.concatenate([self.value, values.ravel()])
        self.sets = np.concatenate([self.sets, sets])

    def leaves(self, x: np.ndarray, nominal: np.ndarray) -> np.ndarray:
        """The node every row ends in."""
        at = np.zeros(x.shape[1], np.int32)
        live = np.arange(x.shape[1])
        while True:
            feature = self.feature[at[live]]
            live, feature = live[feature >= 0], feature[feature >= 0]
            if not live.size:
                return at
            here, found = at[live], x[feature, live]
            left = found <= self.cut[here]
            named = nominal[feature]
            if named.any():
                left[named] = self.sets[self.cut[here[named]], found[named]]
            at[live] = self.left[here] + ~left

    def columns(self) -> tuple:
        arrays = (self.feature, self.cut, self.left, self.value, np.packbits(self.sets, axis=1))
        return tuple(bytearray(a.tobytes()) for a in arrays)

    @classmethod
    def of(cls, row, bins: Bins) -> Tree:
        width = cls.root(bins).sets.shape[1]
        sets = np.unpackbits(np.frombuffer(row.sets, np.uint8).reshape(-1, -(-width // 8)), axis=1, count=width).astype(bool)
        kinds = ((row.feature, np.int16), (row.cut, np.int32), (row.left, np.int32), (row.value, float))
        return cls(*(np.frombuffer(data, kind) for data, kind in kinds), sets)


def statistics(x: np.ndarray, node: np.ndarray, nodes: int, w: np.ndarray, wy: np.ndarray, bins: Bins) -> list:
    """Rows and sums of the target in every bin of every node, (2, nodes, bins) a feature; None where nothing can be split."""
    out = []
    for f, size in enumerate(bins.sizes):
        if size < 2:
            out.append(None)
            continue
        at = node * size + x[f]
        out.append(np.stack([np.bincount(at, v, nodes * size).reshape(nodes, size) for v in (w, wy)]))
    return out


def best_splits(found: list, n: np.ndarray, s: np.ndarray, bins: Bins, least: int):
    """Feature (-1: none), cut, categories that go left, and the values of both children, for every node.

    Nodes are judged in pieces whose arrays stay in a core's cache.
    """
    step = max(1, JUDGED // max(bins.sizes))
    pieces = [slice(a, a + step) for a in range(0, max(len(n), 1), step)]
    judged = [_best_of([None if f is None else f[:, p] for f in found], n[p], s[p], bins, least) for p in pieces]
    return judged[0] if len(judged) == 1 else tuple(map(np.concatenate, zip(*judged, strict=True)))


def _best_of(found: list, n: np.ndarray, s: np.ndarray, bins: Bins, least: int):
    nodes = np.arange(len(n))
    gain = np.zeros(len(n))
    feature, cut = np.full(len(n), -1, np.int16), np.zeros(len(n), np.int32)
    values, named = np.zeros((len(n), 2)), np.zeros((len(n), Tree.root(bins).sets.shape[1]), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = s * s / n
        for f, both in enumerate(found):
            if both is None:
                continue
            order = None
            if bins.cuts[f] is None:
                order = np.argsort(np.where(both[0] > 0, both[1] / both[0], np.inf), axis=1, kind="stable")
                both = both[:, nodes[:, None], order]
            nl, sl = np.cumsum(both[:, :, :-1], axis=2)
            nr, sr = n[:, None] - nl, s[:, None] - sl
            apart, right = sl * sl, sr * sr
            apart /= nl
            right /= nr
            apart += right
            more = np.subtract(apart, whole[:, None], out=right)
            more[(nl < least) | (nr < least)] = -np.inf
            at = more.argmax(1)
            top = more[nodes, at]
            better = np.flatnonzero((top > gain) & (top > NOISE * apart[nodes, at]))
            if not better.size:
                continue
            chosen = at[better]
            gain[better], feature[better], cut[better] = top[better], f, chosen
            values[better, 0], values[better, 1] = sl[better, chosen] / nl[better, chosen], sr[better, chosen] / nr[better, chosen]
            if order is not None:
                named[better] = False
                rank = np.argsort(order[better], axis=1)
                named[better, : rank.shape[1]] = rank <= chosen[:, None]
    return feature, cut, named, values


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: Bins, depth: int, least: int) -> Tree:
    """A whole tree of the given rows, level by level."""
    return grow_all(x, y, [w], bins, depth, least)[0]


def grow_all(x: np.ndarray, y: np.ndarray, draws: list[np.ndarray], bins: Bins, depth: int, least: int) -> list[Tree]:
    """The tree of every draw of the rows. A level of all trees is made at once; each is the one it would be alone."""
    tree, many = Tree.root(bins), len(draws)
    parts = [(x, y, w) if w.all() else (x[:, w > 0], y[w > 0], w[w > 0]) for w in draws]
    parts = [(x, w.astype(float), w.astype(float) * y) for x, y, w in parts]
    mean = np.array([wy.sum() / max(w.sum(), 1.0) for _, w, wy in parts])
    node = np.repeat(np.arange(many), [len(w) for _, w, _ in parts])
    x, w, wy = parts[0] if many == 1 else (np.concatenate([p[i] for p in parts], axis=-1) for i in range(3))
    del parts
    wy = wy - w * mean[node]  # sums near zero lose no digits
    tree.feature, tree.cut, tree.left, tree.value = np.full(many, -1, np.int16), np.zeros(many, np.int32), np.zeros(many, np.int32), mean.copy()
    owner = ids = np.arange(many)
    for _ in range(depth):
        n = np.bincount(node, w, len(ids))
        large = n >= 2 * least
        x, w, wy, node, ids = _kept(large, x, w, wy, node, ids)
        if not len(ids):
            break
        n, s = n[large], np.bincount(node, wy, len(ids))
        feature, cut, named, values = best_splits(statistics(x, node, len(ids), w, wy, bins), n, s, bins, least)
        cut, sets = _numbered(feature, cut, named, bins, len(tree.sets))
        split = feature >= 0
        x, w, wy, node, ids = _kept(split, x, w, wy, node, ids)
        if not len(ids):
            break
        feature, cut = feature[split], cut[split]
        tree.split(ids, feature, cut, sets, values[split] + mean[owner[ids]][:, None])
        owner = np.concatenate([owner, np.repeat(owner[ids], 2)])
        of = feature[node]
        here = x[of, np.arange(len(of))]
        left = here <= cut[node]
        by_name = bins.nominal[of]
        left[by_name] = tree.sets[cut[node[by_name]], here[by_name]]
        node = 2 * node + ~left
        ids = (tree.left[ids][:, None] + np.arange(2)).ravel()
    return [tree] if many == 1 else _parted(tree, owner, many, bins)


def _parted(tree: Tree, owner: np.ndarray, many: int, bins: Bins) -> list[Tree]:
    """The trees of each owner, whose nodes and sets keep their order."""
    order, out = np.argsort(owner, kind="stable"), []
    place = np.zeros(len(owner), np.int32)
    for mine in np.split(order, np.cumsum(np.bincount(owner, minlength=many))[:-1]):
        place[mine] = np.arange(len(mine))
        feature, cut = tree.feature[mine], tree.cut[mine]
        left = np.where(feature >= 0, place[tree.left[mine]], 0).astype(np.int32)
        by_name = (feature >= 0) & bins.nominal[feature]
        sets = tree.sets[cut[by_name]]
        cut[by_name] = np.arange(len(sets))
        out.append(Tree(feature, cut, left, tree.value[mine], sets))
    return out


def _kept(keep: np.ndarray, x, w, wy, node, ids):
    """Rows of the kept nodes, and these numbered anew."""
    if keep.all():
        return x, w, wy, node, ids
    rows = keep[node]
    return x[:, rows], w[rows], wy[rows], (np.cumsum(keep) - 1)[node[rows]], ids[keep]


def _numbered(feature, cut, named, bins: Bins, first: int):
    """Cuts in which a split by categories names its row of the sets, and those rows."""
    by_name = (feature >= 0) & bins.nominal[feature]
    cut = cut.copy()
    cut[by_name] = first + np.arange(by_name.sum())
    return cut, named[by_name]


# ---------------------------------------------------------------- forests
def _weights(seed: int, tree: int, block: int, rows: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, block]).poisson(1.0, rows)


def _numbered_trees(seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(part, its seed, number in the part) of every tree."""
    return [(part, seed, i) for part, (seed, n) in enumerate(seeds) for i in range(n)]


def _grown(found: list[tuple], trees: list[tuple[int, int, int]], draw, bins: Bins, depth: int, least: int):
    """(part, number, tree) of some trees over all rows, as many at a time as make ``TOGETHER`` rows. ``draw``: ``_weights``."""
    x, y = np.concatenate([b[1] for b in found], axis=1), np.concatenate([b[2] for b in found])
    some = max(1, TOGETHER // max(len(y), 1))
    for a in range(0, len(trees), some):
        draws = [np.concatenate([draw(seed, i, b[0], len(b[2])) for b in found]) for _, seed, i in trees[a : a + some]]
        for (part, _, i), tree in zip(trees[a : a + some], grow_all(x, y, draws, bins, depth, least), strict=True):
            yield part, i, tree


def forest_table(blocks: RDD, rows: int, bins: Bins, seeds: list[tuple[int, int]], depth: int, least: int, spark) -> DataFrame:
    """A stored table of trees. ``seeds``: seed and number of trees of each part; rows are drawn with replacement by block."""
    trees = _numbered_trees(seeds)
    if rows <= NODE_ROWS:
        groups = min(GROUPS, len(trees))

        def whole(item):
            g, found = item
            for part, i, tree in _grown(sorted(found, key=lambda b: b[0]), trees[g::groups], _weights, bins, depth, least):
                yield (part, i, -1, *tree.columns())

        made = blocks.flatMap(lambda b: [(g, b) for g in range(groups)]).groupByKey(groups).flatMap(whole)
        return stored(spark.createDataFrame(made, TREES))
    parts = [_large(blocks, bins, trees[i : i + TOPS], depth, least, spark) for i in range(0, len(trees), TOPS)]
    return spark.read.schema(TREES).parquet(*[p for table in parts for p in table.inputFiles()])


def _large(blocks: RDD, bins: Bins, trees: list, depth: int, least: int, spark) -> DataFrame:
    """Trees of many rows: nodes above ``NODE_ROWS`` are split from added histograms, the rest goes to a task for each node."""
    tops = [Tree.root(bins) for _ in trees]
    level = [np.zeros(1, np.int64) for _ in trees]
    open_ = {t: np.zeros(1, np.int64) for t in range(len(trees))}
    nominal = bins.nominal

    def measured(found, tops=None, open_=None):
        sums: dict = {}
        for block, x, y in found:
            for t, ids in open_.items():
                w = _weights(*trees[t][1:], block, len(y)).astype(float)
                place = np.full(len(tops[t].feature), -1)
                place[ids] = np.arange(len(ids))
                node = place[tops[t].leaves(x, nominal)]
                mine = (node >= 0) & (w > 0)
                w, wy, node, here = w[mine], (w * y)[mine], node[mine], x[:, mine]
                now = [*statistics(here, node, len(ids), w, wy, bins), np.stack([np.bincount(node, v, len(ids)) for v in (w, wy)])]
                sums[t] = [None if a is None else a + b for a, b in zip(sums[t], now, strict=True)] if t in sums else now
        return sums.items()

    def judged(found):
        n, s = found[-1]
        return (n, s, *best_splits(found[:-1], n, s, bins, least))

    def added(a, b):
        return [None if p is None else p + q for p, q in zip(a, b, strict=True)]

    for at in range(depth):
        sums = blocks.mapPartitions(partial(measured, tops=list(tops), open_=dict(open_))).reduceByKey(added)
        next_: dict = {}
        for t, (n, s, feature, cut, named, values) in sums.mapValues(judged).collect():
            ids = open_[t]
            if at == 0:
                tops[t].value[0] = s[0] / max(n[0], 1.0)
            split = (feature >= 0) & (n > NODE_ROWS)
            cut, sets = _numbered(np.where(split, feature, -1), cut, named, bins, len(tops[t].sets))
            if split.any():
                tops[t].split(ids[split], feature[split], cut[split], sets, values[split])
                children = (tops[t].left[ids[split]][:, None] + np.arange(2)).ravel()
                level[t] = np.concatenate([level[t], np.full(len(children), at + 1)])
                next_[t] = children
        open_ = next_
        if not open_:
            break

    def dealt(found):
        block, x, y = found
        for t, (_, seed, i) in enumerate(trees):
            w = _weights(seed, i, block, len(y))
            leaf = tops[t].leaves(x, nominal)
            for at in np.unique(leaf[w > 0]):
                mine = (leaf == at) & (w > 0)
                yield (t, int(at)), (block, x[:, mine], y[mine], w[mine])

    def finished(item):
        (t, at), found = item
        found = sorted(found, key=lambda b: b[0])
        x, y, w = np.concatenate([b[1] for b in found], axis=1), *(np.concatenate([b[k] for b in found]) for k in (2, 3))
        part, _, i = trees[t]
        return (part, i, at, *grow(x, y, w, bins, depth - int(level[t][at]), least).columns())

    tasks = max(spark.sparkContext.defaultParallelism, sum(int((top.feature < 0).sum()) for top in tops) // 8)
    below = blocks.flatMap(dealt).groupByKey(tasks).map(finished)
    above = spark.sparkContext.parallelize([(trees[t][0], trees[t][2], -1, *top.columns()) for t, top in enumerate(tops)], 1)
    return stored(spark.createDataFrame(below.union(above), TREES))


def forest_values(rows: DataFrame, features: str, out: str, table: DataFrame, trees: int, bins: Bins) -> DataFrame:
    """Rows with the mean of all trees. Rows of the same bins are asked once; blocks of them meet groups of trees."""
    key = _bin_key(features, bins)
    marked = rows.withColumn("__bins", key)
    asked = stored(marked.select("__bins").distinct())
    blocks = max(1, -(-asked.count() // ASKED))
    groups = min(GROUPS, trees)
    asked = asked.withColumn("b", F.pmod(F.xxhash64("__bins"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = table.withColumn("g", F.pmod(F.hash("part", "tree"), F.lit(groups))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind, width, nominal = np.min_scalar_type(max(bins.sizes)), len(bins.sizes), bins.nominal

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(left))
        if len(left) and len(right):
            x = np.frombuffer(b"".join(left["__bins"]), kind).reshape(-1, width).T.copy()
            for _, mine in right.sort_values(["part", "tree", "leaf"]).groupby(["part", "tree"], sort=True):
                top, *below = mine.itertuples(index=False)
                top = Tree.of(top, bins)
                at = top.leaves(x, nominal)
                value = top.value[at]
                for row in below:
                    if (here := np.flatnonzero(at == row.leaf)).size:
                        tree = Tree.of(row, bins)
                        value[here] = tree.value[tree.leaves(x[:, here], nominal)]
                total += value
        return pd.DataFrame({"__bins": left["__bins"], "g": left["g"], "s": total})

    found = asked.groupBy("g", "b").cogroup(dealt.groupBy("g", "b")).applyInPandas(sums, "__bins binary, g int, s double")
    return _with_mean(marked, found, out, trees)


def forest_held(rows: DataFrame, features: str, out: str, table: DataFrame, n: int, bins: Bins, seeds: list[tuple[int, int]], depth: int, least: int) -> DataFrame:
    """Rows with the mean of all trees of a forest that is asked once: trees are asked where they are grown, and not kept.

    ``table``: the ``n`` training rows as ``binned_table`` has them. Both they and the rows asked have to be few, at most
    ``NODE_ROWS`` and ``ASKED``.
    """
    trees = _numbered_trees(seeds)
    marked = rows.withColumn("__bins", _bin_key(features, bins))
    groups = max(1, min(GROUPS, len(trees), -(-n * len(trees) // GROUP_ROWS)))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    asked = marked.select("__bins").distinct().withColumn("g", every)
    kind, width, nominal = np.min_scalar_type(max(bins.sizes)), len(bins.sizes), bins.nominal

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(left))
        if len(left) and len(right):
            x = np.frombuffer(b"".join(left["__bins"]), kind).reshape(-1, width).T.copy()
            found = _unpacked(zip(right["block"], right["x"], right["y"], strict=True), bins)
            for _, _, tree in _grown(found, trees[left["g"].iat[0] :: groups], _weights, bins, depth, least):
                total += tree.value[tree.leaves(x, nominal)]
        return pd.DataFrame({"__bins": left["__bins"], "g": left["g"], "s": total})

    found = asked.groupBy("g").cogroup(table.withColumn("g", every).groupBy("g")).applyInPandas(sums, "__bins binary, g int, s double")
    return _with_mean(marked, found, out, len(trees))


def _with_mean(marked: DataFrame, found: DataFrame, out: str, trees: int) -> DataFrame:
    """Rows with the mean over trees, from the sums of groups of them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("g", "s"))), lambda p: p["s"])
    mean = F.aggregate(ordered, F.lit(0.0), lambda a, s: a + s) / F.lit(float(trees))
    return marked.join(found.groupBy("__bins").agg(mean.alias(out)), "__bins", "left").drop("__bins")


def _bin_key(features: str, bins: Bins) -> Column:
    """The bin numbers of a row as bytes."""

    @F.pandas_udf("binary")
    def key(rows: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in bins.of(np.stack(rows.to_numpy())).T.copy()], dtype=object) if len(rows) else pd.Series([], dtype=object)

    return key(vector_to_array(features))


# ---------------------------------------------------------------- boosting
def squared_residual(y: np.ndarray, f: np.ndarray) -> np.ndarray:
    return 2.0 * (y - f)


def logistic_residual(y: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Of twice the log loss; labels are -1 and 1."""
    return 4.0 * y / (1.0 + np.exp(2.0 * y * f))


def boost(blocks: RDD, bins: Bins, rounds: int, step: float, depth: int, least: int, residual) -> list[Tree]:
    """Trees whose values are added up. The first fits the labels, each later one a step along the residual.

    One block of rows goes through all rounds in its task. Several keep the values reached so far beside their rows, and add up
    histograms level by level.
    """
    if blocks.getNumPartitions() == 1:

        def alone(found):
            for _, x, y in found:
                f, trees, w = np.zeros(len(y)), [], np.ones(len(y))
                for i in range(rounds):
                    tree = grow(x, residual(y, f) if i else y, w, bins, depth, least)
                    tree.value *= step if i else 1.0
                    f += tree.value[tree.leaves(x, bins.nominal)]
                    trees.append(tree)
                yield trees

        return blocks.mapPartitions(alone).collect()[0]
    kept = StorageLevel.MEMORY_AND_DISK
    state, trees = blocks.map(lambda b: (b[1], b[2], np.zeros(len(b[2])))).persist(kept), []
    for i in range(rounds):
        if i:
            before, last = state, trees[-1]
            state = before.map(lambda b, last=last: (b[0], b[1], b[2] + last.value[last.leaves(b[0], bins.nominal)])).persist(kept)
            if i % KEEP_ROUNDS == 0:
                state.checkpoint()
        trees.append(_shared_tree(state, bins, residual if i else None, depth, least))
        if i:
            trees[-1].value *= step
            before.unpersist()
    state.unpersist()
    return trees


def _shared_tree(state: RDD, bins: Bins, residual, depth: int, least: int) -> Tree:
    """One tree of blocks (bins, labels, values so far); a histogram of each block and level reaches the driver."""
    tree, ids = Tree.root(bins), np.zeros(1, np.int64)

    def measured(block, tree=None, ids=None):
        x, y, f = block
        r = y if residual is None else residual(y, f)
        place = np.full(len(tree.feature), -1)
        place[ids] = np.arange(len(ids))
        node = place[tree.leaves(x, bins.nominal)]
        if (node < 0).any():
            x, r, node = x[:, node >= 0], r[node >= 0], node[node >= 0]
        w = np.ones(len(r))
        return [*statistics(x, node, len(ids), w, r, bins), np.stack([np.bincount(node, v, len(ids)) for v in (w, r)])]

    for level in range(depth):
        found = state.map(partial(measured, tree=tree, ids=ids)).collect()
        summed = [None if a[0] is None else np.sum(a, axis=0) for a in zip(*found, strict=True)]
        n, s = summed.pop()
        if level == 0:
            tree.value[0] = s[0] / max(n[0], 1.0)
        feature, cut, named, values = best_splits(summed, n, s, bins, least)
        cut, sets = _numbered(feature, cut, named, bins, len(tree.sets))
        split = feature >= 0
        if not split.any():
            break
        tree.split(ids[split], feature[split], cut[split], sets, values[split])
        ids = (tree.left[ids[split]][:, None] + np.arange(2)).ravel()
    return tree


def boosted_value(features: str, trees: list[Tree], bins: Bins) -> Column:
    """The sum of the trees' values for each row."""

    @F.pandas_udf("double")
    def value(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=float)
        x = bins.of(np.stack(rows.to_numpy()))
        return pd.Series(sum(t.value[t.leaves(x, bins.nominal)] for t in trees))

    return value(vector_to_array(features))
