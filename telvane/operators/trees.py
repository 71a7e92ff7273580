"""Balanced random forests of unlimited depth, many at a time, grown by passes over the rows and finished in tasks.

Rows carry a key, a class and the models they belong to (folds, held-out classes, variants), so any number of forests
is trained by the same passes. What chance decides comes from digests: how often a row is in a tree's bag (Poisson
with mean 1) from the row's key and the tree, which features a node tries from the node's path. A forest is therefore
the same for any partitioning.

* A node with more than ``limit`` rows is split by histograms: rows and classes are counted per tried feature and bin,
  and the best cut between bins is taken. A node with at most ``limit`` rows is split by exact cuts, to any depth.
* The rows of a node of at most ``ROOM`` bytes go to one task, which grows the whole subtree (``Grow`` in Kernels.java).
  Above, each pass over the rows counts for all such nodes of all trees and models, and Spark sums the counts. If all rows
  fit ``SMALL`` bytes, they are broadcast instead and each task grows whole trees.

Split quality is the Gini decrease; class weights are rebalanced within each tree's bag, rows / (2 * rows of the
class). A node whose tried features are all constant tries the others. Ties go to the first feature and lowest cut. A
null feature counts as larger than all values; rows with a null class or key are left out.

The result is a table with one row per tree: flat arrays of its nodes. ``ArrayForest`` holds such rows end to end and
walks all rows of a batch through many trees at once.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telvane.operators.kernels import kernel
from telvane.schema import SEED
from telvane.session import settle

#: Bytes of a row table that may be broadcast, of the rows of one subtree in a task, and of one broadcast part of a forest.
SMALL, ROOM, PART = 64 << 20, 96 << 20, 128 << 20
#: Bytes of a forest that is not broadcast: its trees stay on the executors and meet the rows in blocks. Bytes of trees that walk at once.
LARGE, BUNDLE = 256 << 20, 16 << 20
LEAF = -1
#: Trees from which rows are dealt out evenly before they meet them; rows that walk a tree together.
MANY, TOGETHER = 32, 1 << 16
TREE = "model int, tree int, feature array<smallint>, cut array<double>, child array<int>, gain array<double>"


@dataclass(frozen=True)
class Growth:
    """Settings of a forest. ``tried``: features per node, by default the root of their number."""

    trees: int = 200
    depth: int | None = None
    bins: int = 64
    limit: int = 200_000
    tried: int | None = None
    bootstrap: bool = True
    wave: int = 32
    seed: int = SEED

    def features_tried(self, n: int) -> int:
        return min(n, self.tried or max(1, math.isqrt(n)))


# --- decisions by digest ----------------------------------------------------------------------------------------------

def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers without visible structure."""
    x = x.astype(np.uint64)
    for _ in range(2):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    return x


#: P(a Poisson count with mean 1 is at most k), until it is 1 in double precision.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
#: The count by a draw's first 12 bits; -1 where they do not decide it.
_ENDS = np.searchsorted(POISSON, np.stack([np.arange(4096) / 4096, np.nextafter(np.arange(1, 4097) / 4096, 0)]), "right")
BY_FIRST_BITS = np.where(_ENDS[0] == _ENDS[1], _ENDS[0], -1)


def bag_counts(keys: np.ndarray, model: int, tree: int, growth: Growth) -> np.ndarray:
    """How often each row is in the bag of a tree."""
    if not growth.bootstrap:
        return np.ones(len(keys), np.int64)
    own = scramble(np.array([(growth.seed << 40) ^ (model << 20) ^ tree], np.uint64))
    draws = scramble(keys ^ own)
    out = BY_FIRST_BITS[(draws >> np.uint64(52)).astype(np.int64)]
    open_ = np.flatnonzero(out < 0)
    out[open_] = np.searchsorted(POISSON, (draws[open_] >> np.uint64(11)).astype(np.float64) * 2.0**-53, "right")
    return out


def root_path(model: int, tree: int, growth: Growth) -> int:
    return int(scramble(np.array([(growth.seed << 40) ^ (tree << 12) ^ (model + 1)], np.uint64))[0])


def child_paths(paths: np.ndarray) -> np.ndarray:
    """Paths of the left and right children, alternating."""
    return np.stack([scramble(paths + np.uint64(1)), scramble(paths + np.uint64(2))], 1).ravel()


def tried_features(paths: np.ndarray, features: int, tried: int) -> np.ndarray:
    """Which features each node tries: a mask of (nodes, features)."""
    draws = scramble(paths[:, None] ^ scramble(np.arange(1, features + 1, dtype=np.uint64))[None])
    mask = np.zeros((len(paths), features), bool)
    np.put_along_axis(mask, np.argsort(draws, 1)[:, :tried], True, 1)
    return mask


# --- growing in memory ------------------------------------------------------------------------------------------------

class Ranked:
    """Rows in memory: classes, values and the rank of each value within its feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.y = y.astype(np.int64)
        x = np.where(np.isnan(x), np.inf, x)
        self.values, self.rank = [], []
        for f in range(x.shape[1]):
            values, rank = np.unique(x[:, f], return_inverse=True)
            self.values.append(values)
            self.rank.append(rank.astype(np.int32))


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A cut c with a <= c < b."""
    with np.errstate(over="ignore", invalid="ignore"):
        c = a + (b - a) / 2
    return np.where(np.isfinite(c) & (c < b), c, a)


def quality(w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """Weight times one less the Gini impurity."""
    return (w0 * w0 + w1 * w1) / np.maximum(w0 + w1, 1e-300)


#: Bits of a packed entry below its node and rank: how often it is in the bag (at most 31), and its class.
LOW = 6
#: What an entry adds by these bits: its count, and above 32 bits its count if it is of class 1.
ADDS = np.array([(b >> 1) * (1 + ((b & 1) << 32)) for b in range(1 << LOW)], np.int64)
WHOLE = (1 << 32) - 1


def best_cuts(keys: np.ndarray, bits: int, total: np.ndarray, before: np.ndarray, weights: np.ndarray):
    """(node, quality, last rank on the left, first rank on the right) of the best cut on a feature, per node that has one.

    Node, rank, count and class of an entry are packed into one integer, so sorting moves nothing else. ``before``: what
    the entries of earlier nodes add. A cut between two single entries of one class is passed over: along such a run the
    quality is strictly convex and at its ends not less than without a cut, so the best one is elsewhere.
    """
    keys.sort()
    value = keys >> LOW
    new = value[1:] != value[:-1]
    single = np.ones(len(keys), bool)
    single[1:] &= new
    single[:-1] &= new
    one = (keys & 1).astype(bool)
    at = np.flatnonzero(new & ~(single[1:] & single[:-1] & (one[1:] == one[:-1])))
    left, right = value[at], value[at + 1]
    node = left >> bits
    inside = node == right >> bits
    if not inside.any():
        return None
    at, left, right, node, mask = at[inside], left[inside], right[inside], node[inside], (1 << bits) - 1
    added = np.cumsum(ADDS[keys & ((1 << LOW) - 1)])[at] - before[node]
    n1 = added >> 32
    n0 = (added & WHOLE) - n1
    w0, w1 = weights[0] if len(weights) == 1 else (w.take(node) for w in weights.T)
    whole0, whole1 = (t.take(node) for t in total.T)
    score = quality(n0 * w0, n1 * w1) + quality((whole0 - n0) * w0, (whole1 - n1) * w1)
    begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    top = np.flatnonzero(np.repeat(np.maximum.reduceat(score, begin), np.diff(np.append(begin, len(node)))) == score)
    owner = node[top]
    pick = top[np.concatenate([[True], owner[1:] != owner[:-1]])]
    return node[pick], score[pick], left[pick] & mask, right[pick] & mask


def grow(data: Ranked, rows: np.ndarray, counts: np.ndarray, starts: np.ndarray, paths: np.ndarray, depths: np.ndarray, weights: np.ndarray, growth: Growth) -> list[tuple]:
    """Subtrees from their starting nodes to the leaves, level by level for all of them.

    ``rows``, ``counts``: entries; ``starts``: the bounds of each subtree's entries; ``weights``: class weights of each
    subtree. Returns (feature, cut, child, gain) arrays per subtree; a leaf's cut is its probability of class 1.
    """
    features, size = len(data.rank), len(data.y)
    bits = max(1, max(int(len(v)).bit_length() for v in data.values))
    ranks = np.concatenate(data.rank).astype(np.int32 if bits + LOW < 31 else np.int64) << LOW
    packed = (counts.astype(np.int64) << 1) | data.y[rows]
    tried = growth.features_tried(features)
    slots = np.repeat(np.arange(len(paths)), np.diff(starts))
    owner, depth, paths = np.arange(len(paths)), depths.copy(), paths.astype(np.uint64)
    made: list[list[np.ndarray]] = [[], [], [], []]  # owner, feature, cut, child by level
    gains = np.zeros((len(starts) - 1, features))
    known = 0
    while len(owner):
        n = len(owner)
        added = np.bincount(slots, packed >> 1, n), np.bincount(slots, (packed >> 1) * (packed & 1), n)
        total = np.stack([added[0] - added[1], added[1]], 1).astype(np.int64)
        weight = weights if len(weights) == 1 else weights[owner]
        mass = total * weight
        feature, cut, child = np.full(n, LEAF, np.int16), mass[:, 1] / np.maximum(mass.sum(1), 1e-300), np.zeros(n, np.int32)
        open_ = (total > 0).all(1)
        if growth.depth is not None:
            open_ &= depth < growth.depth
        best, low, high = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not open_.all():  # entries of leaves are done
            stay = np.flatnonzero(open_[slots])
            rows, packed, slots = rows[stay], packed[stay], slots[stay]
        order = np.argsort(~tried_features(paths, features, tried), 1, kind="stable").astype(np.int16)  # tried ones first
        for more, places in ((False, range(tried)), (True, range(tried, features))):
            look = open_ & (feature == LEAF) if more else open_
            if not look.any() or not len(places):
                break
            e = np.flatnonzero(look[slots]) if more else slice(None)
            r, at = rows[e], slots[e]
            base = (at << (bits + LOW)) | packed[e]
            sums = (total.sum(1) + (total[:, 1] << 32)) * look
            before = np.cumsum(sums) - sums
            for j in places:
                found = best_cuts(ranks[order[at, j] * np.int64(size) + r] | base, bits, total, before, weight)
                if found is None:
                    continue
                nodes, score, a, b = found
                better = score > best[nodes]
                nodes = nodes[better]
                best[nodes], feature[nodes], low[nodes], high[nodes] = score[better], order[nodes, j], a[better], b[better]
        inner = feature != LEAF
        split = np.flatnonzero(inner)
        for f in np.unique(feature[split]):
            of = split[feature[split] == f]
            cut[of] = between(data.values[f][low[of]], data.values[f][high[of]])
        np.add.at(gains, (owner[split], feature[split]), best[split] - quality(mass[split, 0], mass[split, 1]))
        child[split] = known + n + 2 * np.arange(len(split))
        for to, column in zip(made, (owner, feature, cut, child)):
            to.append(column)
        known += n
        # Entries of split nodes move to the children.
        if not inner[open_].all():
            stay = np.flatnonzero(inner[slots])
            rows, packed, slots = rows[stay], packed[stay], slots[stay]
        right = ranks[feature[slots] * np.int64(size) + rows] > (low << LOW)[slots]
        place = 2 * (np.cumsum(inner) - 1)
        slots = place[slots] + right
        owner, depth, paths = np.repeat(owner[split], 2), np.repeat(depth[split] + 1, 2), child_paths(paths[split])
    owner, feature, cut, child = (np.concatenate(c) for c in made)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(starts)))
    renumber = np.empty(known, np.int32)
    renumber[order] = np.arange(known) - np.repeat(bounds[:-1], np.diff(bounds))
    child = np.where(feature == LEAF, 0, renumber[np.minimum(child, known - 1)])
    return [(feature[o], cut[o], child[o].astype(np.int32), gains[i]) for i, o in enumerate(np.split(order, bounds[1:-1]))]


def class_weights(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Balanced weights of both classes within a bag."""
    n = np.stack([n0, n1], -1).astype(float)
    return np.where(n > 0, n.sum(-1, keepdims=True) / np.maximum(2 * n, 1), 0.0)


LISTS = [pa.list_(pa.int16()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())]


def tree_batch(trees: list[tuple]) -> pa.RecordBatch:
    """Rows of ``TREE`` from (model, tree, feature, cut, child, gain)."""
    names = [c.split()[0] for c in TREE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([t[i] for t in trees], k) for i, k in enumerate([pa.int32(), pa.int32(), *LISTS])], names=names)


# --- subtrees as bytes ------------------------------------------------------------------------------------------------

HEAD = "<iiiiQddi"
#: What ``Grow`` reads: settings of the subtree, a row of doubles per entry, its count and class.
TASK = "head binary, x binary, low binary"


def room(spark, width: int, growth: Growth) -> int:
    """Rows of a node that one task takes; beyond ``limit`` only ``Grow`` does, cutting large nodes between bins."""
    return max(growth.limit, min(ROOM // (8 * width + 1), (1 << 23) - 1)) if kernel(spark, "Grow") else growth.limit


def task_head(entries: int, edges: list[np.ndarray], path: int, depth: int, weight: np.ndarray, growth: Growth) -> bytes:
    levels, width = -1 if growth.depth is None else growth.depth - depth, len(edges)
    ends = [struct.pack("<i", len(e)) + np.asarray(e, "<f8").tobytes() for e in edges]
    return struct.pack(HEAD, entries, width, growth.features_tried(width), levels, path, float(weight[0]), float(weight[1]), growth.limit) + b"".join(ends)


def low_bits(counts: np.ndarray, y: np.ndarray) -> bytes:
    """How often each entry is in the bag, above its class bit."""
    return ((counts << 1) | y).astype(np.int8).tobytes()


def packed_nodes(feature: np.ndarray, cut: np.ndarray, child: np.ndarray, gain: np.ndarray) -> bytes:
    return b"".join([
        np.int64(len(feature)).tobytes(), np.asarray(gain, "<f8").tobytes(), np.asarray(cut, "<f8").tobytes(),
        np.asarray(child, "<i4").tobytes(), np.asarray(feature, "<i2").tobytes(),
    ])


def unpacked_nodes(packed: bytes, width: int) -> tuple:
    """(feature, cut, child, gain) of packed nodes."""
    n = int(np.frombuffer(packed, "<i8", 1)[0])
    cuts, children, features = 8 + 8 * width, 8 + 8 * width + 8 * n, 8 + 8 * width + 12 * n
    return np.frombuffer(packed, "<i2", n, features), np.frombuffer(packed, "<f8", n, cuts), np.frombuffer(packed, "<i4", n, children), np.frombuffer(packed, "<f8", width, 8)


def grown_here(head: bytes, x: bytes, low: bytes) -> bytes:
    """The nodes of a subtree by ``grow``, as ``Grow`` of Kernels.java returns them."""
    n, width, tried, levels, path, w0, w1, _ = struct.unpack_from(HEAD, head)
    bits = np.frombuffer(low, np.int8).astype(np.int64)
    data = Ranked(np.frombuffer(x, "<f8").reshape(-1, width), bits & 1)
    growth = Growth(depth=None if levels < 0 else levels, tried=tried)
    (nodes,) = grow(data, np.arange(n), bits >> 1, np.array([0, n]), np.array([path], np.uint64), np.zeros(1, np.int64), np.array([[w0, w1]]), growth)
    return packed_nodes(*nodes)


def subtrees(tasks: DataFrame) -> DataFrame:
    """The tasks (``TASK`` beside other columns) with ``nodes``, each grown by one call."""
    grown = kernel(tasks.sparkSession, "Grow") or F.pandas_udf(lambda head, x, low: pd.Series(list(map(grown_here, head, x, low))), "binary")
    return tasks.withColumn("nodes", grown("head", "x", "low")).drop("head", "x", "low")


# --- training ---------------------------------------------------------------------------------------------------------

def training_rows(rows: DataFrame, features: list[str], label: str = "label", row_id: str = "row_id", models: Column | None = None) -> DataFrame:
    """(key, y, x, models): what training reads. ``models``: the models a row belongs to, by default only 0."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    models = models if models is not None else F.array(F.lit(0))
    return rows.where(F.col(label).isNotNull() & F.col(row_id).isNotNull()).select(
        F.xxhash64(F.col(row_id)).alias("key"), (F.col(label) > 0).cast("int").alias("y"), x.alias("x"), models.cast("array<int>").alias("models")
    )


def matrix(batch, width: int) -> np.ndarray:
    """Values of a list column, a row each; nulls are NaN."""
    flat = batch.column("x")
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return np.array(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def memberships(batch, models: list[int]) -> np.ndarray:
    """(rows, models): whether a row belongs to a model."""
    held = batch.column("models")
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    at = np.repeat(np.arange(len(held)), np.asarray(held.value_lengths().fill_null(0)))
    out = np.zeros((len(held), len(models)), bool)
    order = np.argsort(models)
    flat = held.flatten().to_numpy(zero_copy_only=False)
    own = order[np.searchsorted(np.array(models)[order], flat).clip(max=len(models) - 1)] if len(flat) else np.zeros(0, int)
    known = np.flatnonzero(np.array(models)[own] == flat)
    out[at[known], own[known]] = True
    return out


def fit(rows: DataFrame, width: int, growth: Growth = Growth(), models: list[int] | None = None) -> DataFrame:
    """The table of trees (``TREE``) of all models, written out. ``rows``: from ``training_rows``."""
    models = models or [0]
    rows = settle(rows, "training")
    size = rows.count()
    if size <= room(rows.sparkSession, width, growth) and size * (8 * width + 8 * len(models) + 32) <= SMALL:
        edges = _bin_edges(rows, width, growth.bins) if size > growth.limit else [np.zeros(0)] * width
        return settle(_whole_trees(rows, edges, growth, models), "trees")
    return _by_levels(rows, width, growth, models)


def _jobs(spark, growth: Growth, models: list[int]) -> DataFrame:
    """One row per tree, spread over the cores."""
    table = spark.range(growth.trees * len(models)).select(
        F.element_at(F.array(*[F.lit(m) for m in models]), (F.col("id") / growth.trees).cast("int") + 1).alias("model"), (F.col("id") % growth.trees).cast("int").alias("tree")
    )
    return table.repartition(max(1, min(growth.trees * len(models), 2 * spark.sparkContext.defaultParallelism)))


def _whole_trees(rows: DataFrame, edges: list[np.ndarray], growth: Growth, models: list[int]) -> DataFrame:
    spark, width = rows.sparkSession, len(edges)
    held = rows.toArrow()  # at most ``room`` rows and ``SMALL`` bytes
    shared = spark.sparkContext.broadcast((held["key"].to_numpy().view(np.uint64), held["y"].to_numpy(), matrix(held, width), memberships(held, models)))
    place = {m: i for i, m in enumerate(models)}

    def run(batches):
        keys, y, x, member = shared.value
        for batch in batches:
            for model, tree in zip(batch.column("model").to_pylist(), batch.column("tree").to_pylist()):
                own = np.flatnonzero(member[:, place[model]])
                c = bag_counts(keys[own], model, tree, growth)
                own, c = own[c > 0], c[c > 0]
                n = np.bincount(y[own], c, 2)
                head = task_head(len(own), edges, root_path(model, tree, growth), 0, class_weights(n[0], n[1]), growth)
                yield pa.RecordBatch.from_pylist([{"model": model, "tree": tree, "head": head, "x": x[own].tobytes(), "low": low_bits(c, y[own])}], tasks)

    def unpack(batches):
        for batch in batches:
            for model, tree, nodes in zip(*(batch.column(c).to_pylist() for c in ("model", "tree", "nodes"))):
                yield tree_batch([(model, tree, *unpacked_nodes(nodes, width))])

    tasks = pa.schema([("model", pa.int32()), ("tree", pa.int32()), *((c, pa.binary()) for c in ("head", "x", "low"))])
    return subtrees(_jobs(spark, growth, models).mapInArrow(run, f"model int, tree int, {TASK}")).mapInArrow(unpack, TREE)


# --- growing by passes ------------------------------------------------------------------------------------------------

def hung(table: pa.Table) -> tuple:
    """(feature, cut, child, gain) of a whole tree from its upper part (node -1) and the subtrees below, in order of their nodes."""
    nodes = table.column("node").to_numpy()
    order = np.argsort(nodes)
    parts = [[table.column(c)[i].values.to_numpy() for c in ("feature", "cut", "child", "gain")] for i in order.tolist()]
    # A subtree's root takes the node's place, the rest goes to the end.
    feature, cut, child = (np.concatenate([parts[0][j], *(p[j][1:] for p in parts[1:])]) for j in range(3))
    gain, end = parts[0][3], len(parts[0][0])
    for node, (f, v, k, more) in zip(nodes[order[1:]].tolist(), parts[1:]):
        k = np.where(f != LEAF, k + (end - 1), 0)
        feature[node], cut[node], child[node] = f[0], v[0], k[0]
        child[end : end + len(k) - 1] = k[1:]
        gain, end = gain + more, end + len(k) - 1
    return feature, cut, child, gain


class Top:
    """The upper part of one tree while it grows; the driver holds one per tree."""

    def __init__(self, model: int, tree: int, growth: Growth):
        self.model, self.tree = model, tree
        self.feature, self.cut, self.child = [LEAF], [0.0], [0]
        self.path, self.depth, self.state = [root_path(model, tree, growth)], [0], ["large"]
        self.gain: dict[int, float] = {}
        self.weight = np.ones(2)

    def arrays(self) -> tuple:
        return np.array(self.feature, np.int16), np.array(self.cut), np.array(self.child, np.int32)

    def split(self, node: int, feature: int, cut: float, gain: float) -> int:
        self.feature[node], self.cut[node], self.child[node], self.state[node] = feature, cut, len(self.feature), "inner"
        self.gain[feature] = self.gain.get(feature, 0.0) + gain
        for path in child_paths(np.array([self.path[node]], np.uint64)).tolist():
            self.feature.append(LEAF), self.cut.append(0.0), self.child.append(0)
            self.path.append(path), self.depth.append(self.depth[node] + 1), self.state.append("large")
        return self.child[node]


def walk(feature: np.ndarray, cut: np.ndarray, child: np.ndarray, x: np.ndarray, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The leaf that each (row, starting node) reaches."""
    out = node.copy()
    at = np.flatnonzero(feature[out] != LEAF)
    while len(at):
        here = out[at]
        out[at] = child[here] + ~(x[rows[at], feature[here]] <= cut[here])
        at = at[feature[out[at]] != LEAF]
    return out


def _gathered(batches, rows: int = 1 << 16):
    """The same rows in batches of about ``rows``, so that what is done per batch and tree weighs little."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _in_bag(batches, shared, width: int, models: list[int], growth: Growth):
    """(tree index, x, y, rows in its bag, counts, node reached) for each batch of rows and tree of the wave."""
    tops = shared.value
    place = {m: i for i, m in enumerate(models)}
    for batch in _gathered(batches):
        x, y = matrix(batch, width), batch.column("y").to_numpy()
        x[np.isnan(x)] = np.inf
        keys, member = batch.column("key").to_numpy().view(np.uint64), memberships(batch, models)
        of = [np.flatnonzero(m) for m in member.T]
        keys = [keys[own] for own in of]
        for i, (model, tree, feature, cut, child) in enumerate(tops):
            own = of[place[model]]
            c = bag_counts(keys[place[model]], model, tree, growth)
            if growth.bootstrap:
                bagged = np.flatnonzero(c)
                own, c = own[bagged], c[bagged]
            yield i, x, y, own, c, walk(feature, cut, child, x, own, np.zeros(len(own), np.int64))


#: Cells of histograms that a task holds before it hands them on.
HELD = 1 << 21


def _histograms(rows: DataFrame, tops: list[Top], wide: set, edges: list[np.ndarray], growth: Growth, models: list[int]) -> DataFrame:
    """(tree, node, feature, bin, n, n0, n1, lo, hi) of all large nodes: rows, bagged rows per class, least and largest value."""
    width, tried = len(edges), growth.features_tried(len(edges))
    bins = max(len(e) for e in edges) + 1
    shared = rows.sparkSession.sparkContext.broadcast([(t.model, t.tree, *t.arrays()) for t in tops])
    looks = []  # per tree: the place of each node among the looked at ones, these nodes, and the features each tries (LEAF: no more)
    for i, t in enumerate(tops):
        nodes = np.array([k for k, s in enumerate(t.state) if s == "large"], np.int64)
        place = np.full(len(t.state), -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        mask = tried_features(np.array([t.path[k] for k in nodes], np.uint64), width, tried) if len(nodes) else np.zeros((0, width), bool)
        mask[[j for j, k in enumerate(nodes.tolist()) if (i, k) in wide]] = True
        order = np.argsort(~mask, 1, kind="stable")[:, : int(mask.sum(1).max(initial=0))]
        looks.append((place, nodes, np.where(np.take_along_axis(mask, order, 1), order, LEAF)))
    looks = rows.sparkSession.sparkContext.broadcast(looks)
    names = ["tree", "node", "feature", "bin", "n", "n0", "n1", "lo", "hi"]

    def handed_on(i, held):
        _, nodes, features = looks.value[i]
        n, ones, bagged, lo, hi = held
        at = np.flatnonzero(n)
        slot, j, b = at // (features.shape[1] * bins), at // bins % features.shape[1], at % bins
        columns = (np.full(len(at), i), nodes[slot], features[slot, j], b, n[at], bagged[at] - ones[at], ones[at], lo[at], hi[at])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches):
        sums, size, seen = {}, 0, None
        for i, x, y, own, c, node in _in_bag(batches, shared, width, models, growth):
            place, nodes, features = looks.value[i]
            if x is not seen:
                seen, bin_of = x, np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1).ravel()
            slot = place[node]
            use = np.flatnonzero(slot >= 0)
            if not len(use):
                continue
            slot, own, c = slot[use], own[use], c[use]
            cells = features.size * bins
            if i not in sums:
                sums[i] = [*(np.zeros(cells, np.int64) for _ in range(3)), np.full(cells, np.inf), np.full(cells, -np.inf)]
                size += cells
            n, ones, bagged, lo, hi = sums[i]
            of_one = c * y[own]
            for j in range(features.shape[1]):
                f = features[slot, j]
                at, v, count, one = own * width + f, x.ravel(), c, of_one
                code = (slot * features.shape[1] + j) * bins
                if (f == LEAF).any():
                    some = np.flatnonzero(f != LEAF)
                    at, code, count, one = at[some], code[some], c[some], of_one[some]
                code += bin_of[at]
                v = v[at]
                n += np.bincount(code, minlength=cells)
                bagged += np.bincount(code, count, cells).astype(np.int64)
                ones += np.bincount(code, one, cells).astype(np.int64)
                np.minimum.at(lo, code, v)
                np.maximum.at(hi, code, v)
            if size > HELD:
                for k, held in sums.items():
                    yield handed_on(k, held)
                sums, size = {}, 0
        for k, held in sums.items():
            yield handed_on(k, held)

    counted = rows.mapInArrow(run, "tree long, node long, feature long, bin long, n long, n0 long, n1 long, lo double, hi double")
    return counted.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _best_by_histogram(counted: DataFrame, weights: DataFrame) -> list:
    """One row per large node: rows and classes, and the best cut with the rows and classes on its left."""
    from pyspark.sql import Window

    by = Window.partitionBy("tree", "node", "feature").orderBy("bin")
    upto, after = by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("tree", "node", "feature")
    part = counted.select("*", *[F.sum(c).over(upto).alias(f"l{c}") for c in ("n", "n0", "n1")], *[F.sum(c).over(after).alias(f"t{c}") for c in ("n", "n0", "n1")], F.lead("lo").over(by).alias("next"))
    part = part.join(F.broadcast(weights), "tree")  # one row per tree

    def q(a: Column, b: Column) -> Column:
        return F.when(a + b > 0, (a * a + b * b) / (a + b)).otherwise(0.0)

    w0, w1 = F.col("w0"), F.col("w1")
    score = q(F.col("ln0") * w0, F.col("ln1") * w1) + q((F.col("tn0") - F.col("ln0")) * w0, (F.col("tn1") - F.col("ln1")) * w1)
    cut = F.when(F.col("next").isNotNull(), F.struct(score.alias("score"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "hi", "next", "ln", "ln0", "ln1"))
    spread = F.when(F.col("low") < F.col("high"), F.struct((-F.col("feature")).alias("f"), "low", "high"))
    part = part.select("*", F.min("lo").over(after).alias("low"), F.max("hi").over(after).alias("high"))
    return part.groupBy("tree", "node").agg(
        F.max("tn").alias("n"), F.max("tn0").alias("n0"), F.max("tn1").alias("n1"), F.max(cut).alias("cut"), F.max(spread).alias("spread")
    ).collect()  # one row per large node: rows / limit of a tree


def _bin_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Upper ends of each feature's bins, by approximate quantiles of the finite values."""
    shares = [i / bins for i in range(1, bins)]
    value = [F.when(~F.isnan(F.get("x", f)), F.get("x", f)) for f in range(width)]
    found = rows.agg(*[F.percentile_approx(v, shares, 100_000).alias(f"q{f}") for f, v in enumerate(value)]).first()
    return [np.unique(np.array(q or [], float)) for q in found]


def evened(rows: DataFrame, trees: int) -> DataFrame:
    """The rows in tasks of even size if they meet many trees: then a row costs much more than its shuffle."""
    if trees < MANY or rows.isStreaming:
        return rows
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


def _by_levels(rows: DataFrame, width: int, growth: Growth, models: list[int]) -> DataFrame:
    edges = _bin_edges(rows, width, growth.bins)
    done = []
    jobs = [(m, t) for m in models for t in range(growth.trees)]
    if len(jobs) >= MANY:
        rows = settle(evened(rows, len(jobs)), "training")
    tops = [Top(m, t, growth) for m, t in jobs]
    _upper_parts(rows, tops, edges, growth, models)
    for start in range(0, len(jobs), growth.wave):
        done.append(settle(_finished(rows, tops[start : start + growth.wave], edges, growth, models), "trees"))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def _upper_parts(rows: DataFrame, tops: list[Top], edges: list[np.ndarray], growth: Growth, models: list[int]) -> None:
    """Split all nodes of more rows than a task takes; one pass per level for all trees."""
    spark, width = rows.sparkSession, len(edges)
    shared, most = spark.sparkContext.broadcast([(t.model, t.tree, *t.arrays()) for t in tops]), room(spark, width, growth)

    def sizes(batches):
        held = np.zeros((len(tops), 3), np.int64)
        for i, _, y, own, c, _ in _in_bag(batches, shared, width, models, growth):
            one = int(c @ y[own])
            held[i] += len(own), int(c.sum()) - one, one
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), *(pa.array(v.copy()) for v in held.T)], names=["tree", "n", "n0", "n1"])

    counted = rows.mapInArrow(sizes, "tree long, n long, n0 long, n1 long").groupBy("tree").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")]).collect()
    held = {r["tree"]: r for r in counted}
    for i, t in enumerate(tops):
        r = held.get(i)
        t.weight = class_weights(np.array(r["n0"] if r else 0), np.array(r["n1"] if r else 0))
        _settle_node(t, 0, r["n"] if r else 0, r["n0"] if r else 0, r["n1"] if r else 0, growth, most)
    weights = spark.createDataFrame([(i, float(t.weight[0]), float(t.weight[1])) for i, t in enumerate(tops)], "tree long, w0 double, w1 double")
    wide: set = set()
    while any("large" in t.state for t in tops):
        again = set()
        for r in _best_by_histogram(_histograms(rows, tops, wide, edges, growth, models), weights):
            i, node, t = r["tree"], r["node"], tops[r["tree"]]
            whole = float(quality(np.array(r["n0"] * t.weight[0]), np.array(r["n1"] * t.weight[1])))
            if r["cut"] is not None:
                c = r["cut"]
                left = t.split(node, -c["f"], float(between(np.array(c["hi"]), np.array(c["next"]))), c["score"] - whole)
                _settle_node(t, left, c["ln"], c["ln0"], c["ln1"], growth, most)
                _settle_node(t, left + 1, r["n"] - c["ln"], r["n0"] - c["ln0"], r["n1"] - c["ln1"], growth, most)
            elif (i, node) not in wide and growth.features_tried(width) < width:
                again.add((i, node))
            elif r["spread"] is not None:  # all values share a bin: halve their range; the children are counted next
                s = r["spread"]
                t.split(node, -s["f"], float(between(np.array(s["low"]), np.array(s["high"]))), 0.0)
            else:  # rows without any difference
                _leaf(t, node, r["n0"], r["n1"])
        wide = again


def _leaf(t: Top, node: int, n0: int, n1: int) -> None:
    mass = n0 * t.weight[0] + n1 * t.weight[1]
    t.cut[node], t.state[node] = (n1 * t.weight[1] / mass if mass else 0.0), "leaf"


def _settle_node(t: Top, node: int, n: int, n0: int, n1: int, growth: Growth, most: int) -> None:
    """A node is a leaf, is small enough for a task, or stays large."""
    if not n0 or not n1 or (growth.depth is not None and t.depth[node] >= growth.depth):
        _leaf(t, node, n0, n1)
    elif n <= most:
        t.state[node] = "small"


def _finished(rows: DataFrame, tops: list[Top], edges: list[np.ndarray], growth: Growth, models: list[int]) -> DataFrame:
    """Whole trees: rows of small nodes meet in one task each, and the subtrees are hung below the upper parts."""
    spark, width = rows.sparkSession, len(edges)
    shared = spark.sparkContext.broadcast([(t.model, t.tree, *t.arrays()) for t in tops])
    small = spark.sparkContext.broadcast([(np.array([s == "small" for s in t.state]), t.path, t.depth, t.weight) for t in tops])
    upper = [(t.model, t.tree, -1, packed_nodes(*t.arrays(), np.array([t.gain.get(f, 0.0) for f in range(width)]))) for t in tops]

    def route(batches):
        for i, x, y, own, c, node in _in_bag(batches, shared, width, models, growth):
            own_small = np.flatnonzero(small.value[i][0][node])
            if not len(own_small):
                continue
            order = own_small[np.argsort(node[own_small].astype(np.int32), kind="stable")]
            own, c, node = own[order], c[order], node[order]
            begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            parts = list(zip(begin.tolist(), [*begin[1:].tolist(), len(node)]))
            held, low = x[own], (c << 1 | y[own]).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(parts), i)), pa.array(node[begin]), *(pa.array([v[a:b].tobytes() for a, b in parts], pa.binary()) for v in (held, low))], names=["i", "node", "x", "low"]
            )

    def gather(key, table):
        i, node = (k.as_py() for k in key)
        _, path, depth, weight = small.value[i]
        x, low = (b"".join(table.column(c).to_pylist()) for c in ("x", "low"))
        head = task_head(len(low), edges, path[node], depth[node], weight, growth)
        return pa.Table.from_pylist([dict(zip(schema.names, (*shared.value[i][:2], node, head, x, low)))], schema)

    def hang(key, table):
        parts = [unpacked_nodes(nodes, width) for nodes in table.column("nodes").to_pylist()]
        lists = {c: pa.array([p[j] for p in parts], k) for j, (c, k) in enumerate(zip(("feature", "cut", "child", "gain"), LISTS))}
        return pa.Table.from_batches([tree_batch([(*(k.as_py() for k in key), *hung(pa.table({"node": table.column("node"), **lists})))])])

    if not any("small" in t.state for t in tops):
        return spark.createDataFrame([(m, k, *(v.tolist() for v in unpacked_nodes(nodes, width))) for m, k, _, nodes in upper], TREE)
    schema = pa.schema([("model", pa.int32()), ("tree", pa.int32()), ("node", pa.int64()), *((c, pa.binary()) for c in ("head", "x", "low"))])
    below = subtrees(rows.mapInArrow(route, "i long, node long, x binary, low binary").groupBy("i", "node").applyInArrow(gather, f"model int, tree int, node long, {TASK}"))
    return spark.createDataFrame(upper, "model int, tree int, node long, nodes binary").unionAll(below).groupBy("model", "tree").applyInArrow(hang, TREE)


# --- scoring ----------------------------------------------------------------------------------------------------------

class ArrayForest:
    """Trees end to end: a node's feature (``LEAF``: none), its cut or probability, its left child; the right one follows."""

    def __init__(self, table: DataFrame, features: list[str]):
        self.table, self.features = table, features

    def sizes(self) -> list[tuple[int, int]]:
        """(tree, nodes) in order."""
        if not hasattr(self, "_sizes"):
            self._sizes = sorted((r["tree"], r["n"]) for r in self.table.select("tree", F.size("feature").alias("n")).collect())  # one row per tree
        return self._sizes

    def parts(self) -> list[tuple]:
        """Broadcast parts of at most about ``PART`` bytes: (roots, feature, cut, child). The driver holds one at a time."""
        if not hasattr(self, "_parts"):
            spark = self.table.sparkSession
            self._parts, held, nodes = [], [], 0
            for i, (tree, n) in enumerate(self.sizes()):
                held.append(tree)
                nodes += n
                if 14 * nodes > PART or i + 1 == self.size():
                    rows = self.table.where(F.col("tree").between(held[0], held[-1])).select("tree", "feature", "cut", "child").orderBy("tree").toArrow()
                    trees = [tuple(rows.column(c)[k].values.to_numpy() for c in ("feature", "cut", "child")) for k in range(rows.num_rows)]
                    self._parts.append(spark.sparkContext.broadcast(end_to_end(trees)))
                    held, nodes = [], 0
        return self._parts

    def large(self) -> bool:
        """Whether the trees are too many bytes to be broadcast."""
        return 14 * sum(n for _, n in self.sizes()) > LARGE and kernel(self.table.sparkSession, "Walk") is not None

    def bundles(self) -> DataFrame:
        """The trees as ``Walk`` reads them, some in a row."""
        if not hasattr(self, "_bundles"):
            width = len(self.features)

            def pack(batches):
                held, size = [], 0
                for batch in batches:
                    for f, v, c in zip(*(batch.column(k) for k in ("feature", "cut", "child"))):
                        held.append(walked(*(k.values.to_numpy() for k in (f, v, c))))
                        size += len(held[-1])
                        if size > BUNDLE:
                            yield bundle(held)
                            held, size = [], 0
                if held:
                    yield bundle(held)

            def bundle(trees):
                return pa.RecordBatch.from_pydict({"trees": pa.array([struct.pack("<ii", width, len(trees)) + b"".join(trees)], pa.binary())})

            spread = self.table.select("feature", "cut", "child").repartition(max(1, min(self.size(), 3 * self.table.sparkSession.sparkContext.defaultParallelism)))
            self._bundles = settle(spread.mapInArrow(pack, "trees binary"), "bundles")
        return self._bundles

    def sums(self, rows: DataFrame) -> DataFrame:
        """(at, sum): the trees' sum for each row of (at, x), in units of 2**-44. The rows are broadcast in blocks of ``SMALL`` bytes, a job's tasks share the trees."""
        width, walk = len(self.features), kernel(rows.sparkSession, "Walk")

        def pack(batches):
            task = TaskContext.get().partitionId()
            for i, batch in enumerate(_gathered(batches)):
                x = matrix(batch, width)
                x[np.isnan(x)] = np.inf
                columns = [[(task << 32) + i], [batch.num_rows], [batch.column("at").to_numpy().tobytes()], [x.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "n", "at", "x"])

        def add(batches):
            held = {}
            for batch in batches:
                for block, found in zip(batch.column("block").to_pylist(), batch.column("sums")):
                    found = np.frombuffer(found.as_buffer(), np.int64)
                    held[block] = held[block] + found if block in held else found.copy()
            for block, sums in held.items():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "sums": pa.array([sums.tobytes()], pa.binary())})

        def total(key, table):
            at, sums = (table.column(c).to_pylist() for c in ("at", "sums"))
            at = np.frombuffer(next(a for a in at if a is not None), np.int64)
            return pa.table({"at": at, "sum": sum(np.frombuffer(s, np.int64) for s in sums if s is not None) + np.zeros(len(at), np.int64)})

        packed = settle(rows.mapInArrow(pack, "block long, n long, at binary, x binary"), "blocks")
        table = packed.select("block", "at", F.lit(None).cast("binary").alias("sums"))
        rounds, held = [[]], 0
        for r in packed.select("block", "n").orderBy("block").collect():  # one row per 65,536 rows
            if rounds[-1] and held + 8 * width * r["n"] > SMALL:
                rounds.append([])
                held = 0
            rounds[-1].append(r["block"])
            held += 8 * width * r["n"]
        for blocks in rounds if rounds[0] else []:
            part = packed.where(F.col("block").between(blocks[0], blocks[-1])).select("block", "x")
            pairs = self.bundles().crossJoin(F.broadcast(part)).select("block", walk("trees", "x").alias("sums"))
            found = settle(pairs.mapInArrow(add, "block long, sums binary"), "sums")
            table = table.unionByName(found.select("block", F.lit(None).cast("binary").alias("at"), "sums"))
        return table.groupBy("block").applyInArrow(total, "at long, sum long")

    def importances(self) -> list[tuple[str, float]]:
        """Mean share of each feature in a tree's decrease of impurity."""
        total = F.aggregate("gain", F.lit(0.0), lambda a, v: a + v)
        shares = self.table.where(total > 0).select(F.posexplode(F.transform("gain", lambda v: v / total)).alias("f", "share"))
        by = {r["f"]: r["share"] for r in shares.groupBy("f").agg(F.sum("share").alias("share")).collect()}
        whole = sum(by.values()) or 1.0
        return [(name, by.get(i, 0.0) / whole) for i, name in enumerate(self.features)]

    def probability(self, where: Column | None = None) -> Column:
        """Mean over the trees of the probability of class 1; 0 for rows where ``where`` does not hold."""
        columns = [F.col(f).cast("double") for f in self.features]
        where = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        sums = [_leaf_udf(p)(where, *columns) for p in self.parts()]
        return sum(sums, F.lit(0.0)) / F.lit(float(max(1, self.size())))

    def size(self) -> int:
        """Number of trees."""
        return len(self.sizes())


def probabilities(rows: DataFrame, forests: dict[str, tuple[ArrayForest, Column | None]], trees: int) -> DataFrame:
    """``rows`` with the probability of each forest in its column, 0 where its condition does not hold. ``trees`` meet each row."""
    large = {} if rows.isStreaming else {name: f for name, f in forests.items() if f[0].large()}
    rows = evened(rows, trees)
    if large:
        rows = settle(rows.withColumn("__at", F.monotonically_increasing_id()), "scored")
    for name, (forest, where) in large.items():
        x = F.array(*[F.col(f).cast("double") for f in forest.features])
        sums = forest.sums((rows if where is None else rows.where(where)).select(F.col("__at").alias("at"), x.alias("x")))
        p = F.coalesce(F.col("sum") / F.lit(2.0**44 * forest.size()), F.lit(0.0))
        rows = rows.join(sums.withColumnRenamed("at", "__at"), "__at", "left").withColumn(name, p).drop("sum")
    return rows.drop("__at").withColumns({name: f.probability(where) for name, (f, where) in forests.items() if name not in large})


def walked(feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> bytes:
    """A tree as ``Walk`` reads it."""
    leaf, n = feature == LEAF, len(feature)
    nodes = np.zeros(n, [("cut", "<f8"), ("child", "<i4"), ("feature", "<i4")])
    nodes["cut"], nodes["child"], nodes["feature"] = np.where(leaf, np.inf, cut), np.where(leaf, np.arange(n), child), np.where(leaf, 0, feature)
    return np.int64(n).tobytes() + nodes.tobytes() + np.where(leaf, cut, 0.0).tobytes()


def end_to_end(trees: list[tuple]) -> tuple:
    sizes = np.cumsum([0, *[len(t[0]) for t in trees]])
    child = np.concatenate([t[2] + s for t, s in zip(trees, sizes)]).astype(np.int32)
    return sizes[:-1].astype(np.int32), np.concatenate([t[0] for t in trees]).astype(np.int16), np.concatenate([t[1] for t in trees]), child


def leaf_sums(x: np.ndarray, roots: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, steps: int = 8) -> np.ndarray:
    """Sum over the trees of the leaf value each row reaches. No value is NaN.

    All rows walk a tree at once. Leaves lead to themselves, so rows are only looked through for those that have
    arrived after every few steps.
    """
    n, width = x.shape
    out, flat, begin = np.zeros(n), np.ascontiguousarray(x).ravel(), np.arange(n) * width
    for a, b in zip(roots.tolist(), [*roots[1:].tolist(), len(feature)]):
        leaf = feature[a:b] == LEAF
        at, limit = np.where(leaf, 0, feature[a:b]).astype(np.intp), np.where(leaf, np.inf, cut[a:b])
        after = np.where(leaf, np.arange(b - a), child[a:b] - a)
        rows, first, node = np.arange(n), begin, np.zeros(n, np.intp)
        while len(rows):
            for _ in range(steps):
                node = after.take(node) + (flat.take(first + at.take(node)) > limit.take(node))
            done = leaf.take(node)
            out[rows[done]] += cut[a + node[done]]
            keep = ~done
            rows, first, node = rows[keep], first[keep], node[keep]
    return out


def joined(batches: Iterator[tuple[pd.Series, ...]], rows: int = TOGETHER) -> Iterator[tuple[pd.Series, ...]]:
    """The same columns in batches of about ``rows``, as each batch prepares every tree."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch[0])
        if n >= rows:
            yield tuple(pd.concat(c, ignore_index=True) for c in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(pd.concat(c, ignore_index=True) for c in zip(*held))


def _leaf_udf(part):
    @F.pandas_udf("double")
    def leaves(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        arrays = part.value
        for where, *columns in joined(batches):
            use = where.to_numpy(bool)
            x = np.stack([c.to_numpy(float) for c in columns], 1)[use]
            out = np.zeros(len(use))
            out[use] = leaf_sums(np.where(np.isnan(x), np.inf, x), *arrays)
            yield pd.Series(out)

    return leaves
