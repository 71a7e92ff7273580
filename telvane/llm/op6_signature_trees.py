"""N-gram Jaccard join by signature trees.

Two documents link when the Jaccard similarity of their word-shingle sets reaches a threshold p/q. The result is one
row per document with the smallest doc_id reachable by links. Nothing is lost and no pair is formed twice on purpose:

1. Routing hashes bring linked documents into one forest group. Equal sets fold into one class first. There are two
   exact ways; the similarity decides, by how many shingles a part of the first one holds on average,
   (p + q) / (2 (q - p)):
   * from ``PART_SHINGLES`` on (similarity 0.9: 9.5): each set is cut by hash into one part more than the number of
     shingles in which two linked sets of its size class can differ, so two linked sets agree in all of some part. A
     set takes the parts of every size class in which it may have a smaller partner. Sets that merely share a phrase
     or a passage do not meet.
   * below (similarity 0.8: 4.5, where parts are often empty): shingles are put in one global order, rare ones first
     (by a fixed table of hashed counts, then by hash). A set of n shingles can only link to another if the two share
     one of their first n - ceil(n p/q) + 1 shingles in this order. Passages that many documents share come last and
     route nobody. Any order is exact; the counts only keep groups small.
   Sets that share a routing hash with at most ``BUCKET`` - 1 others meet only if their sizes and parities (for each of
   some bits, whether an odd number of shingles fall on it) leave room for a link: parities that differ in d bits prove
   d differing shingles. So groups do not grow together through rare phrases that unrelated texts happen to share.
2. Each group becomes a signature tree: its leaves are sets, ordered by their smallest hash, and each node holds the
   OR of token bitmaps, the size range and the largest count of bitmap collisions below it. The tree is traversed
   against itself. A pair of nodes is left out if its sizes cannot link, if the largest possible overlap (common bits
   plus collisions) is below what its smallest sizes need, or if one component already holds both. Leaf pairs are
   compared exactly.
3. A group above ``limit`` shingles is cut into chunks in the order of sizes. Each chunk is traversed with the group's
   first set as a common anchor; then only pairs of chunks whose sizes may link and that still span several components
   are traversed.

Empty texts and null texts have no set, link with nothing and are their own component. Rows without a doc_id count as
documents; a component of such rows alone gets a null component_id. Rows that share a doc_id are separate documents.
Columns other than doc_id and text are ignored. Sets are compared by 64-bit shingle hashes, classes by a 64-bit sum.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telvane.llm.common import Scratch, Words, checked_broadcast, list_array, mix, null_safe, shingle_sets, text_parts
from telvane.llm.graph import components


#: Size of the bitmap of shared routing hashes (16 MB), and the ranges in which it is gathered.
MAP_BITS, MAP_RANGES = 1 << 27, 256
#: The table of shingle counts has 2**COUNT_BITS slots (4 MB); the slot is a shingle's upper bits.
COUNT_BITS = 22
#: Most sets that share a routing hash and are compared pair by pair by their parities; parities have at most 2**PARITY_BITS bits.
BUCKET, PARITY_BITS = 16, 16
#: Average shingles of a part from which sets are routed by parts.
PART_SHINGLES = 8


def class_id(s: np.ndarray) -> int:
    return int(mix(np.array([int(np.add.reduce(mix(s))) + len(s) * 0x51ED2701 & (2**64 - 1)], np.uint64)).view(np.int64)[0])


def signatures(s: np.ndarray, common: np.ndarray, p: int, q: int) -> np.ndarray:
    """The first shingles of the set in the global order, enough to meet every set that it links to."""
    first = len(s) - -(-len(s) * p // q) + 1
    rank = common[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    return s[np.argsort(rank, kind="stable")[:first]] if len(s) else s  # s is sorted, so ties go by hash


@lru_cache(maxsize=64)
def size_classes(bits: int, p: int, q: int) -> np.ndarray:
    """Lower ends of the size classes, beyond 2**bits; the largest partner of a class is in it or the next."""
    low = [1]
    while low[-1] <= 1 << bits:
        low.append(low[-1] * q // p + 1)
    return np.array(low, np.int64)


def part_signatures(s: np.ndarray, p: int, q: int) -> np.ndarray:
    """A hash of each part of the set, for each size class in which its smaller partners may be.

    Linked sets of sizes a <= b differ in at most (a + b)(q - p)/(p + q) shingles, which is taken at the upper end of
    a's class; one part more than that leaves some part without a difference.
    """
    n = len(s)
    if not n:
        return s
    low = size_classes(n.bit_length(), p, q)
    first, last = np.searchsorted(low, [-(-n * p // q), n], "right") - 1
    mixed, out = mix(s), []
    for c in range(int(first), int(last) + 1):
        high = int(low[c + 1]) - 1
        parts = (high + high * q // p) * (q - p) // (p + q) + 1
        sums = np.full(parts, c * 0x51ED2701ABCD, np.uint64) + mix(np.arange(parts, dtype=np.uint64))
        np.add.at(sums, (s % np.uint64(parts)).astype(np.int64), mixed)
        out.append(mix(sums))
    return np.concatenate(out)


def parity(s: np.ndarray) -> bytes:
    """For each of as many bits as suit the set's size whether an odd number of its shingles fall on it."""
    bits = 1 << min(PARITY_BITS, max(6, (max(len(s) // 2, min(len(s), 1024)) - 1).bit_length()))
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def fewest_differences(a: bytes, b: bytes) -> int:
    """A lower bound on the shingles that only one of two sets holds, from their parities; the longer one is folded."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How common the shingles of each hash range are, as steps of a fourth power of two; of fixed size."""
    span = (1 << COUNT_BITS) // MAP_RANGES

    def count(batches):
        total, waiting, held = np.zeros(1 << COUNT_BITS, np.int32), [], 0

        def add():
            slots, n = np.unique(np.concatenate(waiting), return_counts=True)
            total[slots] += n.astype(np.int32)

        for batch in batches:
            for _, _, data, offsets in text_parts(batch.column("text")):
                hashes, inside = Words(data, offsets).shingles(k)
                waiting.append((hashes[inside] >> np.uint64(64 - COUNT_BITS)).astype(np.uint32))
                held += len(waiting[-1])
                if held > 4_000_000:
                    add()
                    waiting, held = [], 0
        if waiting:
            add()
        for r in range(MAP_RANGES):
            part = np.minimum(total[r * span : (r + 1) * span], 65535).astype(np.uint16)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["part", "counts"])

    def merge(key, table):
        total = np.zeros(span, np.int64)
        for blob in table.column("counts"):  # one row of fixed size for each counting task
            total += np.frombuffer(blob.as_py(), np.uint16)
        steps = np.minimum(255, np.floor(4 * np.log2(1 + total))).astype(np.uint8)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([steps.tobytes()], pa.binary())], names=["part", "steps"])

    out = np.zeros(1 << COUNT_BITS, np.uint8)
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "part long, counts binary")
    for r in parts.groupBy("part").applyInArrow(merge, "part long, steps binary").collect():  # MAP_RANGES rows, 4 MB together
        out[r["part"] * span : (r["part"] + 1) * span] = np.frombuffer(r["steps"], np.uint8)
    return out


class Tree:
    """Binary tree over sets in a given order; level 0 holds the sets, each further level pairs of nodes."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        bits = 512
        while bits < 4 * size.max() and bits < 65536:
            bits *= 2
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            flags = np.zeros(bits, np.uint8)
            flags[(s >> np.uint64(20)) % np.uint64(bits)] = 1
            maps[i] = np.packbits(flags).view(np.uint64)
        collisions = size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, size, size, collisions)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), 2)
            maps, low, high, over = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(over, at)))


def tree_links(sets: list[np.ndarray], label: np.ndarray, p: int, q: int) -> list[tuple[int, int]]:
    """Links that join what ``label`` keeps apart: a spanning set of the links between the given sets."""
    n = len(sets)
    if n < 2:
        return []
    order = sorted(range(n), key=lambda i: (int(sets[i][0]), len(sets[i])))
    sets, mark = [sets[i] for i in order], np.unique(label[order], return_inverse=True)[1]
    tree, links = Tree(sets), []
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        maps, low, high, over = tree.levels[level]
        a, b = mark[i << level : (i + 1) << level], mark[j << level : (j + 1) << level]
        if a[0] == b[0] and (a == a[0]).all() and (b == a[0]).all():
            continue
        if i != j:
            if q * high[i] < p * low[j] or q * high[j] < p * low[i]:
                continue
            most = int(np.bitwise_count(maps[i] & maps[j]).sum()) + min(over[i], over[j])
            if most * (p + q) < p * (low[i] + low[j]):
                continue
        if level == 0:
            if i != j:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if q * common >= p * (len(sets[i]) + len(sets[j]) - common):
                    links.append((order[i], order[j]))
                    mark[mark == mark[j]] = mark[i]
            continue
        below, width = level - 1, len(tree.levels[level - 1][0])
        if i == j:
            pairs = [(2 * i, 2 * i + 1), (2 * i + 1, 2 * i + 1), (2 * i, 2 * i)]  # the last is traversed first
        else:
            pairs = [(x, y) for x in (2 * i + 1, 2 * i) for y in (2 * j + 1, 2 * j)]
        stack.extend((below, x, y) for x, y in pairs if x < width and y < width)
    return links


def by_parts(p: int, q: int) -> bool:
    """Whether sets are routed by parts: these hold enough shingles on average."""
    return p + q >= PART_SHINGLES * 2 * (q - p)


def profile(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """doc_id, n_shingles, cid (class of equal sets, null without a set), the routing hashes and the parity of each document."""
    parts = by_parts(p, q)
    shared = None if parts else docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, k))

    def routes(s: np.ndarray) -> np.ndarray:
        return part_signatures(s, p, q) if parts else signatures(s, shared.value, p, q)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, data, offsets in text_parts(batch.column("text")):
                sets = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_id(s) if len(s) else None for s in sets], pa.int64()),
                    list_array([routes(s) for s in sets], pa.int64()),
                    pa.array([parity(s) if len(s) else None for s in sets], pa.binary()),
                ], names=["doc_id", "n_shingles", "cid", "sigs", "parity"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_shingles long, cid long, sigs array<long>, parity binary")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash modulo MAP_BITS, gathered in ranges: of fixed size, however many hashes there are."""
    span = MAP_BITS // MAP_RANGES
    place = F.pmod("sig", F.lit(MAP_BITS))

    def run(key, table):
        flags = np.zeros(span, np.uint8)
        flags[table.column("place").to_numpy() % span] = 1
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["part", "bits"])

    places = hashes.select(place.alias("place")).distinct().withColumn("part", F.floor(F.col("place") / span).cast("long"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in places.groupBy("part").applyInArrow(run, "part long, bits binary").collect():  # MAP_RANGES rows, 16 MB together
        out[r["part"] * span // 8 : (r["part"] + 1) * span // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked_routes(profiled: DataFrame, bits: np.ndarray, p: int, q: int) -> DataFrame:
    """(sig, cid, own) of the routing hashes whose bit is set, with the size class of the set."""
    shared = profiled.sparkSession.sparkContext.broadcast(bits)
    low = size_classes(62, p, q)

    def run(batches):
        for batch in batches:
            sigs = batch.column("sigs")
            flat = sigs.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(sigs.offsets.to_numpy()))
            at = flat.view(np.uint64) & np.uint64(MAP_BITS - 1)
            hit = np.flatnonzero((shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1)
            own = np.searchsorted(low, batch.column("n_shingles").to_numpy()[owner[hit]], "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), batch.column("cid").take(pa.array(owner[hit])), pa.array(own)], names=["sig", "cid", "own"])

    return profiled.where("cid is not null").select("sigs", "cid", "n_shingles").mapInArrow(run, "sig long, cid long, own long")


def windows(parts: DataFrame) -> DataFrame:
    """(sig, cid, node): a route and a node for each of the two windows of sizes that a set belongs to.

    Window c holds the size classes c and c + 1, so linked sets share a window; chains of shared shingles cannot run
    from short texts to long ones.
    """
    both = parts.select("sig", "cid", F.explode(F.array("own", F.col("own") - 1)).alias("window"))
    return both.select(F.xxhash64("sig", "window").alias("sig"), "cid", F.xxhash64("cid", "window").alias("node"))


def may_link(pairs: DataFrame, classes: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b: nodes; x, y: their classes) that their sizes and parities do not rule out.

    Linked sets of sizes m and n differ in at most (m + n)(q - p)/(p + q) shingles.
    """
    def run(batches):
        for batch in batches:
            most = (batch.column("m").to_numpy() + batch.column("n").to_numpy()) * (q - p)
            sides = zip(batch.column("s").to_pylist(), batch.column("t").to_pylist())
            keep = [(p + q) * fewest_differences(s, t) <= most[i] for i, (s, t) in enumerate(sides)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sizes = classes.select(F.col("cid").alias("x"), F.col("n").alias("m"))
    pairs = pairs.join(sizes, "x").join(sizes.withColumnsRenamed({"x": "y", "m": "n"}), "y").where(f"{q} * m >= {p} * n and {q} * n >= {p} * m")
    maps = classes.select(F.col("cid").alias("x"), F.col("parity").alias("s"))
    both = pairs.join(maps, "x").join(maps.withColumnsRenamed({"x": "y", "s": "t"}), "y")
    return both.select("a", "b", "m", "n", "s", "t").mapInArrow(run, "a long, b long")


def candidate_edges(parts: DataFrame, classes: DataFrame, scratch: Scratch, p: int, q: int) -> DataFrame:
    """(a, b): edges between nodes, such that nodes that share a routing hash and may link are connected.

    Up to BUCKET nodes of a hash are compared pair by pair, so that sets which merely share a rare phrase do not meet.
    More nodes hang on the smallest one.
    """
    hubs = parts.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("held"))
    routed = parts.join(hubs.where("hub != last").drop("last"), "sig")
    stars = routed.where(F.col("held") > BUCKET).where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    sets = routed.where(F.col("held") <= BUCKET).groupBy("sig").agg(F.sort_array(F.collect_set(F.struct("node", "cid"))).alias("nodes"))
    one = sets.select("nodes").distinct().select(F.posexplode("nodes").alias("at", "one"), "nodes")  # near copies share many hashes
    two = one.select("one", F.explode(F.slice("nodes", F.col("at") + 2, F.lit(BUCKET))).alias("two"))
    pairs = two.select(F.col("one.node").alias("a"), F.col("two.node").alias("b"), F.col("one.cid").alias("x"), F.col("two.cid").alias("y")).distinct()
    pairs = scratch.settle(pairs, "pairs")
    return stars.unionAll(may_link(pairs, classes, p, q))


def forest_links(rows: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """Links found by the trees of each unit; rows: unit, grp, cid, mark, text."""

    def run(table):
        sets, frame = [], table.select(["grp", "cid", "mark"]).to_pandas()
        for _, _, data, offsets in text_parts(table.column("text")):
            sets.extend(shingle_sets(data, offsets, k))
        keep = np.array([len(s) > 0 and class_id(s) == c for s, c in zip(sets, frame["cid"])], bool)  # rows may share a doc_id
        frame["at"] = np.arange(len(frame))
        frame = frame[keep].drop_duplicates(["grp", "cid"])
        found = []
        for _, g in frame.groupby("grp", sort=True):
            g = g.sort_values("cid")
            own, cids = [sets[i] for i in g["at"]], g["cid"].tolist()
            found.extend((cids[x], cids[y]) for x, y in tree_links(own, g["mark"].to_numpy(), p, q))
        out = pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        return pa.Table.from_pandas(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]), preserve_index=False)

    return rows.groupBy("unit").applyInArrow(run, "a long, b long")


def with_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of the classes' representatives."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return null_safe(texts, checked_broadcast(wanted), ["doc_id"])


def with_chunks(members: DataFrame, limit: int) -> DataFrame:
    """The chunk of each member: groups above ``limit`` shingles are cut in the order of sizes, equal sizes by hash."""
    by_size = members.where("chunks > 1").groupBy("grp", "n").agg(F.sum("n").alias("mass"))
    earlier = Window.partitionBy("grp").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # one row per size
    by_size = by_size.select("grp", "n", "mass", F.coalesce(F.sum("mass").over(earlier), F.lit(0)).alias("before"))
    share = F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) / F.lit(1 << 20)
    chunk = F.coalesce(F.floor((F.col("before") + share * F.col("mass")) / F.lit(limit)), F.lit(0)).cast("int")
    return members.join(by_size, ["grp", "n"], "left").withColumn("chunk", chunk).drop("mass", "before")


def jaccard_components(docs: DataFrame, k: int = 3, p: int = 9, q: int = 10, limit: int = 250_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; links at similarity p/q of k-word shingles.

    ``limit``: shingles of one tree task; larger groups are cut into chunks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    profiled = scratch.settle(profile(docs, k, p, q), "profile")
    # routing hashes of several rows; a fixed bitmap of them spares most of the others the second shuffle
    shared = profiled.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig")
    shared = scratch.settle(shared, "shared")
    parts = marked_routes(profiled, bitmap(shared), p, q).join(shared, "sig", "left_semi").distinct()  # copies have one class
    # Parts of sets already differ by size class.
    parts = scratch.settle(parts.select("sig", "cid", F.col("cid").alias("node")) if by_parts(p, q) else windows(parts), "parts")
    count = profiled.count()
    rows = scratch.settle(profiled.select("doc_id", "n_shingles", "cid"), "rows", most=count)
    by_class = profiled.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("parity").alias("parity"))
    classes = scratch.settle(by_class, "classes")
    scratch.drop(profiled, shared)

    groups = components(candidate_edges(parts, classes, scratch, p, q), scratch, parts.count()).withColumnRenamed("label", "grp")  # the smallest node of the group

    classes = classes.drop("parity")
    named = parts.select("node", "cid").distinct().join(groups, "node")
    members = scratch.settle(classes.join(named, "cid"), "members", most=(1 if by_parts(p, q) else 2) * count)
    scratch.drop(parts)
    totals = members.groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(limit)).cast("int").alias("chunks"))
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    units = max(1, -(-total // limit))
    sized = members.count()
    members = scratch.settle(with_chunks(members.join(totals, "grp"), limit), "members", most=sized)
    small = members.where("chunks <= 1").select("doc_id", "cid", "grp", F.pmod(F.xxhash64("grp"), F.lit(units)).alias("unit"), F.col("cid").alias("mark"))
    large = members.where("chunks > 1")
    anchored = large.where("node != grp").select("doc_id", "cid", "grp", "chunk").unionAll(
        large.where("node = grp").select("doc_id", "cid", "grp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    )
    first = small.unionAll(anchored.select("doc_id", "cid", "grp", F.xxhash64("grp", "chunk").alias("unit"), F.col("cid").alias("mark")))
    links = scratch.settle(forest_links(with_texts(scratch.settle(first, "first"), docs), k, p, q), "links")
    labels = components(links, scratch)

    if not large.isEmpty():
        marked = large.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("mark", F.coalesce("label", "cid")).drop("label")
        marked = scratch.settle(marked, "marked", most=sized)
        spans = marked.groupBy("grp", "chunk").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
        x, y = spans.alias("x"), spans.alias("y")
        open_pairs = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.chunk") < F.col("y.chunk"))).where(
            f"least(x.low, y.low) != greatest(x.high, y.high) and {q} * x.most >= {p} * y.least and {q} * y.most >= {p} * x.least"
        ).select(F.col("x.grp").alias("grp"), F.array("x.chunk", "y.chunk").alias("pair"))
        sides = open_pairs.withColumn("chunk", F.explode("pair")).withColumn("unit", F.xxhash64("grp", "pair"))
        second = marked.join(sides, ["grp", "chunk"]).select("doc_id", "cid", "grp", "unit", "mark")
        more = forest_links(with_texts(scratch.settle(second, "second"), docs), k, p, q)
        labels = components(links.unionAll(more), scratch)

    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "doc_id", F.coalesce("label", "cid").alias("label"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = named.join(smallest, "label").select("cid", "component_id")
    return rows.select("doc_id", "n_shingles", "cid").join(by_class, "cid", "left").select(
        "doc_id", "n_shingles", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those whose component has a smaller doc_id. Rows without a doc_id stay.

    Rows that share a doc_id go together: if one of them has a smaller partner, all do.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    away = scratch.settle(found.where("doc_id != component_id").select(F.col("doc_id").alias("__away")).distinct(), "away", most=docs.count())
    return docs.join(checked_broadcast(away), docs["doc_id"].cast("long") == F.col("__away"), "left_anti")
