"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Words are runs of letters and digits in lower case; shingles are five words. Each shingle weighs 1000 ln(1 + N/df),
N items, df of them with the shingle (1 for shingles of no item).

* A window as long as item (m words) can only be similar to it if the shared shingles have the weight ``least`` times
  the item's, so shingles of all documents are first looked up in the items' shingles. For each m, ``need`` is the
  fewest shared shingles that can have this weight. Every start whose window holds so many is looked at; a document of
  fewer than m words is one window.
* A window's fingerprint is the 64-bit SimHash of its weighted distinct shingles. Items are indexed under their eight
  8-bit blocks and all block values within Hamming distance 2: of two fingerprints within radius 23, some block
  differs in at most two bits, so the look-up returns every item of that length within the radius.
* Candidates are verified by exact weighted Jaccard similarity of distinct shingles.

Items with fewer than five words, or null, have no shingle and match nothing; so do empty and null texts. Rows that
share a doc_id are separate documents. The result has a row for each document; other columns are ignored.
Only DataFrame operations are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telvane.llm.common import Scratch, checked_broadcast, null_safe

K = 5
RADIUS, BLOCKS, WITHIN = 23, 8, 2
KEY = ["doc_id", "text_hash"]


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_list(words: Column) -> Column:
    """Hashes of all runs of K words; empty below K words. The words are bound once, as a lambda's variable."""

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) >= K, F.sequence(F.lit(1), F.size(w) - (K - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(K)]))

    return F.element_at(F.transform(F.array(words), runs), 1)


def window_starts(at: Column, need: Column, long: Column, size: Column) -> Column:
    """All starts of windows of ``long`` shingles, clipped to ``size``, that hold ``need`` of the sorted places ``at``.

    A start belongs to the first place in its window, so each comes once.
    """

    def from_first(p: Column, i: Column) -> Column:
        after = F.when(i > 0, F.get(at, i - 1) + 1).otherwise(0)
        low, high = F.greatest(F.lit(0), after, F.get(at, i + need - 1) - long + 1), F.least(p, F.greatest(F.lit(0), size - long))
        return F.when((i + need <= F.size(at)) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(at, from_first))


def votes() -> list[Column]:
    """For each bit the weighted vote of the hashes in column h with weights w."""
    return [F.sum(F.expr(f"if(getbit(h, {b}) = 1, w, -w)")).alias(f"bit{b}") for b in range(64)]


def fingerprint() -> Column:
    terms = [F.when(F.col(f"bit{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return reduce(lambda x, y: x.bitwiseOR(y), terms)


def block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, contaminated, n_items, best_item, best_similarity for every row of ``docs`` (doc_id, text).

    ``items``: item_id, text. ``best_item`` is the smallest of the most similar ones; null if none reaches ``least``.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    items = items.where("item_id is not null").select("item_id", word_list(F.col("text")).alias("words"))
    items = items.select("item_id", F.size("words").alias("m"), shingle_list(F.col("words")).alias("sh")).where(F.size("sh") > 0).dropDuplicates()
    items = scratch.settle(items.withColumn("item_key", F.xxhash64("item_id", "sh")), "items")
    places = items.select("item_key", "m", F.posexplode("sh").alias("off", "h"))
    n_items = items.count()
    df = places.groupBy("h").agg(F.countDistinct("item_key").alias("df"))
    weights = checked_broadcast(scratch.settle(df.select("h", F.round(1000 * F.log(1 + F.lit(n_items) / F.col("df"))).cast("long").alias("w")), "weights"))
    unknown = F.round(1000 * F.log(F.lit(1.0 + n_items))).cast("long")

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    item_rows = items.select("item_id", "item_key", "m", F.explode(F.array_distinct("sh")).alias("h")).join(weights, "h")
    need = item_rows.groupBy("item_id", "item_key", "m").agg(F.ceil(least * F.sum("w") / F.max("w") - 1e-9).cast("int").alias("need"))
    need = need.groupBy("m").agg(F.greatest(F.lit(1), F.min("need")).alias("need"))
    lengths = checked_broadcast(scratch.settle(places.select("h", "m").distinct().join(need, "m"), "places"))
    shingled = rows.select(*KEY, shingle_list(word_list(F.col("text"))).alias("sh"))
    hits = shingled.select(*KEY, F.posexplode("sh").alias("pos", "h")).join(lengths, "h")
    hits = hits.groupBy(*KEY, "m", "need").agg(F.sort_array(F.collect_set("pos")).alias("at")).where(F.size("at") >= F.col("need"))
    wanted = scratch.settle(hits.groupBy(*KEY).agg(F.collect_list(F.struct("m", "need", "at")).alias("windows")), "windows")
    wanted = checked_broadcast(wanted, weight=32 + F.aggregate("windows", F.lit(0), lambda n, x: n + 24 + 4 * F.size(x["at"])))

    with_windows = null_safe(rows, wanted, KEY).select(*KEY, shingle_list(word_list(F.col("text"))).alias("sh"), "windows")
    cut = with_windows.select(*KEY, F.explode("windows").alias("x"), "sh").select(*KEY, "x.*", "sh")
    cut = cut.select(*KEY, "m", "sh", F.explode(window_starts(F.col("at"), F.col("need"), F.col("m") - (K - 1), F.size("sh"))).alias("start")).select(
        *KEY, "m", "start", F.array_distinct(F.slice(F.col("sh"), F.col("start") + 1, F.col("m") - (K - 1))).alias("own")
    ).dropDuplicates([*KEY, "m", "start"])
    cut = scratch.settle(cut, "cut")
    spread = cut.select(*KEY, "m", "start", F.explode("own").alias("h")).join(weights, "h", "left").withColumn("w", F.coalesce("w", unknown))
    prints = spread.groupBy(*KEY, "m", "start").agg(F.sum("w").alias("own_w"), *votes()).select(*KEY, "m", "start", "own_w", fingerprint().alias("fp"))

    item_prints = item_rows.groupBy("item_id", "item_key", "m").agg(F.sum("w").alias("item_w"), F.collect_list(F.struct("h", "w")).alias("item_sh"), *votes())
    item_prints = item_prints.select("item_id", "item_key", "m", "item_w", "item_sh", fingerprint().alias("item_fp"))
    near = F.array(*[F.lit(x) for x in range(256) if bin(x).count("1") <= WITHIN])
    index = item_prints.select("item_key", "m", "item_fp", F.posexplode(F.array(*[block(F.col("item_fp"), i) for i in range(BLOCKS)])).alias("i", "own"))
    index = index.select("item_key", F.col("m").alias("im"), "item_fp", F.col("i").alias("ii"), F.explode(F.transform(near, lambda x: F.col("own").bitwiseXOR(x))).alias("value"))
    index = checked_broadcast(scratch.settle(index, "index"), weight=F.lit(64))
    blocks = prints.select("*", F.posexplode(F.array(*[block(F.col("fp"), i) for i in range(BLOCKS)])).alias("i", "b"))
    found = blocks.join(index, (F.col("m") == F.col("im")) & (F.col("i") == F.col("ii")) & (F.col("b") == F.col("value")))
    found = found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(*KEY, "m", "start", "own_w", "item_key").distinct()

    found = null_safe(cut, scratch.settle(found, "found"), [*KEY, "m", "start"]).join(item_prints.drop("m", "item_fp"), "item_key")
    common = F.aggregate(
        F.filter("item_sh", lambda x: F.array_contains(F.col("own"), x["h"])), F.lit(0).cast("long"), lambda total, x: total + x["w"]
    )
    scored = found.withColumn("common", common).withColumn("similarity", F.col("common") / (F.col("own_w") + F.col("item_w") - F.col("common")))
    best = scored.where(F.col("similarity") >= least).groupBy(*KEY).agg(
        F.countDistinct("item_key").alias("n_items"), F.min(F.struct((-F.col("similarity")).alias("less"), "item_id")).alias("top")
    ).select(*KEY, "n_items", F.col("top.item_id").alias("best_item"), (-F.col("top.less")).alias("best_similarity"))
    best = checked_broadcast(scratch.settle(best, "best"))
    return null_safe(rows.select(*KEY), best, KEY, "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "best_item", "best_similarity", "text_hash"
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark item."""
    scratch = Scratch(docs.sparkSession, "leaks")
    bad = scratch.settle(find_leaks(docs, items).where("contaminated").select("doc_id", F.col("text_hash").alias("__hash")).distinct(), "bad")
    left = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    right = checked_broadcast(bad).withColumnsRenamed({"doc_id": "__bad_id", "__hash": "__bad_hash"})
    on = left["doc_id"].eqNullSafe(right["__bad_id"]) & left["__hash"].eqNullSafe(right["__bad_hash"])
    return left.join(right, on, "left_anti").select(*docs.columns)
