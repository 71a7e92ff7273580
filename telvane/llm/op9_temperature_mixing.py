"""Mixing sources to target weights by temperature.

Source s with a share p of all tokens gets weight p**t / sum(p**t). The exponent t lies between 0 (all sources alike)
and 1 (as they are) and is bisected to meet a target:

* ``entropy``: the weights' entropy in nats, at least the target (the largest t that reaches it; 0 if none does), or
* ``repeats``: how often a source is read in total relative to the least repeated one, at most the limit (the smallest
  t that keeps to it).

Both are monotone in t. The budget in tokens defaults to the least one by which every source is read at least once.

Weights are realised as block permutations: a source's documents are dealt to blocks by a seeded hash, blocks are
visited in order of another hash, and documents in hash order inside a block. A source reads its permutation as often
as its budget holds and then a last part: the documents whose tokens, taken in that order, start before the budget
ends. So each source exceeds its budget by less than one document, and no order over a whole source is sorted: running
totals are taken over blocks of blocks, blocks, and the documents of a block.

A null source is a source of its own. Empty and null texts have 0 tokens and come with their block. A source without
tokens has no share and is read once. Rows that are equal are separate documents. Other columns pass through. Only
DataFrame operations are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telvane.llm.common import Scratch, checked_broadcast, null_safe

#: Documents of a block, and blocks of a group of blocks, on average.
BLOCK_ROWS, GROUP_BLOCKS = 256, 1024


def tokens(text: Column) -> Column:
    """Words of a text, counted as starts of runs of non-blank characters."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bisect_exponent(sizes: DataFrame, entropy: float | None, repeats: float | None, steps: int = 40) -> float:
    """``sizes``: tokens and n (sources with that many); the fewer distinct sizes, the fewer rows are read."""
    total = sizes.agg(F.sum(F.col("tokens") * F.col("n"))).first()[0]
    if not total:
        return 1.0
    logs = sizes.select((F.log(F.col("tokens") / F.lit(float(total)))).alias("x"), "n").persist()
    if repeats is not None:
        smallest, largest = logs.agg(F.min("x"), F.max("x")).first()

        def fits(t):  # weight / share = p**(t - 1), largest over smallest
            return (1 - t) * (largest - smallest) <= math.log(repeats) + 1e-12

        met_above = True
    else:

        def fits(t):
            z, m = logs.agg(F.sum(F.col("n") * F.exp(t * F.col("x"))), F.sum(F.col("n") * F.exp(t * F.col("x")) * F.col("x"))).first()
            return math.log(z) - t * m / z >= entropy
        met_above = False
    if not met_above and fits(1.0):
        logs.unpersist()
        return 1.0
    if fits(0.0) == met_above:  # even sources alike keep to the limit, or miss the entropy
        logs.unpersist()
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        if fits(middle) == met_above:
            high = middle
        else:
            low = middle
    logs.unpersist()
    return high if met_above else low


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, seed: int = 17) -> DataFrame:
    """``docs`` once per reading, with mix_source_tokens, mix_budget, mix_copy, mix_copies, mix_group, mix_block, mix_rank.

    A reading's place in the mixture is (mix_copy, mix_group, mix_block, mix_rank) within its source.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give either a target entropy or a limit of repeats")
    scratch = Scratch(docs.sparkSession, "mix")
    own = docs.columns
    docs = docs.select(
        *own, tokens(F.col("text")).alias("mix_tokens"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("mix_rank"),
    )
    narrow = scratch.settle(docs.select(F.col("source").alias("mix_source"), F.col("doc_id").alias("mix_doc"), "mix_rank", "mix_tokens"), "narrow")
    sources = narrow.groupBy("mix_source").agg(F.count(F.lit(1)).alias("mix_docs"), F.sum("mix_tokens").alias("mix_source_tokens"))
    sources = scratch.settle(sources, "sources")
    sized = sources.where("mix_source_tokens > 0").groupBy(F.col("mix_source_tokens").alias("tokens")).agg(F.count(F.lit(1)).alias("n"))
    t = bisect_exponent(sized, entropy, repeats)
    total, z, reach = sources.where("mix_source_tokens > 0").agg(
        F.sum("mix_source_tokens"), F.sum(F.pow(F.col("mix_source_tokens").cast("double"), F.lit(t))), F.max(F.pow(F.col("mix_source_tokens").cast("double"), F.lit(1 - t)))
    ).first()
    scale = (budget / z if budget is not None else reach) if total else 0.0  # budget of a source: scale * tokens**t
    have = F.col("mix_source_tokens")
    exact = F.lit(float(scale)) * F.pow(have.cast("double"), F.lit(t))
    # a budget within one token of whole readings is whole readings: rounding must not start another
    budgets = sources.withColumn("mix_budget", F.when(have > 0, F.round(exact).cast("long")).otherwise(0)).withColumn(
        "mix_full", F.when(have > 0, (F.col("mix_budget") / have).cast("long")).otherwise(1)
    ).withColumn("mix_rest", F.when(have > 0, F.col("mix_budget") - F.col("mix_full") * have).otherwise(0))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("mix_docs") / BLOCK_ROWS))
    groups = F.greatest(F.lit(1), F.ceil(blocks / GROUP_BLOCKS))
    budgets = budgets.withColumn("mix_blocks", blocks).withColumn("mix_groups", groups)
    budgets = checked_broadcast(scratch.settle(budgets, "budgets"), weight=F.lit(128))

    def placed(rows: DataFrame, source: str) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("mix_rank")), F.col("mix_blocks"))
        rows = null_safe(rows, budgets.withColumnRenamed("mix_source", source), [source])
        return rows.withColumn("mix_block", block).withColumn("mix_group", F.pmod(F.xxhash64(F.lit(seed + 2), F.col("mix_block")), F.col("mix_groups")))

    keys = ["mix_source", "mix_group", "mix_block"]
    by_block = placed(narrow.where("mix_tokens > 0"), "mix_source").groupBy(*keys).agg(F.sum("mix_tokens").alias("in_block"), F.first("mix_rest").alias("mix_rest"))
    by_block = scratch.settle(by_block, "blocks")
    by_group = by_block.groupBy("mix_source", "mix_group").agg(F.sum("in_block").alias("in_group"))
    before = F.sum("in_group").over(Window.partitionBy("mix_source").orderBy("mix_group").rowsBetween(Window.unboundedPreceding, -1))
    by_group = by_group.withColumn("before_group", F.coalesce(before, F.lit(0))).drop("in_group")
    inside = F.sum("in_block").over(Window.partitionBy("mix_source", "mix_group").orderBy("mix_block").rowsBetween(Window.unboundedPreceding, -1))
    cuts = null_safe(by_block.withColumn("inside", F.coalesce(inside, F.lit(0))), by_group, ["mix_source", "mix_group"])
    cuts = cuts.withColumn("left", F.col("mix_rest") - F.col("before_group") - F.col("inside"))
    # the block in which a source's last part ends; blocks before it are read whole
    cuts = scratch.settle(cuts.where("left > 0 and left <= in_block").select(*keys, "left"), "cuts")
    ends = checked_broadcast(cuts, weight=F.lit(64))
    edge = null_safe(placed(narrow, "mix_source"), ends, keys)
    run = F.sum("mix_tokens").over(Window.partitionBy(*keys).orderBy("mix_rank", "mix_doc").rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.withColumn("run", F.coalesce(run, F.lit(0))).where(F.col("run") < F.col("left"))
    # rows of equal rank are equal in text and doc_id: the last of them that is read names how many are
    last = edge.groupBy(*keys).agg(F.max("mix_rank").alias("last_rank"))
    last = scratch.settle(last, "last")
    ends = cuts.select("mix_source", F.col("mix_group").alias("end_group"), F.col("mix_block").alias("end_block"))
    ends = null_safe(ends, last.select("mix_source", "last_rank"), ["mix_source"])
    whole = by_block.select("mix_source").distinct()
    ends = checked_broadcast(scratch.settle(null_safe(whole, ends, ["mix_source"], "left"), "ends"), weight=F.lit(64))

    all_rows = placed(docs.withColumn("mix_source", F.col("source")), "mix_source")
    all_rows = null_safe(all_rows, ends, ["mix_source"], "left")
    here = F.struct("mix_group", "mix_block", "mix_rank")
    end = F.struct(F.col("end_group"), F.col("end_block"), F.col("last_rank"))
    partial = F.when(F.col("mix_rest") <= 0, False).when(F.col("end_group").isNull(), F.col("mix_rest") > 0).otherwise(here <= end)
    all_rows = all_rows.withColumn("mix_copies", F.col("mix_full") + partial.cast("long"))
    out = all_rows.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return out.select(*own, "mix_source_tokens", "mix_budget", "mix_copy", "mix_copies", "mix_group", "mix_block", "mix_rank")
