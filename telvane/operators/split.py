"""Splitting, sampling and holding out rows, decided by row keys instead of random state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telvane.functions.scalars import digest, hash_uniform
from telvane.schema import SEED
from telvane.session import settle

DIGITS = 32  # of a digest
BROADCAST_ROWS = 500_000
PREFIX, LIMIT = 3, 200_000  # hex digits of the digest added per level of the counting tree; rows ranked by one task


def split_column(row_id: Column | str = "row_id", seed: int = SEED, train: float = 0.7, val: float = 0.1) -> Column:
    """train/val/test by hash of the row key. Map-only: no counting and no shuffle."""
    u = hash_uniform(seed, row_id)
    return F.when(u < train, "train").when(u < round(train + val, 10), "val").otherwise("test")


def ranked_bands(
    df: DataFrame, stratum: str, cuts: Column, row_id: str = "row_id", seed: int = SEED, prefix: int = PREFIX, limit: int = LIMIT
) -> DataFrame:
    """Column ``band``: which slice of its stratum a row falls into, by digest order.

    ``cuts`` makes ascending row counts (an array) from the stratum and its rows ``__n``; a row with digest rank r gets
    the number of cuts <= r. Exact without ranking strata: rows are counted per digest prefix, and whole prefixes
    between cuts are done. A prefix that a cut falls into is ranked if it has at most ``limit`` rows; else its rows,
    and only those, are counted again with ``prefix`` more digits. Strata and prefixes are tables throughout.
    """
    rest = df.withColumn("__d", digest(seed, row_id))
    sizes = rest.groupBy(F.col(stratum).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    edges = sizes.withColumnRenamed("__s", stratum).withColumn("__cuts", cuts.cast("array<bigint>")).withColumnRenamed(stratum, "__s")
    # Open prefixes: rows before them in their stratum, and the cuts.
    open_ = settle(edges.select("__s", F.lit("").alias("__p"), F.lit(0).cast("long").alias("__before"), "__cuts"), "bands")
    out, digits = [], 0
    while True:
        known, digits = digits, min(digits + prefix, DIGITS)
        part = F.substring("__d", 1, digits)
        counted = rest.groupBy(F.col(stratum).alias("__s"), F.substring("__d", 1, known).alias("__p"), part.alias("__q")).agg(F.count(F.lit(1)).alias("__m"))
        counted = _joined(counted, open_, ["__s", "__p"])
        earlier = Window.partitionBy("__s", "__p").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)  # 16**prefix rows
        placed = counted.withColumn("__first", F.col("__before") + F.coalesce(F.sum("__m").over(earlier), F.lit(0)))
        inner = F.transform(F.filter("__cuts", lambda e: (e > F.col("__first")) & (e < F.col("__first") + F.col("__m"))), lambda e: e - F.col("__first"))
        plan = settle(placed.select("__s", F.col("__q").alias("__p"), "__m", "__first", "__cuts", inner.alias("__inner"), F.size(F.filter("__cuts", lambda e: e <= F.col("__first"))).alias("__done")), "bands")
        tagged = _joined(rest.withColumns({"__s": F.col(stratum), "__p": part}), plan, ["__s", "__p"])
        small = (F.col("__m") <= limit) | F.lit(digits == DIGITS)
        rank = F.row_number().over(Window.partitionBy("__s", "__p").orderBy("__d", row_id)) - 1
        out.append(tagged.filter(F.size("__inner") == 0).withColumn("band", F.col("__done")))
        cut = tagged.filter((F.size("__inner") > 0) & small).withColumn("__r", rank)
        out.append(cut.withColumn("band", F.col("__done") + F.size(F.filter("__inner", lambda e: e <= F.col("__r")))))
        large = plan.filter((F.size("__inner") > 0) & ~small)
        if large.isEmpty():
            break
        rest = settle(tagged.filter((F.size("__inner") > 0) & ~small).select(*df.columns, "__d"), "bands")
        open_ = large.select("__s", "__p", F.col("__first").alias("__before"), "__cuts")
    return reduce(DataFrame.unionAll, [part.select(*df.columns, "band") for part in out])


def _joined(rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Join a plan on keys that may be null; broadcast if its counted rows are few."""
    plan = plan.withColumnsRenamed({k: f"{k}_" for k in keys})
    small = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    return rows.join(small, [rows[k].eqNullSafe(plan[f"{k}_"]) for k in keys]).drop(*[f"{k}_" for k in keys])


def stratum_sizes(df: DataFrame, stratum: str) -> dict:
    return {r[stratum]: r["n"] for r in df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()}


def stratified_split(
    df: DataFrame, stratum: str = "label", row_id: str = "row_id", seed: int = SEED, train: float = 0.7, val: float = 0.1
) -> DataFrame:
    """train/val/test with exact shares inside every class, by digest order."""
    cuts = F.array(*[F.floor(F.col("__n") * F.lit(share) + F.lit(0.5)) for share in (train, train + val)])
    band = F.col("band")
    return (
        ranked_bands(df, stratum, cuts, row_id, seed)
        .withColumn("split", F.when(band == 0, "train").when(band == 1, "val").otherwise("test"))
        .drop("band")
    )


def stratified_sample(
    df: DataFrame, max_rows: int, stratum: str = "label", row_id: str = "row_id", seed: int = SEED
) -> DataFrame:
    """At most about ``max_rows`` rows, proportional per class and at least one of each."""
    rows = df.count()
    if not max_rows or rows <= max_rows:
        return df
    share = F.floor(F.lit(max_rows) * F.col("__n") / F.lit(rows) + F.lit(0.5))
    cuts = F.array(F.least(F.col("__n"), F.greatest(F.lit(1), share)))
    return ranked_bands(df, stratum, cuts, row_id, seed).filter(F.col("band") == 0).drop("band")


def normal_rows(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) == 0)


def hold_out_class(df: DataFrame, attack: str, split: str = "split", category: str = "attack_cat") -> DataFrame:
    """Remove one attack class from the training rows only."""
    return df.filter(~F.col(split).eqNullSafe(F.lit("train")) | ~F.col(category).eqNullSafe(F.lit(attack)))


def frequent_attacks(df: DataFrame, n: int = 3, category: str = "attack_cat", label: str = "label") -> DataFrame:
    """The most frequent attack classes of a table."""
    return (
        df.filter((F.col(label) == 1) & (F.col(category) != "Normal"))
        .groupBy(category)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), category)
        .limit(n)
    )


def attack_ratio(df: DataFrame, label: str = "label", low: float = 0.01, high: float = 0.45) -> DataFrame:
    """Share of attack rows clipped to a usable contamination (one row)."""
    share = F.avg(F.when(F.col(label) > 0, 1.0).otherwise(0.0))
    return df.agg(F.least(F.greatest(share, F.lit(low)), F.lit(high)).alias("attack_ratio"))
