"""Running totals over a sorted key: prefix sums of ranges, of groups of ranges, and inside ranges.

Rows are dealt into ranges of (slice, key) of bounded size. A range's offset is the sum of the whole groups of ranges
before its group, plus the ranges before it inside the group; a group has about as many ranges as there are groups.
So no task holds more than one range, or the square root of the number of ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telvane.session import settle

ROWS_PER_BUCKET = 1_000_000


def bucketed(
    df: DataFrame, slices: list[str], key: str, sums: dict[str, str], rows_per_bucket: int | None = None, descending: bool = False
) -> DataFrame:
    """Inclusive running totals named by ``sums`` (new name -> column) of rows with distinct keys per slice. No null keys."""
    df = settle(df.filter(F.col(key).isNotNull()), "per-value")
    pieces = math.ceil(df.count() / (rows_per_bucket or ROWS_PER_BUCKET))
    order = F.col(key).desc() if descending else F.col(key)
    if pieces <= 1:
        window = Window.partitionBy(*(slices or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(c).over(window) for name, c in sums.items()})
    ranged = settle(df.repartitionByRange(pieces, *slices, order).withColumn("__bucket", F.spark_partition_id()), "ranged")
    fan = math.isqrt(pieces) + 1
    per_bucket = ranged.groupBy(*slices, "__bucket").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    per_bucket = settle(per_bucket.withColumn("__group", F.floor(F.col("__bucket") / fan).cast("int")), "ranges")
    per_group = per_bucket.groupBy(*slices, "__group").agg(*[F.sum(name).alias(name) for name in sums])
    groups = per_group.select(*slices, "__group", *_before(sums, slices, "__group", "__g"))
    inner = per_bucket.select(*slices, "__group", "__bucket", *_before(sums, [*slices, "__group"], "__bucket", "__b"))
    both = _same(inner, groups, [*slices, "__group"])
    offsets = both.select(*slices, "__bucket", *[(F.col(f"__g_{name}") + F.col(f"__b_{name}")).alias(f"__o_{name}") for name in sums])
    inside = Window.partitionBy(*slices, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"__i_{name}": F.sum(c).over(inside) for name, c in sums.items()})
    return (
        _same(summed, offsets, [*slices, "__bucket"])
        .withColumns({name: F.col(f"__i_{name}") + F.col(f"__o_{name}") for name in sums})
        .select(*df.columns, *sums)
    )


def _before(sums: dict[str, str], by: list[str], order: str, prefix: str) -> list[Column]:
    """Totals of all earlier rows."""
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.sum(name).over(window), F.lit(0)).alias(f"{prefix}_{name}") for name in sums]


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null."""
    right = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return left.join(right, on).drop(*[f"__k_{k}" for k in keys])
