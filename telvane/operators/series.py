"""Ordered work per series (device, file) that stays bounded when one series is huge.

A window partitioned by device puts each device into one task. When one device
holds a third of all rows that task never ends, so series above ``max_rows``
are cut into time chunks, and every chunk gets the ``halo`` rows that precede
it. Windows that look back at most ``halo`` rows then give the same result as
over the whole series.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from telvane.session import settle

MAX_ROWS_PER_SERIES = 5_000_000
#: Least resolution of the sketch that chunk boundaries are taken from.
CELLS = 256
CHUNK, IS_HALO = "__chunk", "__halo"


@dataclass
class Chunked:
    """Rows tagged with chunk and halo flag; ``keys`` identify a bounded group."""

    df: DataFrame
    keys: list[str]

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop the halo rows and helper columns after the per-chunk work."""
        if IS_HALO not in df.columns:
            return df
        return df.filter(~F.col(IS_HALO)).drop(CHUNK, IS_HALO)


def order_number(c: str, df: DataFrame) -> Column:
    """The leading order key as a number: microseconds for times, else a double."""
    kind = dict(df.dtypes)[c]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp"))
    if kind == "date":
        return F.unix_date(F.col(c)).cast("long")
    return F.col(c).cast("double")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet null keys; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"__right_{k}"])
    return left.join(right, same, how).drop(*[f"__right_{k}" for k in keys])


def large_series(df: DataFrame, series: str, order: str, max_rows: int) -> DataFrame | None:
    """Chunk boundaries (values of the order key) of each series above ``max_rows``; None if there is no such series.

    All series are sketched in one pass at one resolution; each takes as many of its boundaries as it needs.
    """
    sized = df.groupBy(series).agg(F.count(F.lit(1)).alias("__n"))
    most = sized.agg(F.max("__n")).first()[0] or 0
    if most <= max_rows:
        return None
    sized = settle(sized.filter(F.col("__n") > max_rows), "sizes")
    cells = max(CELLS, math.ceil(most / max_rows))
    probs = [i / cells for i in range(1, cells)]
    held = null_safe_join(df.select(series, order_number(order, df).alias("__number")), sized, [series])
    sketched = held.groupBy(series).agg(
        F.max("__n").alias("__n"), F.percentile_approx("__number", probs, max(10_000, 20 * cells)).alias("__cells")
    )
    pieces = F.ceil(F.col("__n") / F.lit(max_rows)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.element_at("__cells", F.floor(i * cells / pieces).cast("int")))
    bounds = F.array_sort(F.array_distinct(F.filter(cuts, lambda b: b.isNotNull())))
    cut = sketched.select(series, bounds.alias("__bounds"))
    return settle(cut.withColumn("__step", F.greatest(F.lit(1), F.floor(F.sqrt(F.size("__bounds"))).cast("int"))), "cuts")


def _chunk_number(value: Column, bounds: Column, step: Column) -> Column:
    """How many sorted bounds are <= value, probing every step-th bound first."""
    heads = F.filter(F.transform(bounds, lambda b, i: F.when(i % step == 0, b)), lambda b: b.isNotNull())
    passed = F.greatest(F.size(F.filter(heads, lambda b: b <= value)) - 1, F.lit(0)) * step
    return passed + F.size(F.filter(F.slice(bounds, passed + 1, step), lambda b: b <= value))


def _halo_sources(counts: DataFrame, series: str, halo: int) -> DataFrame:
    """(series, source chunk, __target) for every chunk that holds some of the last ``halo`` rows before a target.

    ``counts``: rows n of each (series, chunk). Each chunk has a row, so at most ``halo`` chunks before a target matter.
    """
    along = Window.partitionBy(series).orderBy(CHUNK)
    placed = counts.withColumn("__end", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.collect_list(F.struct(CHUNK, "__end")).over(along.rowsBetween(-halo, -1))
    placed = placed.select(series, F.col(CHUNK).alias("__target"), (F.col("__end") - F.col("n")).alias("__start"), before.alias("__before"))
    near = F.filter("__before", lambda x: F.col("__start") - x["__end"] < halo)
    return placed.select(series, F.explode(near).alias("__x"), "__target").select(series, F.col(f"__x.{CHUNK}").alias(CHUNK), "__target")


def in_chunks(df: DataFrame, series: str, order: list[str], halo: int, max_rows: int | None = None) -> Chunked:
    """Cut large series into chunks with ``halo`` preceding rows; small series stay whole.

    ``order`` must end in a unique key. Rows that tie on its first column stay in one chunk. The number of jobs does
    not depend on the number of large series: sizes, boundaries and halo pairs stay tables.
    """
    max_rows = max_rows or MAX_ROWS_PER_SERIES
    cuts = large_series(df, series, order[0], max_rows)
    if cuts is None:
        return Chunked(df, [series])
    number = order_number(order[0], df)
    # The cuts are a written table of known size: Spark broadcasts them when small, else it shuffles.
    tagged = (
        null_safe_join(df, cuts, [series], "left")
        .withColumn(
            CHUNK,
            F.when(F.col("__bounds").isNull(), 0)
            .otherwise(_chunk_number(number, F.col("__bounds"), F.col("__step")))
            .cast("int"),
        )
        .withColumn(IS_HALO, F.lit(False))
    )
    rows = tagged.drop("__bounds", "__step")
    if halo:
        large = tagged.filter(F.col("__bounds").isNotNull()).drop("__bounds", "__step")
        counts = large.groupBy(series, CHUNK).agg(F.count(F.lit(1)).alias("n"))
        targets = settle(_halo_sources(counts, series, halo), "halo")
        newest = Window.partitionBy(series, CHUNK).orderBy(*[F.col(c).desc() for c in order])
        newest_rows = large.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= halo).drop("__rn")
        tails = (
            null_safe_join(newest_rows, targets, [series, CHUNK])
            .withColumn(CHUNK, F.col("__target"))
            .withColumn(IS_HALO, F.lit(True))
            .drop("__target")
        )
        rows = rows.unionByName(tails)
    return Chunked(rows, [series, CHUNK])


def with_series_columns(
    df: DataFrame,
    series: str,
    order: list[str],
    halo: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    max_rows: int | None = None,
) -> DataFrame:
    """Add window columns that look back at most ``halo`` rows within a series."""
    chunked = in_chunks(df, series, order, halo, max_rows)
    window = Window.partitionBy(*chunked.keys).orderBy(*order)
    return chunked.finish(chunked.df.withColumns(build(window)))


def first_rows(df: DataFrame, series: list[str], order: list[str], n: int, salts: int = 32) -> DataFrame:
    """The first ``n`` rows per series, ranked in the same two rounds as ``last_rows``; null keys are a series."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    for keys in ([*series, "__salt"], series):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("__rn", rank).filter(F.col("__rn") <= n).drop("__rn")
    return salted.drop("__salt")


def last_rows(df: DataFrame, series: list[str], order: list[str], n: int, salts: int = 32) -> DataFrame:
    """The last ``n`` rows per series, as column ``r`` = 0 for the newest.

    Two rounds: the first keeps ``n`` rows per (series, salt), so no task ever
    receives more than a slice of a hot series; the second ranks what is left.
    Both rounds prune inside the map tasks (WindowGroupLimit).
    """
    newest = [F.col(c).desc() for c in order]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    first = Window.partitionBy(*series, "__salt").orderBy(*newest)
    kept = salted.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= n).drop("__rn", "__salt")
    final = Window.partitionBy(*series).orderBy(*newest)
    return (
        kept.withColumn("__rn", F.row_number().over(final)).filter(F.col("__rn") <= n)
        .withColumn("r", F.col("__rn") - 1)
        .drop("__rn")
    )
