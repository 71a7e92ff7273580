"""Numeric, hashing and ratio expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp to [low, high]; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def to_number(c: Column | str) -> Column:
    """Numeric coercion that turns anything unparsable into null."""
    return col(c).try_cast("double")


def finite_or_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def digest(seed: int | str, *ids: Column | str) -> Column:
    """Hex digest of a seed and a row key: the same on every cluster and partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(i).cast("string") for i in ids]))


def digest_number(hexed: Column, start: int = 1, width: int = 8) -> Column:
    return F.conv(F.substring(hexed, start, width), 16, 10).cast("long")


def hash_uniform(seed: int | str, *ids: Column | str) -> Column:
    """A uniform number in [0, 1) decided by the row key alone."""
    return digest_number(digest(seed, *ids)) / F.lit(4294967296.0)


def hash_mod(modulus: int, *ids: Column | str, seed: int | str = 42) -> Column:
    return (digest_number(digest(seed, *ids)) % F.lit(modulus)).cast("int")


def grid_bin(score: Column | str, steps: int, top: int) -> Column:
    """How many of the grid points i/steps, i = 1..top, are <= score.

    ``floor(score * steps)`` can be off by one in floating point, so it is
    corrected by comparing with the grid points themselves.
    """
    score = col(score)
    low = F.floor(score * F.lit(float(steps)))
    low = F.when(score >= (low + 1) / F.lit(float(steps)), low + 1).when(
        score < low / F.lit(float(steps)), low - 1
    ).otherwise(low)
    return F.least(F.greatest(low, F.lit(0)), F.lit(top)).cast("int")
