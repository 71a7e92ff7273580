"""Selecting, coercing, imputing and encoding the feature columns."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telvane.functions.scalars import finite_or_null, to_number
from telvane.operators.quantiles import exact_quantiles
from telvane.schema import CYCLIC, FEATURES
from telvane.session import settle


def available_features(df: DataFrame, features: list[str] = FEATURES) -> list[str]:
    missing = [f for f in features if f not in df.columns]
    if missing:
        warnings.warn(f"skipping unavailable features: {missing}", stacklevel=2)
    return [f for f in features if f in df.columns]


def select_features(df: DataFrame, keep: list[str] = (), features: list[str] = FEATURES) -> DataFrame:
    return df.select(*keep, *available_features(df, features))


def require_features(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"not in the unified schema, missing: {missing}")
    return df


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in columns})


def factorise(df: DataFrame, column: str, order: list[str], out: str | None = None) -> DataFrame:
    """Codes 0, 1, ... for text values in order of first appearance under ``order``.

    The first appearance of a value is a plain minimum, so only the distinct
    values are numbered, by a range-partitioned sort, and joined back.
    """
    text = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    firsts = df.groupBy(text.alias("__v")).agg(F.min(F.struct(*order)).alias("__first"))
    codes = number_rows(firsts, ["__first"], "__code")
    joined = df.withColumn("__v", text).join(codes.select("__v", "__code"), "__v")
    return joined.withColumn(out or column, F.col("__code").cast("double")).drop("__v", "__code")


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Consecutive numbers from 0 in sort order: rows per sorted partition, then partition offsets."""
    ranged = settle(
        df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered"
    )
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (
        ranged.withColumn("__rn", inside)
        .join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__rn") - 1 + F.col("__offset"))
        .drop("__part", "__rn", "__offset")
    )


def infinities_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite_or_null(c) for c in columns})


def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; 0 for a column without values."""
    got = exact_quantiles(df, columns, [0.5])
    return {c: (got[c][0] if got[c][0] is not None else 0.0) for c in columns}


def fill_values(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in values.items()})


def impute_median(df: DataFrame, columns: list[str], medians: dict[str, float] | None = None) -> DataFrame:
    """Coerce to numbers, ±inf and NaN to null, null to the column's median (0 if it has none)."""
    ready = infinities_to_null(coerce_numeric(df, columns), columns)
    return fill_values(ready, medians if medians is not None else fit_medians(ready, columns))


def cyclic_columns(source: Column, prefix: str, period: int, integral: bool = True) -> dict[str, Column]:
    at = F.pmod(source.cast("int"), F.lit(period)) if integral else source
    angle = F.lit(2 * math.pi) * at / F.lit(float(period))
    return {f"{prefix}_sin": F.sin(angle), f"{prefix}_cos": F.cos(angle)}


def encode_cyclic(df: DataFrame, integral: bool = True, keep_hour: str | None = None) -> DataFrame:
    """Replace hour-of-day and day-of-week by sine/cosine pairs.

    ``integral`` truncates to whole hours/days modulo the period first.
    """
    out = df
    for source, (prefix, period) in CYCLIC.items():
        if source not in df.columns:
            continue
        if source == "time_of_day" and keep_hour:
            out = out.withColumn(keep_hour, F.pmod(F.col(source).cast("int"), F.lit(period)))
        out = out.withColumns(cyclic_columns(F.col(source), prefix, period, integral)).drop(source)
    return out
