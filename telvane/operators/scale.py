"""Robust scaling with exact quartiles, and min-max scaling with clipping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telvane.functions.scalars import clip
from telvane.operators.quantiles import exact_quantiles


@dataclass
class RobustScale:
    """(x - median) / IQR with a divisor of 1 for a zero IQR; fit once, apply to any table."""

    center: dict[str, float]
    scale: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> RobustScale:
        q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        center = {c: q[c][1] or 0.0 for c in columns}
        spread = {c: (q[c][2] - q[c][0]) if q[c][1] is not None else 0.0 for c in columns}
        return cls(center, {c: s if s != 0.0 else 1.0 for c, s in spread.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(float(m))) / F.lit(float(self.scale[c])) for c, m in self.center.items()}
        )

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, float(m), float(self.scale[c])) for c, m in self.center.items()]
        return spark.createDataFrame(rows, "feature string, center double, scale double")

    @classmethod
    def from_table(cls, df: DataFrame) -> RobustScale:
        """Read the fitted parameters back; one row per feature."""
        rows = df.collect()
        return cls({r["feature"]: r["center"] for r in rows}, {r["feature"]: r["scale"] for r in rows})


@dataclass
class MinMaxClip:
    """Min-max to [0, 1], clipped; a constant column maps to 0 at its own value."""

    low: float
    high: float

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> MinMaxClip:
        r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
        return cls(float(r["lo"]), float(r["hi"]))

    def expression(self, column):
        width = self.high - self.low
        return clip((column - F.lit(self.low)) / F.lit(width if width != 0 else 1.0), 0.0, 1.0)
