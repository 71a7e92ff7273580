"""Ordered windows: cutting a large series into chunks must not change any result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from telvane.operators.series import in_chunks, last_rows, with_series_columns


@pytest.fixture(scope="module")
def skewed(spark):
    """One series holds most rows; its times repeat so that ties occur."""
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({
        "s": np.where(rng.random(n) < 0.8, "hot", [f"s{i % 7}" for i in range(n)]), "t": rng.integers(0, 900, n),
        "id": [f"{i:05d}" for i in range(n)], "x": rng.normal(size=n),
    })
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("max_rows", [100, 333, 5000])
def test_chunked_windows_equal_whole_windows(skewed, max_rows):
    def build(w):
        return {"lag": F.lag("x").over(w), "roll": F.round(F.avg("x").over(w.rowsBetween(-29, 0)), 9), "n": F.count("x").over(w.rowsBetween(-29, 0))}

    whole = Window.partitionBy("s").orderBy("t", "id")
    expected = {tuple(r) for r in skewed.withColumns(build(whole)).collect()}
    got = with_series_columns(skewed, "s", ["t", "id"], 29, build, max_rows)
    assert {tuple(r) for r in got.select("s", "t", "id", "x", "lag", "roll", "n").collect()} == expected


def test_chunks_stay_bounded(skewed):
    c = in_chunks(skewed, "s", ["t", "id"], 29, 200)
    largest = c.df.groupBy(*c.keys).count().agg(F.max("count")).first()[0]
    assert largest <= 200 * 1.5 + 29


def test_halo_crosses_tiny_chunks(spark):
    """A time shared by many rows makes neighbouring chunks small; the halo then spans several of them."""
    rows = [("a", 5 if 20 <= i < 280 else i, f"{i:04d}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, t int, id string, x double")
    build = lambda w: {"roll": F.sum("x").over(w.rowsBetween(-49, 0))}
    expected = {tuple(r) for r in df.withColumns(build(Window.partitionBy("s").orderBy("t", "id"))).collect()}
    assert {tuple(r) for r in with_series_columns(df, "s", ["t", "id"], 49, build, 10).select("s", "t", "id", "x", "roll").collect()} == expected


def test_last_rows_match_a_plain_ranking(skewed):
    w = Window.partitionBy("s").orderBy(F.desc("t"), F.desc("id"))
    expected = {(r["id"], r["r"]) for r in skewed.withColumn("r", F.row_number().over(w) - 1).filter("r < 40").collect()}
    assert {(r["id"], r["r"]) for r in last_rows(skewed, ["s"], ["t", "id"], 40).collect()} == expected
