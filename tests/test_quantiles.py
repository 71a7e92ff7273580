import numpy as np
import pandas as pd
import pytest

from telvane.operators.quantiles import exact_quantiles, grouped_quantile
from telvane.operators.scale import MinMaxClip, RobustScale


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(2)
    n = 20_000
    pdf = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.7, "hot", "cold"), "a": rng.lognormal(size=n), "b": np.where(rng.random(n) < 0.6, 3.0, rng.normal(size=n)),
        "c": rng.integers(0, 5, n).astype(float),
    })
    pdf.loc[::97, "a"] = np.nan
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("direct", [100, 3000, 10**6])
def test_bracketing_gives_numpy_quantiles(numbers, direct):
    pdf, df = numbers
    probs = [0.0, 0.25, 0.5, 0.951, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs, direct)
    for c in "abc":
        assert np.allclose(got[c], np.nanquantile(pdf[c], probs), rtol=0, atol=1e-12)


def test_grouped(numbers):
    pdf, df = numbers
    got = {r["g"]: r["a"] for r in grouped_quantile(df, "g", ["a"], 0.75, 8000).collect()}
    assert got == pytest.approx(pdf.groupby("g")["a"].quantile(0.75).to_dict())


def test_empty_column_has_no_quantile(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_robust_scale_keeps_zero_spread_columns(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(5)], "x double, k double")
    out = RobustScale.fit(df, ["x", "k"]).transform(df).collect()
    assert [r["x"] for r in out] == [-1.0, -0.5, 0.0, 0.5, 1.0]
    assert {r["k"] for r in out} == {0.0}


def test_min_max_clips_and_maps_constants_to_zero(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-5.0,), (0.0,), (5.0,), (20.0,)], "x double")
    m = MinMaxClip(0.0, 10.0)
    assert [r[0] for r in df.select(m.expression(F.col("x"))).collect()] == [0.0, 0.0, 0.5, 1.0]
    flat = MinMaxClip.fit(df.filter("x = 5"), "x")
    assert df.filter("x = 5").select(flat.expression(F.col("x"))).first()[0] == 0.0
