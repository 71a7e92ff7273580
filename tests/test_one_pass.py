"""Large series and large groups are handled together: the number of jobs does not depend on how many there are."""

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from telvane.operators.quantiles import grouped_quantile
from telvane.operators.series import in_chunks, with_series_columns


def jobs(spark, work) -> int:
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, "counted")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def table(spark, groups: int):
    """Group g has 60 + 7 g rows; group 0 has a null key, and every fifth value is missing."""
    rows = [(None if g == 0 else f"g{g}", i, float((i * 37 + g) % 101) if i % 5 else None) for g in range(groups) for i in range(60 + 7 * g)]
    return spark.createDataFrame(rows, "g string, t long, x double").withColumn("id", F.col("t"))


def test_jobs_do_not_grow_with_the_number_of_large_series(spark):
    def chunk(df):
        return with_series_columns(df, "g", ["t", "id"], 3, lambda w: {"m": F.sum("x").over(w.rowsBetween(-3, 0))}, 40)

    few, many = table(spark, 3), table(spark, 18)
    assert jobs(spark, lambda: chunk(many).collect()) <= jobs(spark, lambda: chunk(few).collect()) + 2
    whole = with_series_columns(many, "g", ["t", "id"], 3, lambda w: {"m": F.sum("x").over(w.rowsBetween(-3, 0))})
    key = lambda df: sorted(map(str, df.select("g", "t", "m").collect()))
    assert key(chunk(many)) == key(whole)
    sizes = in_chunks(many, "g", ["t", "id"], 0, 40).df.groupBy("g", "__chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 50


def test_jobs_do_not_grow_with_the_number_of_large_groups(spark):
    few, many = table(spark, 3), table(spark, 18)
    run = lambda df: grouped_quantile(df, "g", ["x", "t"], 0.75, 50)
    assert jobs(spark, lambda: run(many).collect()) <= jobs(spark, lambda: run(few).collect()) + 2
    got = {r["g"]: (r["x"], r["t"]) for r in run(many).collect()}
    assert len(got) == 18
    for g in range(18):
        x = [float((i * 37 + g) % 101) for i in range(60 + 7 * g) if i % 5]
        t = np.quantile(np.arange(60 + 7 * g), 0.75)
        have = got[None if g == 0 else f"g{g}"]
        assert math.isclose(have[0], np.quantile(x, 0.75)) and math.isclose(have[1], t)


def test_quantile_of_a_large_group_without_values(spark):
    rows = spark.range(200).select(F.lit("a").alias("g"), F.lit(None).cast("double").alias("x"), F.col("id").alias("y"))
    assert [tuple(r) for r in grouped_quantile(rows, "g", ["x", "y"], 0.5, 20).collect()] == [("a", None, 99.5)]
