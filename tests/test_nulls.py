"""Null keys, tied order keys and dates: no row is lost and row limits do not change answers."""

import datetime

from pyspark.sql import functions as F

from telvane.operators.evaluate import warm_up_impact
from telvane.operators.quantiles import grouped_quantile
from telvane.operators.ranking import empirical_rank, ranking_metrics
from telvane.operators.series import with_series_columns
from telvane.operators.split import hold_out_class, stratified_sample, stratified_split


def table(spark, n=100, nulls=25):
    return spark.range(n).select(
        F.col("id").cast("string").alias("row_id"),
        F.when(F.col("id") >= nulls, (F.col("id") % 2).cast("int")).alias("label"),
        F.when(F.col("id") >= nulls, F.concat(F.lit("c"), F.col("id") % 3)).alias("attack_cat"),
        F.when(F.col("id") >= nulls, F.col("id") % 7 / 7).alias("score"),
        F.lit("train").alias("split"),
    )


def test_null_strata_stay(spark):
    df = table(spark).drop("split")
    assert stratified_split(df).count() == 100
    kept = stratified_sample(df, 50).groupBy("label").count().collect()
    assert sum(r["count"] for r in kept) in range(49, 52) and any(r["label"] is None for r in kept)


def test_hold_out_keeps_unknown_categories(spark):
    assert hold_out_class(table(spark), "absent").count() == 100
    assert hold_out_class(table(spark), "c0").filter("attack_cat is null").count() == 25


def test_rank_keeps_rows_without_score(spark):
    out = empirical_rank(table(spark), "score", F.lit(True), "rank")
    assert out.count() == 100 and out.filter("rank is null").count() == 25


def test_labels_unknown_count_nowhere(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.95), (None, 0.2)], "label int, score double")
    assert ranking_metrics(rows).first()["roc_auc"] == 1.0


def test_warm_up_with_ties(spark):
    rows = spark.range(100).select(
        F.lit("d").alias("device_id"), F.when(F.col("id") < 60, 0).otherwise(F.col("id")).alias("ts"), F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label")
    )
    got = {r["segment"]: r["n"] for r in warm_up_impact(rows, F.lit(True), first=10).collect()}
    assert got == {"warm_up_first_10": 10, "after_warm_up_11_plus": 90}


def test_grouped_quantile_with_a_large_null_group(spark):
    rows = spark.createDataFrame([(None, float(i)) for i in range(150)] + [("a", float(i)) for i in range(30)] + [("b", float(i)) for i in range(20)], "g string, x double")
    direct = sorted(map(tuple, grouped_quantile(rows, "g", ["x"], 0.5).collect()), key=str)
    assert direct == sorted(map(tuple, grouped_quantile(rows, "g", ["x"], 0.5, direct_rows=100).collect()), key=str)
    assert len(direct) == 3


def test_null_series_and_date_keys_are_cut_alike(spark):
    start = datetime.date(2024, 1, 1)
    rows = spark.createDataFrame(
        [(None if i % 3 == 0 else "d", start + datetime.timedelta(days=i), i, float(i * i % 17)) for i in range(120)], "device string, day date, id long, x double"
    )

    def rolled(limit):
        out = with_series_columns(rows, "device", ["day", "id"], 4, lambda w: {"m": F.avg("x").over(w.rowsBetween(-4, 0))}, limit)
        return sorted(map(tuple, out.select("id", F.round("m", 9)).collect()))

    assert len(rolled(None)) == 120 and rolled(None) == rolled(15)
