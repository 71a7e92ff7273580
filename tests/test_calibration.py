"""Thresholds published by a stream, against counting by hand, and alerts that use them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from telvane.operators.alerts import calibrate_tau
from telvane.streaming import calibration as cal

SCHEMA = "row_id string, score double, label int"


def rows_of(seed: int, n: int) -> list[tuple]:
    return [(f"{seed}-{i}", ((i * 7919 + seed * 104729) % 1000) / 999 * (0.6 if i % 5 else 1.0), 0 if i % 5 else 1) for i in range(n)]


def by_hand(rows: list[tuple], bins: int) -> tuple:
    known = [(min(bins, math.floor(min(1.0, max(0.0, s)) * bins)), y) for _, s, y in rows if s is not None and y is not None]
    normal = sorted(b for b, y in known if y != 1)
    tau = min(0.9, max(0.1, (normal[math.ceil(len(normal) * 0.95) - 1] + 1) / bins)) if normal else 0.1
    attacks = [b for b, y in known if y == 1]

    def f1(t):
        tp, fp = sum(b >= t for b in attacks), sum(b >= t for b in normal)
        return 2 * tp / (len(attacks) + tp + fp) if len(attacks) + tp + fp else 0.0

    best = max(range(1, bins), key=lambda t: (f1(t), -t))
    return round(tau, 9), round(best / bins, 9), round(f1(best), 9), len(known), len(normal)


def row(df) -> tuple:
    r = df.first()
    return round(r["tau"], 9), round(r["best_threshold"], 9), round(r["best_f1"], 9), r["n"], r["n_normal"]


def test_thresholds_of_awkward_tables(spark):
    odd = [("a", None, 0), ("b", 0.5, None), ("c", 7.0, 1), ("d", -1.0, 0), ("e", 0.5, 0), ("e", 0.5, 0)]
    for rows in (rows_of(1, 400), odd, [], [("x", 0.3, 1)], [("x", 0.3, 0)]):
        got = row(cal.thresholds(cal.score_histogram(spark.createDataFrame(rows, SCHEMA), bins=50), bins=50))
        assert got == by_hand(rows, 50), rows[:3]


def test_versions_follow_the_stream(spark, tmp_path):
    path = str(tmp_path)
    everything = []
    for k in range(3):  # each run continues where the last one stopped
        part = rows_of(k, 300 + 100 * k)
        everything += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/labelled")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/labelled")
        cal.publish_thresholds(stream, f"{path}/versions", f"{path}/checkpoint", bins=100).awaitTermination()
        newest = cal.latest(spark, f"{path}/versions")
        assert row(newest) == by_hand(everything, 100)
        exact = calibrate_tau(spark.createDataFrame(everything, SCHEMA))
        assert abs(newest.first()["tau"] - exact) <= 0.02  # one bin, and the step between two scores
    assert [r["version"] for r in cal.published(spark, f"{path}/versions").orderBy("version").collect()] == [0, 1, 2]


def test_alerts_use_the_noted_version(spark, tmp_path):
    path = str(tmp_path)
    one = lambda df, raised_only, tau_base: df.select(
        "row_id", F.col("score").alias("fused_score"), F.lit(tau_base).alias("threshold_used"), F.lit(0.0).alias("s_if_score"), F.lit(0.0).alias("p_rf_score")
    ).filter(F.col("fused_score") >= tau_base)
    spark.createDataFrame([("a", 0.45, 0), ("b", 0.55, 1)], SCHEMA).coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    cal.alert_with_published(stream, f"{path}/versions", f"{path}/out", f"{path}/c1", make=one).awaitTermination()
    found = {(r["row_id"], r["threshold_used"], r["tau_version"]) for r in spark.read.parquet(f"{path}/out/alerts").collect()}
    assert found == {("b", 0.5, None)}  # nothing published yet
    spark.createDataFrame([(4, 0.4, 0.4, 1.0, 2, 1)], cal.VERSION).write.parquet(f"{path}/versions/v=4")
    # the same micro-batch again, as after a failure: the noted threshold holds
    cal.alert_with_published(stream, f"{path}/versions", f"{path}/out", f"{path}/c2", make=one).awaitTermination()
    assert spark.read.parquet(f"{path}/out/alerts").count() == 1
    # a new stream meets the published version
    cal.alert_with_published(stream, f"{path}/versions", f"{path}/new", f"{path}/c3", make=one).awaitTermination()
    found = {(r["row_id"], r["threshold_used"], r["tau_version"]) for r in spark.read.parquet(f"{path}/new/alerts").collect()}
    assert found == {("a", 0.4, 4), ("b", 0.4, 4)}


def test_every_partition_of_the_state_is_read(spark, tmp_path):
    """Most of 40 partitions hold none of eleven bins; their state is committed all the same, also if the stream is large."""
    spark.createDataFrame([("a", 0.1, 0), ("b", 0.95, 1), ("c", 0.2, 0)], SCHEMA).write.parquet(f"{tmp_path}/in")
    large = {"spark.sql.shuffle.partitions": "40", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in large}
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        cal.publish_thresholds(stream, f"{tmp_path}/versions", f"{tmp_path}/checkpoint", bins=10).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    newest = cal.latest(spark, f"{tmp_path}/versions").first()
    assert [newest[c] for c in ("version", "n", "n_normal", "best_threshold", "best_f1")] == [0, 3, 2, 0.3, 1.0]
