"""Thresholds that follow a stream of labelled scores, published as versions and read by alert streams.

The state is one histogram of counts by score bin and label, kept by a streaming aggregation: it has at most
2 * (bins + 1) rows whatever the stream holds, and the counts of parts of a stream add up. After each micro-batch a
version is published: the (1 - target FPR) quantile of normal scores as the base threshold, which is above the exact
quantile by at most one bin, and the threshold of the largest F1. A version's folder is named by the micro-batch, so a
batch that is run again writes the same version again.

An alert stream notes the version it used for each micro-batch before it writes alerts, and a batch that is run again
uses the noted one, so its alerts do not change when newer versions have come.

Scores below 0 count as 0, above 1 as 1; rows with a null score or label are not counted. Without normal rows the base
threshold is the lowest allowed; without attacks F1 is 0 and its threshold is 1 / bins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telvane.functions.scalars import clip, col
from telvane.operators.alerts import build_alerts, rounded

VERSION = "version long, tau double, best_threshold double, best_f1 double, n long, n_normal long"


def score_histogram(scores: DataFrame, score: str = "score", label: str = "label", bins: int = 1000) -> DataFrame:
    """(bin, normal, attacks): counts per score bin; works on tables and streams."""
    known = scores.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    place = F.floor(clip(col(score), 0.0, 1.0) * bins).cast("int").alias("bin")
    attack = F.when(F.col(label) == 1, 1).otherwise(0)
    return known.groupBy(place).agg(F.sum(1 - attack).alias("normal"), F.sum(attack).alias("attacks"))


def thresholds(histogram: DataFrame, bins: int = 1000, target_fpr: float = 0.05, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(tau, best_threshold, best_f1, n, n_normal) of a histogram, as one row."""
    spark = histogram.sparkSession
    grid = spark.range(bins + 1).select(F.col("id").cast("int").alias("bin"))
    every = Window.partitionBy()  # bins + 1 rows
    upto, on = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    # At most bins + 1 rows. A broadcast reads every partition of a stream's state, which must all be committed; a sorted
    # join leaves out those in which the grid has no bin.
    rows = grid.join(F.broadcast(histogram), "bin", "left").select("bin", F.coalesce("normal", F.lit(0)).alias("normal"), F.coalesce("attacks", F.lit(0)).alias("attacks"))
    rows = rows.select(
        "bin", F.sum("normal").over(upto).alias("below"), F.sum("normal").over(every).alias("n0"), F.sum("attacks").over(every).alias("n1"),
        F.sum("attacks").over(on).alias("tp"), F.sum("normal").over(on).alias("fp"),
    )
    reached = F.col("below") >= F.ceil(F.col("n0") * F.lit(1.0 - target_fpr))
    f1 = F.when(F.col("n1") + F.col("tp") + F.col("fp") > 0, 2.0 * F.col("tp") / (F.col("n1") + F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    tau = F.when(F.max("n0") > 0, F.min(F.when(reached, F.col("bin") + 1)) / F.lit(float(bins))).otherwise(F.lit(low))
    best = F.max(F.when(F.col("bin").between(1, bins - 1), F.struct(f1.alias("f1"), (-F.col("bin")).alias("bin"))))
    return rows.agg(tau.alias("tau"), best.alias("best"), F.max("n0").alias("n_normal"), F.max(F.col("n0") + F.col("n1")).alias("n")).select(
        clip(F.col("tau"), low, high).alias("tau"), (-F.col("best.bin") / F.lit(float(bins))).alias("best_threshold"), F.col("best.f1").alias("best_f1"),
        F.col("n").cast("long").alias("n"), F.col("n_normal").cast("long").alias("n_normal"),
    )


def publish_thresholds(stream: DataFrame, path: str, checkpoint: str, bins: int = 1000, target_fpr: float = 0.05,
                       score: str = "score", label: str = "label") -> StreamingQuery:
    """Publish a version under ``path`` after every micro-batch of a stream of labelled scores."""

    def publish(histogram: DataFrame, batch: int) -> None:
        row = thresholds(histogram, bins, target_fpr).withColumn("version", F.lit(batch).cast("long"))
        row.select(*[c.split()[0] for c in VERSION.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{path}/v={batch}")  # one row

    counted = score_histogram(stream, score, label, bins)
    return counted.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(publish).start()


def published(spark: SparkSession, path: str) -> DataFrame:
    """All published versions; empty where there is none yet."""
    try:
        return spark.read.schema(VERSION).parquet(f"{path}/v=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSION)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version, one row or none."""
    return published(spark, path).orderBy(F.desc("version")).limit(1)


def alert_with_published(scored: DataFrame, versions: str, out: str, checkpoint: str, default_tau: float = 0.5,
                         make: Callable[..., DataFrame] = build_alerts, **kwargs) -> StreamingQuery:
    """Raised alerts of a scored stream with the newest published threshold of each micro-batch, and its version.

    ``default_tau`` holds, with a null version, until there is one. Alerts go to ``out``/alerts/batch=N.
    """

    def raise_alerts(rows: DataFrame, batch: int) -> None:
        spark, note = rows.sparkSession, f"{out}/used/batch={batch}"
        used = noted(spark, note)
        if used is None:
            newest = latest(spark, versions).first() or (None, default_tau)
            spark.createDataFrame([(newest[0], float(newest[1]))], "version long, tau double").coalesce(1).write.mode("overwrite").parquet(note)  # one row
            used = noted(spark, note)
        alerts = rounded(make(rows, raised_only=True, tau_base=float(used["tau"]), **kwargs))
        alerts.withColumn("tau_version", F.lit(used["version"]).cast("long")).write.mode("overwrite").parquet(f"{out}/alerts/batch={batch}")

    return scored.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(raise_alerts).start()


def noted(spark: SparkSession, note: str) -> Row | None:
    """The version and threshold noted for a micro-batch, if it has begun before."""
    try:
        return spark.read.schema("version long, tau double").parquet(note).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
