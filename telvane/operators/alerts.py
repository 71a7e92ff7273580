"""Alert records, threshold calibration and alert summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telvane.functions import confusion as C
from telvane.functions.context import activity_factor, adaptive_tau, alert_level, device_risk, load_proxy, pseudo_device_type
from telvane.functions.scalars import col, digest
from telvane.operators.quantiles import exact_quantiles
from telvane.schema import DEVICE_RISK_ONLINE, DEVICE_RISK_SUITE, ONLINE, ThresholdPreset


def calibrate_tau(df: DataFrame, score: str = "score", label: str = "label", target_fpr: float = 0.05,
                  low: float = 0.1, high: float = 0.9) -> float:
    """Base threshold: the (1 - target FPR) quantile of normal scores, clipped."""
    got = exact_quantiles(df.filter(F.col(label) == 0), [score], [1.0 - target_fpr])[score][0]
    return min(max(got if got is not None else low, low), high)


def with_device_context(df: DataFrame, device: str = "device_id") -> DataFrame:
    """A stable pseudo device type and its risk for devices without a declared type."""
    typed = df.withColumn("device_type", pseudo_device_type(device))
    return typed.withColumn("risk", device_risk("device_type", DEVICE_RISK_SUITE))


def with_load(df: DataFrame, reference: DataFrame, z: str = "z", out: str = "load") -> DataFrame:
    """Load proxy: deviation over its 95th percentile in a reference table."""
    p95 = exact_quantiles(reference, [z], [0.95])[z][0] or 0.0
    return df.withColumn(out, load_proxy(z, p95))


def alert_columns(
    row_id="row_id", device="device_id", ts="ts", score="score", s_if="s_if", p_rf="p_rf", attack_type="attack_type",
    device_type="device_type", load="load", hour="hour", preset: ThresholdPreset = ONLINE,
    risks: dict[str, float] = DEVICE_RISK_ONLINE, tau_base=None,
) -> list[Column]:
    """The alert record of a row as columns; map-only, so the same on tables and streams.

    The id is a hash of the row key; the hour in the context is the row's own.
    """
    risk = device_risk(device_type, risks)
    tau = adaptive_tau(load, risk, hour, preset, tau_base)
    return [
        F.concat(F.lit("ALERT-"), F.substring(digest("alert", row_id), 1, 12)).alias("alert_id"),
        col(device).alias("device_id"),
        col(ts).alias("timestamp"),
        col(score).alias("fused_score"),
        tau.alias("threshold_used"),
        alert_level(score, tau, preset.margin).alias("alert_level"),
        col(attack_type).alias("attack_type"),
        col(s_if).alias("s_if_score"),
        col(p_rf).alias("p_rf_score"),
        F.struct(
            F.round(col(load), 3).alias("network_load"), F.round(risk, 3).alias("device_risk"),
            F.round(activity_factor(hour), 3).alias("time_factor"), col(hour).cast("int").alias("hour"),
            col(device_type).alias("device_type"),
        ).alias("context"),
    ]


def build_alerts(df: DataFrame, raised_only: bool = False, **kwargs) -> DataFrame:
    alerts = df.select(*alert_columns(**kwargs))
    return alerts.filter(F.col("alert_level") != "NONE") if raised_only else alerts


def rounded(alerts: DataFrame, digits: int = 4) -> DataFrame:
    """The stored form of alerts: scores and threshold rounded."""
    return alerts.withColumns({c: F.round(c, digits) for c in ("fused_score", "threshold_used", "s_if_score", "p_rf_score")})


def number_alerts(report: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Sequential ids for a bounded report: the first ``limit`` alerts in order."""
    top = report.orderBy(*order).limit(limit)
    n = F.row_number().over(Window.orderBy(*order))  # at most `limit` rows
    return top.withColumn("alert_id", F.format_string("ALERT-%06d", n))


def alert_summary(alerts: DataFrame, slices: list[str] | None = None) -> DataFrame:
    """Totals by level and score mean/max over raised alerts."""
    raised = alerts.filter(F.col("alert_level") != "NONE")
    return raised.groupBy(*(slices or [])).agg(
        F.count(F.lit(1)).alias("total_alerts"),
        C.count_where(F.col("alert_level") == "CRITICAL").alias("critical_count"),
        C.count_where(F.col("alert_level") == "WARNING").alias("warning_count"),
        F.round(F.avg("fused_score"), 4).alias("mean_score"),
        F.round(F.max("fused_score"), 4).alias("max_score"),
    )


def attack_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("alert_level") != "NONE").groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))


def predicted_attack_type(p_rf: Column | str, threshold: float) -> Column:
    return F.when(col(p_rf) >= F.lit(threshold), "Attack").otherwise("Normal")
