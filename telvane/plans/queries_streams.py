"""Queries: streams run over the event table, compared with their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from telvane.functions import fusion
from telvane.operators.profile import FrozenProfiles
from telvane.plans import sql as Q
from telvane.plans import views
from telvane.plans.catalog import query, rounded
from telvane.plans.queries_alerts import _CX
from telvane.plans.queries_profile import _A, _B, _EVENT_PAIR, _EWMA, _M, _ONLINE, _OZ, _ROLLED, _SCORED, _Z
from telvane.session import scratch_path
from telvane.streaming import alerts, calibration, online


def _event_stream(spark, sf, per_trigger=None):
    """The event table as a stream of flow rows (two features that need no history)."""
    spark.conf.set(online.PROVIDER, online.ROCKSDB)  # a query is the application here
    schema = views.table(spark, sf, "events").schema
    ev = alerts.read_files(spark, f"{sf}/events.parquet", schema, per_trigger)
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        "event_id", F.col("event_id").cast("string").alias("row_id"), "ts", views.device_name("user_id").alias("device_id"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"), F.col("value").alias("byte_rate"), k.cast("double").alias("burst_length"),
    )


@query("x01_online_profile", _ONLINE + f"SELECT row_id, round({_OZ}, 6) AS deviation_zscore_mean, round(CASE WHEN c >= 20 THEN {_M} ELSE 0e0 END, 6) AS mahalanobis_dist, c >= 20 AS is_warm FROM on_")
def _(spark, sf):
    out = alerts.run_to_table(online.online_stream(_event_stream(spark, sf), _EVENT_PAIR, learn="all"))
    return rounded(out.select("row_id", "deviation_zscore_mean", "mahalanobis_dist", "is_warm"))


_NORMAL_ONLY = Q.with_(
    Q.FLOW, "fl0 AS (SELECT * FROM fl WHERE label = 0)", _ROLLED.replace("FROM fl ", "FROM fl0 "), _EWMA,
    f"""lr AS (SELECT fl.row_id, fl.label, fl.{_A}, fl.{_B}, last_value(on_.row_id IGNORE NULLS) OVER (PARTITION BY fl.device_id ORDER BY fl.ts, fl.row_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS learned FROM fl LEFT JOIN on_ ON fl.row_id = on_.row_id)""",
    f"""ns AS (SELECT lr.row_id, lr.label, lr.{_A}, lr.{_B}, on_.c, va, vab, vb, m_{_A}, m_{_B}, s_{_A}, s_{_B}
  FROM lr LEFT JOIN on_ ON lr.learned = on_.row_id)""", body="")


@query("x01_online_profile_normal_only", _NORMAL_ONLY + f"""SELECT row_id, label, round({_OZ}, 6) AS deviation_zscore_mean,
  round(CASE WHEN c >= 20 THEN {_M} ELSE 0e0 END, 6) AS mahalanobis_dist, coalesce(c >= 20, false) AS is_warm FROM ns""")
def _(spark, sf):
    """Attack rows are scored but not learned: they meet the state after the last normal row."""
    out = alerts.run_to_table(online.online_stream(_event_stream(spark, sf), _EVENT_PAIR))
    return rounded(out.select("row_id", "label", "deviation_zscore_mean", "mahalanobis_dist", "is_warm"))


@query("x02_frozen_profile_stream", _SCORED + f"SELECT row_id, round({_Z}, 6) AS z, round({_M}, 6) AS maha FROM j")
def _(spark, sf):
    profiles = FrozenProfiles.fit(views.flow_events(spark, sf), _EVENT_PAIR)
    return rounded(alerts.run_to_table(alerts.score_stream(_event_stream(spark, sf), profiles).select("row_id", "z", "maha")))


def _scored_stream(spark, sf, alpha=0.45):
    ev = _event_stream(spark, sf)
    s_if, p_rf = F.least(F.lit(1.0), F.col("byte_rate") / 200.0), F.col("burst_length") / 100.0
    typed = ev.withColumns({
        "s_if": s_if, "p_rf": p_rf, "hour": F.hour("ts"), "load": F.least(F.lit(1.0), F.col("byte_rate") / F.lit(100.0) / F.lit(4.9)),
        "attack_type": views.event_category(F.col("label"), F.col("byte_rate")), "device_type": alerts_type(F.col("device_id")),
    })
    return typed.withColumn("score", fusion.fuse(alpha=alpha))


def alerts_type(device):
    from telvane.functions.context import pseudo_device_type

    return pseudo_device_type(device)


@query("x03_alert_stream", Q.with_(Q.SCORES, _CX, body="""SELECT 'ALERT-' || substr(md5('alert:' || row_id), 1, 12) AS alert_id, device_id,
  level AS alert_level, attack_cat AS attack_type, device_type FROM cl WHERE level <> 'NONE'"""))
def _(spark, sf):
    out = alerts.run_to_table(alerts.alert_stream(_scored_stream(spark, sf)))
    return out.select("alert_id", "device_id", "alert_level", "attack_type", "context.device_type")


@query("x04_windowed_summary", Q.with_(Q.SCORES, _CX.replace(Q.fused(), Q.fused(0.4567)), "wn AS (SELECT *, date_trunc('hour', ts) AS window_start FROM cl WHERE level <> 'NONE')", body="""
SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS window_start, count(*) AS total_alerts, CAST(sum(CASE WHEN level = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS critical_count,
  CAST(sum(CASE WHEN level = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS warning_count, round(max(score), 4) AS max_score
FROM wn WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM wn) GROUP BY window_start"""))
def _(spark, sf):
    """Windows the watermark has closed; the newest ones stay open in the stream."""
    out = alerts.run_to_table(alerts.windowed_summary(alerts.alert_stream(_scored_stream(spark, sf, 0.4567))))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "total_alerts", "critical_count", "warning_count", "max_score")


@query("x05_duplicate_guard", "SELECT event_id FROM events")
def _(spark, sf):
    """Every event arrives twice; one copy passes."""
    twice = _event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return alerts.run_to_table(alerts.without_duplicates(twice, delay="40 days")).select("event_id")


@query("x06_saved_detector_stream")
def _(spark, sf):
    """A detector is trained by the main pipeline, saved, loaded, and raises alerts on arriving raw flow rows."""
    from telvane.plans import flows

    flow, path = views.flow_events(spark, sf), scratch_path(spark, "detector")
    flow.write.parquet(f"{path}/arriving")
    flows.main_pipeline(flows.prepare(flow)).detector.save(f"{path}/bundle")
    arriving = alerts.read_files(spark, f"{path}/arriving", flow.schema)
    out = alerts.run_to_table(flows.detect_stream(flows.Detector.load(spark, f"{path}/bundle"), arriving))
    return out.select("alert_id", "device_id", "fused_score", "threshold_used", "alert_level", "attack_type", "context.device_type")


_PUBLISHED = f"""hs AS (SELECT CAST(floor(least(1e0, greatest(0e0, {Q.fused()})) * 1000) AS INTEGER) AS bin, label FROM sc),
hg AS (SELECT b.bin, count(*) FILTER (WHERE label <> 1) AS normal, count(*) FILTER (WHERE label = 1) AS attacks
  FROM (SELECT unnest(range(1001)) AS bin) b LEFT JOIN hs ON hs.bin = b.bin GROUP BY b.bin),
hc AS (SELECT bin, sum(normal) OVER (ORDER BY bin) AS below, sum(normal) OVER () AS n0, sum(attacks) OVER () AS n1,
  sum(attacks) OVER (ORDER BY bin DESC) AS tp, sum(normal) OVER (ORDER BY bin DESC) AS fp FROM hg),
ht AS (SELECT least(0.9e0, greatest(0.1e0, (min(bin) + 1) / 1000e0)) AS tau FROM hc WHERE below >= ceil(n0 * 0.95e0)),
hb AS (SELECT bin / 1000e0 AS best_threshold, 2e0 * tp / (n1 + tp + fp) AS best_f1, CAST(n0 + n1 AS BIGINT) AS n, CAST(n0 AS BIGINT) AS n_normal
  FROM hc WHERE bin BETWEEN 1 AND 999 ORDER BY best_f1 DESC, bin LIMIT 1)"""


def _published(spark, sf):
    path = scratch_path(spark, "thresholds")
    calibration.publish_thresholds(_scored_stream(spark, sf), f"{path}/versions", f"{path}/checkpoint").awaitTermination()
    return f"{path}/versions"


@query("x07_stream_calibration", Q.with_(Q.SCORES, _PUBLISHED, body="SELECT round(tau, 8) AS tau, round(best_threshold, 8) AS best_threshold, round(best_f1, 8) AS best_f1, n, n_normal FROM ht, hb"))
def _(spark, sf):
    """The last version published by a stream of labelled scores."""
    return rounded(calibration.latest(spark, _published(spark, sf)).drop("version"), 8)


@query("x08_alerts_with_published_tau", Q.with_(Q.SCORES, _PUBLISHED, _CX.replace(Q.tau("load", "risk", "hour", "0.5e0"), Q.tau("load", "risk", "hour", "(SELECT tau FROM ht)")), body="""
SELECT 'ALERT-' || substr(md5('alert:' || row_id), 1, 12) AS alert_id, device_id, level AS alert_level, attack_cat AS attack_type FROM cl WHERE level <> 'NONE'"""))
def _(spark, sf):
    """Alerts of an arriving stream by the threshold that another stream has published."""
    versions, path = _published(spark, sf), scratch_path(spark, "published")
    calibration.alert_with_published(_scored_stream(spark, sf), versions, path, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/alerts").select("alert_id", "device_id", "alert_level", "attack_type")
