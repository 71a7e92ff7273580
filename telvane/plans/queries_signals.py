"""Queries: ordered-signal features of process telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from telvane.operators import signals as S
from telvane.operators.harmonise import append_all
from telvane.operators.series import with_series_columns
from telvane.plans import sql as Q
from telvane.plans import views
from telvane.plans.catalog import query, r, rounded
from telvane.schema import FEATURES

SIGNALS = Q.SIGNALS
ORDER = ["time", "row_id"]
FILE = "source_file"
_SIG = Q.signals_ctes()


def _values(spark, sf):
    return S.clean_signals(views.telemetry_events(spark, sf), FILE, SIGNALS)


def _diffs(spark, sf):
    return with_series_columns(
        _values(spark, sf), FILE, ORDER, 1, lambda w: {**S.abs_differences(w, SIGNALS), "elapsed": S.elapsed_seconds(w)}
    )


def _changes(spark, sf):
    diffs = _diffs(spark, sf)
    return diffs.join(S.change_thresholds(diffs, FILE, SIGNALS), FILE).withColumn("changes", S.change_count(SIGNALS))


@query("t01_abs_difference", Q.with_(_SIG, body=f"SELECT row_id, {r(*[f'd__{s}' for s in SIGNALS])} FROM td"))
def _(spark, sf):
    return rounded(_diffs(spark, sf).select("row_id", *[S.diff_name(s) for s in SIGNALS]))


@query("t02_elapsed_seconds", Q.with_(_SIG, body=f"SELECT row_id, {r('elapsed')} FROM td"))
def _(spark, sf):
    return rounded(_diffs(spark, sf).select("row_id", "elapsed"))


@query("t03_change_threshold", Q.with_(_SIG, body=f"SELECT source_file, {r(*[f't__{s}' for s in SIGNALS])} FROM tq"))
def _(spark, sf):
    return rounded(S.change_thresholds(_diffs(spark, sf), FILE, SIGNALS))


@query("t04_change_count", Q.with_(_SIG, body="""
SELECT row_id, changes, round(changes / elapsed, 9) AS packet_rate, changes / 8e0 AS port_diversity FROM tt"""))
def _(spark, sf):
    return _changes(spark, sf).select("row_id", "changes", F.round(F.col("changes") / F.col("elapsed"), 9).alias("packet_rate"),
                                      (F.col("changes") / F.lit(float(len(SIGNALS)))).alias("port_diversity"))


@query("t05_rolling_mean", Q.with_(_SIG, body="""SELECT row_id, round(avg(changes) OVER (PARTITION BY source_file ORDER BY time, row_id
  ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS conn_frequency FROM tt"""))
def _(spark, sf):
    rolled = with_series_columns(_changes(spark, sf), FILE, ORDER, S.LOOK_BACK,
                                 lambda w: {"conn_frequency": F.avg("changes").over(w.rowsBetween(-S.LOOK_BACK, 0))})
    return rounded(rolled.select("row_id", "conn_frequency"))


@query("t06_row_statistics", Q.with_(_SIG, body=f"SELECT row_id, {r('abs_sum', 'row_mean', 'row_std', 'diff_mean', digits=9)} FROM tt"))
def _(spark, sf):
    return rounded(_diffs(spark, sf).select(
        "row_id", S.row_abs_sum(SIGNALS).alias("abs_sum"), S.row_mean(SIGNALS).alias("row_mean"), S.row_std(SIGNALS).alias("row_std"),
        S.row_mean([S.diff_name(s) for s in SIGNALS]).alias("diff_mean"),
    ), 9)


@query("t07_group_change", Q.with_(_SIG, body=f"SELECT row_id, {r('g_P1', 'g_P2', 'g_P3', 'g_P4')} FROM tt"))
def _(spark, sf):
    return rounded(_diffs(spark, sf).select("row_id", *[c.alias(f"g_{g}") for g, c in S.group_changes(SIGNALS).items()]))


_ACTIVE = " + ".join(f"CASE WHEN g_{g} > 0 THEN 1 ELSE 0 END" for g in S.GROUPS)
_MAX = "greatest(" + ", ".join(f"g_{g}" for g in S.GROUPS) + ")"
_ARGMAX = "CASE " + " ".join(f"WHEN g_{g} = {_MAX} THEN {i + 1}" for i, g in enumerate(S.GROUPS)) + " END"


@query("t08_active_groups", Q.with_(_SIG, body=f"SELECT row_id, {_ACTIVE} AS active FROM tt"))
def _(spark, sf):
    groups = S.group_changes(SIGNALS).values()
    return _diffs(spark, sf).select("row_id", sum((F.when(c > 0, 1).otherwise(0) for c in groups), F.lit(0)).alias("active"))


@query("t09_dominant_group", Q.with_(_SIG, body=f"SELECT row_id, {_ARGMAX} AS dominant FROM tt"))
def _(spark, sf):
    return _diffs(spark, sf).select("row_id", S.dominant_index(F.array(*S.group_changes(SIGNALS).values())).alias("dominant"))


@query("t10_dominant_device", Q.with_(_SIG, body=f"SELECT 'P' || {_ARGMAX} || '_controller' AS device_id, count(*) AS n FROM tt GROUP BY 1"))
def _(spark, sf):
    flow = S.harmonise_telemetry(views.telemetry_events(spark, sf))
    return flow.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))


_SESSION = "((epoch_us(time) - epoch_us(start_time)) % 3600000000) / 1e6"


@query("t11_session_duration", Q.with_(Q.FLOW, body=f"SELECT row_id, {r('session_duration')} FROM fl"))
def _(spark, sf):
    return rounded(views.flow_events(spark, sf).select("row_id", "session_duration"))


@query("t12_calendar_parts", Q.with_(Q.TELEMETRY, body="SELECT row_id, hour(time) AS hour, isodow(time) - 1 AS weekday FROM te"))
def _(spark, sf):
    return views.telemetry_events(spark, sf).select("row_id", F.hour("time").cast("long").alias("hour"), F.weekday("time").cast("long").alias("weekday"))


_UNIFIED = {
    "packet_rate": "changes / elapsed", "byte_rate": "abs_sum", "burst_length": "row_std", "inter_arrival_time": "elapsed",
    "conn_frequency": "avg(changes) OVER (PARTITION BY source_file ORDER BY time, row_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)",
    "unique_dst_ips": f"CAST({_ACTIVE} AS DOUBLE)", "port_diversity": "changes / 8e0", "protocol_distribution": f"CAST({_ARGMAX} AS DOUBLE)",
    "response_time": "diff_mean", "session_duration": _SESSION, "payload_size_mean": "row_mean", "payload_size_std": "row_std",
    "time_of_day": "CAST(hour(time) AS DOUBLE)", "day_of_week": "CAST(isodow(time) - 1 AS DOUBLE)",
}


@query("t13_telemetry_to_flow", Q.with_(_SIG, body=f"""SELECT row_id, {', '.join(f'round({e}, 9) AS {f}' for f, e in _UNIFIED.items())},
  attack AS label, 'P' || {_ARGMAX} || '_controller' AS device_id, 'HAI-20.07' AS source_dataset FROM tt"""))
def _(spark, sf):
    flow = S.harmonise_telemetry(views.telemetry_events(spark, sf))
    return rounded(flow.select("row_id", *FEATURES, "label", "device_id", "source_dataset"), 9)


@query("t13_files_together", Q.with_(_SIG, body="""SELECT source_dataset, count(*) AS n, CAST(sum(label) AS BIGINT) AS attacks FROM
  (SELECT 'HAI-20.07' AS source_dataset, attack AS label FROM tt UNION ALL SELECT 'events', label FROM ev) GROUP BY source_dataset"""))
def _(spark, sf):
    both = append_all([S.harmonise_telemetry(views.telemetry_events(spark, sf)), views.flow_events(spark, sf)])
    return both.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("attacks"))
