"""Queries: context-adaptive thresholds and alerts, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from telvane.functions import context, fusion
from telvane.operators import alerts as A
from telvane.operators import search as S
from telvane.plans import flows
from telvane.plans import sql as Q
from telvane.plans import views
from telvane.plans.catalog import query, rounded
from telvane.plans.queries_fusion import _FV, _VAL, SMALL_FPR, grid
from telvane.plans.queries_prep import _wave, robust
from telvane.plans.queries_profile import stats
from telvane.schema import DEVICE_RISK_ONLINE, FEATURES, MODEL_FEATURES, SUITE

LOAD = "least(1e0, z / 4.9e0)"


def _scores(spark, sf):
    sc = views.scores_events(spark, sf)
    return A.with_device_context(sc).withColumns({"score": fusion.fuse(), "load": F.least(F.lit(1.0), F.col("z") / F.lit(4.9)), "attack_type": F.col("attack_cat")})


_CX = f"""cx AS (SELECT *, {Q.fused()} AS score, {LOAD} AS load, {Q.pseudo_type('device_id')} AS device_type FROM sc),
cr AS (SELECT cx.*, rk.risk FROM cx JOIN {Q.risk_table()} ON rk.kind = cx.device_type),
ct AS (SELECT *, {Q.tau('load', 'risk', 'hour', '0.5e0')} AS tau FROM cr),
cl AS (SELECT *, CASE WHEN score < tau THEN 'NONE' WHEN score < tau + 0.15e0 THEN 'WARNING' ELSE 'CRITICAL' END AS level FROM ct)"""


@query("a01_adaptive_tau", Q.with_(Q.SCORES, _CX, body="SELECT row_id, round(tau, 8) AS tau FROM ct"))
def _(spark, sf):
    risk = context.device_risk("device_type")
    return rounded(_scores(spark, sf).select("row_id", context.adaptive_tau("load", risk, "hour").alias("tau")), 8)


@query("a01_adaptive_tau_suite", Q.with_(Q.SCORES, _CX, body=f"""SELECT row_id, round({Q.tau('load', Q.pseudo_risk('device_type'), 'hour', '0.02e0', (0.2, 0.15, 0.15), 0.01, 0.99)}, 8) AS tau FROM cx"""))
def _(spark, sf):
    tau = context.adaptive_tau("load", "risk", "hour", SUITE, 0.02, (0.2, 0.15, 0.15))
    return rounded(_scores(spark, sf).select("row_id", tau.alias("tau")), 8)


@query("a02_activity_factor", Q.with_(Q.SCORES, body=f"SELECT hour, round({Q.activity('hour')}, 8) AS factor, count(*) AS n FROM sc GROUP BY hour"))
def _(spark, sf):
    return rounded(views.scores_events(spark, sf).groupBy("hour").agg(F.count(F.lit(1)).alias("n")).withColumn("factor", context.activity_factor("hour")), 8)


@query("a03_device_risk", f"""SELECT l_linenumber, l_orderkey, l_shipdate, coalesce(risk, 0.5e0) AS risk FROM (
  SELECT *, ['Sensor', 'GATEWAY', 'controller', 'Camera', 'actuator', 'toaster', 'unknown'][l_linenumber] AS kind_ FROM lineitem) l
  LEFT JOIN {Q.risk_table()} ON rk.kind = lower(kind_)""")
def _(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("Sensor", "GATEWAY", "controller", "Camera", "actuator", "toaster", "unknown")])
    li = views.table(spark, sf, "lineitem")
    return li.select("l_linenumber", "l_orderkey", "l_shipdate", context.device_risk(F.element_at(kinds, F.col("l_linenumber"))).alias("risk"))


@query("a04_alert_level", Q.with_(Q.SCORES, _CX, body="SELECT row_id, level AS alert_level FROM cl"))
def _(spark, sf):
    tau = context.adaptive_tau("load", context.device_risk("device_type"), "hour")
    return _scores(spark, sf).select("row_id", context.alert_level("score", tau).alias("alert_level"))


@query("a05_alert_records", Q.with_(Q.SCORES, _CX, body=f"""SELECT 'ALERT-' || substr(md5('alert:' || row_id), 1, 12) AS alert_id, device_id,
  round(score, 8) AS fused_score, round(tau, 8) AS threshold_used, level AS alert_level, attack_cat AS attack_type, round(s_if, 8) AS s_if_score, p_rf AS p_rf_score,
  round(load, 3) AS network_load, risk AS device_risk, round({Q.activity('hour')}, 3) AS time_factor, hour, device_type FROM cl"""))
def _(spark, sf):
    return rounded(A.build_alerts(_scores(spark, sf)).drop("timestamp").select("*", "context.*").drop("context"), 8)


@query("a06_alert_numbers", Q.with_(Q.SCORES, _CX, body="""SELECT format('ALERT-{:06d}', row_number() OVER (ORDER BY ts, device_id)) AS alert_id, device_id, round(score, 8) AS fused_score FROM
  (SELECT * FROM cl WHERE level = 'CRITICAL' ORDER BY ts, device_id LIMIT 100)"""))
def _(spark, sf):
    critical = A.build_alerts(_scores(spark, sf)).filter("alert_level = 'CRITICAL'")
    return rounded(A.number_alerts(critical, ["timestamp", "device_id"], 100).select("alert_id", "device_id", "fused_score"), 8)


@query("a07_calibrated_tau", Q.with_(Q.SCORES, _VAL, _FV, body=f"SELECT round({Q.clip('quantile_cont(score, 0.95)', 0.1, 0.9)}, 8) AS tau_base FROM fv WHERE label = 0"))
def _(spark, sf):
    tau = A.calibrate_tau(_scores(spark, sf).filter("split = 'val'"))
    return rounded(spark.range(1).select(F.lit(tau).alias("tau_base")), 8)


@query("a08_alert_summary", Q.with_(Q.SCORES, _CX, body="""SELECT device_type, count(*) AS total_alerts, CAST(sum(CASE WHEN level = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS critical_count,
  CAST(sum(CASE WHEN level = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS warning_count, round(avg(score), 4) AS mean_score, round(max(score), 4) AS max_score
  FROM cl WHERE level <> 'NONE' GROUP BY device_type"""))
def _(spark, sf):
    alerts = A.build_alerts(_scores(spark, sf)).withColumn("device_type", F.col("context.device_type"))
    return A.alert_summary(alerts, ["device_type"])


@query("a08_attack_distribution", Q.with_(Q.SCORES, _CX, body="SELECT attack_cat AS attack_type, count(*) AS n FROM cl WHERE level <> 'NONE' GROUP BY attack_cat"))
def _(spark, sf):
    return A.attack_distribution(A.build_alerts(_scores(spark, sf)))


@query("a09_pseudo_device_type", Q.with_(Q.SCORES, _CX, body=f"SELECT device_id, device_type, {Q.pseudo_risk('device_type')} AS risk, count(*) AS n FROM cx GROUP BY device_id, device_type"))
def _(spark, sf):
    return _scores(spark, sf).groupBy("device_id", "device_type", "risk").agg(F.count(F.lit(1)).alias("n"))


_P95 = "pz AS (SELECT quantile_cont(z, 0.95) AS p95 FROM vl)"
_LOAD95 = Q.clip("z / greatest(p95, 1e-8)", 0.0, 1.0)


@query("a10_load_proxy", Q.with_(Q.SCORES, _VAL, _P95, body=f"SELECT row_id, round({_LOAD95}, 8) AS load FROM sc, pz"))
def _(spark, sf):
    sc = views.scores_events(spark, sf)
    return rounded(A.with_load(sc, sc.filter("split = 'val'")).select("row_id", "load"), 8)


BASE_TAU = f"{grid(100, 99, 'fv')}, bt AS (SELECT threshold AS tau0 FROM gc ORDER BY {SMALL_FPR} DESC, i LIMIT 1)"
BETAS = "bg(i, b1, b2, b3) AS (VALUES " + ", ".join(
    f"({i}, {Q.d(a)}, {Q.d(b)}, {Q.d(c)})"
    for i, (a, b, c) in enumerate((a, b, c) for a in S.BETA_LOAD for b in S.BETA_RISK for c in S.BETA_TIME)
) + ")"
SUITE_CONTEXT = f"""cv AS (SELECT sc.*, {Q.fused()} AS score, {_LOAD95} AS load, {Q.pseudo_type('device_id')} AS device_type, {Q.pseudo_risk(Q.pseudo_type('device_id'))} AS risk, tau0 FROM sc, pz, bt)"""


def suite_tau(b1: str, b2: str, b3: str) -> str:
    return Q.clip(f"tau0 + {b1} * load - {b2} * risk - {b3} * (1e0 - {Q.activity('hour')})", 0.01, 0.99)


BETA_COUNTS = f"bc AS (SELECT i, b1, b2, b3, {Q.counts('score >= ' + suite_tau('b1', 'b2', 'b3'))} FROM cv, bg WHERE split = 'val' GROUP BY i, b1, b2, b3)"
LOSS = f"((1e0 - {Q.F1}) + 0.25e0 * {Q.FPR})"
BETA_CTES = [Q.SCORES, _VAL, _FV, BASE_TAU, _P95, SUITE_CONTEXT, BETAS, BETA_COUNTS]


def adaptive_inputs(spark, sf):
    """Scores with load, risk and device type, and the static threshold from the validation split."""
    sc = A.with_device_context(views.scores_events(spark, sf).withColumn("score", fusion.fuse()))
    sc = A.with_load(sc, sc.filter("split = 'val'"))
    return sc, S.best_threshold_value(sc.filter("split = 'val'"))


@query("a11_beta_search", Q.with_(*BETA_CTES, body=f"""SELECT b1 AS beta1, b2 AS beta2, b3 AS beta3, round({Q.F1}, 4) AS validation_f1, round({Q.FPR}, 4) AS validation_fpr,
  round({LOSS}, 4) AS validation_loss, row_number() OVER (ORDER BY {LOSS}, i) = 1 AS is_best FROM bc"""))
def _(spark, sf):
    sc, tau0 = adaptive_inputs(spark, sf)
    return S.beta_search(sc.filter("split = 'val'"), tau0)


@query("a12_predicted_attack_type", Q.with_(Q.SCORES, body="SELECT row_id, CASE WHEN p_rf >= 0.35e0 THEN 'Attack' ELSE 'Normal' END AS attack_type FROM sc"))
def _(spark, sf):
    return views.scores_events(spark, sf).select("row_id", A.predicted_attack_type("p_rf", 0.35).alias("attack_type"))


# ---- flagship: the whole scoring path in one query ----

_PLAIN = [f for f in MODEL_FEATURES if f in FEATURES]
_CYCLES = ", ".join(f"{_wave(fn, c, p)} AS {n}_{fn}" for c, n, p in (("time_of_day", "time", 24), ("day_of_week", "day", 7)) for fn in ("sin", "cos"))
_MED = ", ".join(f"quantile_cont({f}, 0.5) AS q_{f}" for f in _PLAIN)
_FILLED = ", ".join(f"coalesce({f}, q_{f}, 0e0) AS {f}" for f in _PLAIN)
_M = MODEL_FEATURES
_ZS = "(" + " + ".join(f"abs((sp.{f} - coalesce(pd.m_{f}, pg.m_{f})) / coalesce(pd.s_{f}, pg.s_{f}))" for f in _M) + f") / {len(_M)}e0"
FLAGSHIP = Q.with_(
    Q.FLOW, f"q AS (SELECT {_MED} FROM fl)",
    f"""fp AS (SELECT row_id, ts, device_id, label, attack_cat, time_of_day AS hour, {Q.split('row_id')} AS split, {_FILLED}, {_CYCLES} FROM fl, q)""",
    robust("fp", _M, "split = 'train'"),
    "sp AS (SELECT row_id, ts, device_id, label, attack_cat, hour, split, " + ", ".join(f"({f} - c_{f}) / s_{f} AS {f}" for f in _M) + " FROM fp, rs)",
    """tl AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, row_id DESC) - 1 AS r FROM sp WHERE label = 0 AND split = 'train')""",
    "tw AS (SELECT *, count(*) OVER (PARTITION BY device_id) AS n FROM tl WHERE r < 100)",
    "gl AS (SELECT *, row_number() OVER (ORDER BY ts DESC, row_id DESC) - 1 AS r FROM sp WHERE label = 0 AND split = 'train')",
    "gw AS (SELECT *, count(*) OVER () AS n FROM gl WHERE r < 100)",
    f"pd AS (SELECT device_id, {stats(_M)} FROM tw GROUP BY device_id HAVING count(*) >= 50)",
    f"pg AS (SELECT {stats(_M)} FROM gw)",
    f"zs AS (SELECT sp.row_id, sp.device_id, sp.label, sp.attack_cat, sp.hour, sp.split, {_ZS} AS z FROM sp LEFT JOIN pd ON sp.device_id = pd.device_id CROSS JOIN pg)",
    "vz AS (SELECT quantile_cont(z, 0.95) AS p95 FROM zs WHERE split = 'val')",
    f"ld AS (SELECT *, {Q.clip('z / greatest(p95, 1e-8)', 0.0, 1.0)} AS score, {Q.pseudo_type('device_id')} AS device_type FROM zs, vz)",
    f"tb AS (SELECT {Q.clip('quantile_cont(score, 0.95)', 0.1, 0.9)} AS tau0 FROM ld WHERE split = 'val' AND label = 0)",
    f"al AS (SELECT ld.*, {Q.tau('score', 'rk.risk', 'hour', 'tau0')} AS tau FROM ld JOIN {Q.risk_table(DEVICE_RISK_ONLINE)} ON rk.kind = ld.device_type, tb WHERE split = 'test')",
    "lv AS (SELECT *, CASE WHEN score < tau THEN 'NONE' WHEN score < tau + 0.15e0 THEN 'WARNING' ELSE 'CRITICAL' END AS level FROM al)",
    body="""SELECT device_type, count(*) AS total_alerts, CAST(sum(CASE WHEN level = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS critical_count,
  CAST(sum(CASE WHEN level = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS warning_count, round(avg(score), 4) AS mean_score, round(max(score), 4) AS max_score
  FROM lv WHERE level <> 'NONE' GROUP BY device_type""",
)


@query("flagship_alert_summary", FLAGSHIP)
def _(spark, sf):
    return flows.profile_alert_summary(views.flow_events(spark, sf))


