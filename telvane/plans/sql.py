"""ANSI SQL forms of the views, shared by the oracle queries."""

from __future__ import annotations

from telvane.operators import vocab as V
from telvane.schema import DEVICE_RISK_ONLINE, DEVICE_RISK_SUITE
from telvane.plans.views import ATTACK_SPELLINGS

KINDS = {"P1": "click", "P2": "view", "P3": "purchase", "P4": "signup"}


def d(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def md5_uniform(expr: str) -> str:
    return f"(CAST('0x' || substr(md5({expr}), 1, 8) AS BIGINT) / 4294967296e0)"


def md5_mod(expr: str, m: int) -> str:
    return f"(CAST('0x' || substr(md5({expr}), 1, 8) AS BIGINT) % {m})"


def clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {d(low)}), {d(high)})"


def ratio(n: str, m: str) -> str:
    return f"coalesce(CAST({n} AS DOUBLE) / nullif(CAST({m} AS DOUBLE), 0e0), 0e0)"


def split(expr: str) -> str:
    u = md5_uniform(f"'42:' || {expr}")
    return f"CASE WHEN {u} < 0.7e0 THEN 'train' WHEN {u} < 0.8e0 THEN 'val' ELSE 'test' END"


EV = """ev AS (SELECT event_id, ts, user_id, event_type, value,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, epoch_us(ts) AS us,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events)"""

CAT = "CASE WHEN label = 0 THEN 'Normal' WHEN value >= 50 THEN 'HighValue' ELSE 'LowValue' END"

FLOW = EV + f""", fw AS (SELECT *,
  greatest(1e0, coalesce((us - lag(us) OVER w) / 1e6, 1e0)) AS iat,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS roll30,
  coalesce(abs(value - lag(value) OVER w), 0e0) AS jump,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m100,
  stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS s100,
  min(us) OVER (PARTITION BY user_id) AS start_us
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
fl AS (SELECT 1e0 / iat AS packet_rate, value AS byte_rate, CAST(k AS DOUBLE) AS burst_length, iat AS inter_arrival_time,
  roll30 AS conn_frequency, CAST(k % 7 AS DOUBLE) AS unique_dst_ips, k / 100e0 AS port_diversity,
  CAST(k % 3 AS DOUBLE) AS protocol_distribution, jump AS response_time,
  ((us - start_us) % 3600000000) / 1e6 AS session_duration, m100 AS payload_size_mean, s100 AS payload_size_std,
  CAST(hour(ts) AS DOUBLE) AS time_of_day, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, label,
  {CAT} AS attack_cat, format('device_{{:03d}}', user_id) AS device_id, 'events' AS source_dataset,
  CAST(event_id AS VARCHAR) AS row_id, ts FROM fw)"""

LINE_KEY = " || '|' || ".join(
    f"CAST({c} AS VARCHAR)"
    for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
)
LINE = f"""li AS (SELECT l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  CASE WHEN l_returnflag = 'R' THEN 'Returned_' || l_linestatus ELSE 'Normal' END AS attack_cat,
  format('device_{{:03d}}', l_suppkey) AS device_id, 'lineitem' AS source_dataset,
  md5({LINE_KEY}) AS row_id, l_shipdate AS ts FROM lineitem)"""

SCORES = EV + f""", sc AS (SELECT CAST(event_id AS VARCHAR) AS row_id, ts, {split("CAST(event_id AS VARCHAR)")} AS split, label,
  {CAT} AS attack_cat, format('device_{{:03d}}', user_id) AS device_id, CAST(hour(ts) AS INTEGER) AS hour,
  least(1e0, value / 200e0) AS s_if, k / 100e0 AS p_rf, value / 100e0 AS z, k / 25e0 AS maha FROM ev)"""

TELEMETRY = EV + """, te AS (SELECT date_trunc('hour', ts) AS time,
  """ + ", ".join(f"avg(CASE WHEN event_type = '{t}' THEN value END) AS {p}_value" for p, t in KINDS.items()) + """,
  """ + ", ".join(f"avg(CASE WHEN event_type = '{t}' THEN k END) AS {p}_k" for p, t in KINDS.items()) + """,
  max(CASE WHEN event_type = 'error' AND value >= 150 THEN 1 ELSE 0 END) AS attack,
  """ + ", ".join(f"max(CASE WHEN event_type = 'error' AND value >= 150 AND k % 3 = {i} THEN 1 ELSE 0 END) AS attack_P{i + 1}" for i in range(3)) + """,
  strftime(date_trunc('hour', ts), '%Y-%m-%d') AS source_file, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS row_id
  FROM ev GROUP BY ALL HAVING true)"""
TELEMETRY = TELEMETRY.replace("GROUP BY ALL HAVING true", "GROUP BY date_trunc('hour', ts)")

SIGNALS = [f"{p}_{s}" for s in ("value", "k") for p in KINDS]


def signals_ctes() -> str:
    """Imputed signals ``tv``, differences ``td``, thresholds ``tq``, joined rows ``tt``."""
    med = ", ".join(f"quantile_cont({s}, 0.5) AS {s}" for s in SIGNALS)
    fill = ", ".join(f"coalesce(te.{s}, md.{s}, 0e0) AS {s}" for s in SIGNALS)
    diff = ", ".join(f"coalesce(abs({s} - lag({s}) OVER w), 0e0) AS d__{s}" for s in SIGNALS)
    q = ", ".join(f"CASE WHEN quantile_cont(d__{s}, 0.75) = 0 THEN 1e-9 ELSE quantile_cont(d__{s}, 0.75) END AS t__{s}" for s in SIGNALS)
    over = " + ".join(f"CASE WHEN d__{s} > t__{s} THEN 1e0 ELSE 0e0 END" for s in SIGNALS)
    groups = ", ".join(f"(d__{p}_value + d__{p}_k) / 2e0 AS g_{p}" for p in KINDS)
    n = len(SIGNALS)
    mean = "(" + " + ".join(SIGNALS) + f") / {n}e0"
    return TELEMETRY + f""", md AS (SELECT source_file, {med} FROM te GROUP BY source_file),
tv AS (SELECT te.time, te.row_id, te.source_file, te.attack, te.attack_P1, te.attack_P2, te.attack_P3, {fill}
  FROM te JOIN md ON te.source_file = md.source_file),
td AS (SELECT *, {diff}, greatest(1e0, coalesce((epoch_us(time) - lag(epoch_us(time)) OVER w) / 1e6, 1e0)) AS elapsed,
  {mean} AS row_mean, min(time) OVER (PARTITION BY source_file) AS start_time
  FROM tv WINDOW w AS (PARTITION BY source_file ORDER BY time, row_id)),
tq AS (SELECT source_file, {q} FROM td GROUP BY source_file),
tt AS (SELECT td.*, tq.* EXCLUDE (source_file), {over} AS changes, {groups},
  (""" + " + ".join(f"abs({s})" for s in SIGNALS) + """) AS abs_sum,
  sqrt((""" + " + ".join(f"({s} - row_mean) * ({s} - row_mean)" for s in SIGNALS) + f""") / {n - 1}e0) AS row_std,
  (""" + " + ".join(f"d__{s}" for s in SIGNALS) + f""") / {n}e0 AS diff_mean
  FROM td JOIN tq ON td.source_file = tq.source_file)"""


TAXONOMY = "tx(name, cat, lab) AS (VALUES " + ", ".join(
    f"('{n}', '{c}', {0 if n == 'normal' else 1})" for n, c in V.KDD_TAXONOMY.items()
) + ")"

_names = "[" + ", ".join(f"'{n}'" for n in ATTACK_SPELLINGS) + "]"
_name = f"{_names}[CAST(event_id % {len(ATTACK_SPELLINGS)} + 1 AS INTEGER)]"
KDD = EV + f""", kd AS (SELECT CAST(event_id AS VARCHAR) AS row_id, value AS duration, k * 10e0 AS src_bytes, value * 2 AS dst_bytes,
  CAST(k AS DOUBLE) AS count, CAST(k % 7 AS DOUBLE) AS srv_count, CAST(user_id AS DOUBLE) AS dst_host_count,
  CAST(user_id % 50 AS DOUBLE) AS dst_host_srv_count, k / 100e0 AS same_srv_rate, 1e0 - k / 100e0 AS diff_srv_rate,
  value / 1000e0 AS serror_rate, value / 500e0 AS rerror_rate, value / 250e0 AS srv_serror_rate,
  ['tcp', 'UDP', 'icmp', 'gre'][k % 4 + 1] AS protocol_type,
  CASE WHEN k % 5 = 0 THEN ' ' || upper({_name}) ELSE {_name} END AS attack_type FROM ev)"""


def risk_table(table: dict[str, float] = DEVICE_RISK_ONLINE) -> str:
    return "(VALUES " + ", ".join(f"('{n}', {d(v)})" for n, v in table.items()) + ") AS rk(kind, risk)"


def pseudo_type(device: str) -> str:
    names = "[" + ", ".join(f"'{n}'" for n in DEVICE_RISK_SUITE) + "]"
    return f"{names}[{md5_mod(f'''{repr('42:')} || {device}''', len(DEVICE_RISK_SUITE))} + 1]"


def pseudo_risk(kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {kind} = '{n}' THEN {d(v)}" for n, v in DEVICE_RISK_SUITE.items()) + " ELSE 0.5e0 END"


def activity(hour: str) -> str:
    return clip(f"0.5e0 * (1e0 + cos(pi() * ({hour} - 12) / 12e0))", 0.0, 1.0)


def tau(load: str, risk: str, hour: str, base: str, b=(0.05, 0.025, 0.025), low=0.1, high=0.9) -> str:
    return clip(f"{base} + {d(b[0])} * {load} - {d(b[1])} * {risk} - {d(b[2])} * (1e0 - {activity(hour)})", low, high)


def fused(alpha: str | float = 0.45) -> str:
    if isinstance(alpha, float):
        return f"({d(alpha)} * s_if + (1e0 - {d(alpha)}) * p_rf)"
    return f"({alpha} * s_if + (1e0 - {alpha}) * p_rf)"


F1 = ratio("2 * tp", "2 * tp + fp + fn")
PRECISION = ratio("tp", "tp + fp")
RECALL = ratio("tp", "tp + fn")
FPR = ratio("fp", "fp + tn")
FNR = ratio("fn", "fn + tp")


def counts(flag: str, label: str = "label") -> str:
    s = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
    return (f"{s(f'{label} = 1 AND {flag}')} AS tp, {s(f'{label} <> 1 AND {flag}')} AS fp, "
            f"{s(f'{label} <> 1 AND NOT ({flag})')} AS tn, {s(f'{label} = 1 AND NOT ({flag})')} AS fn")


def ranking(source: str, keys: str = "", score: str = "score", out: str = "rk") -> str:
    """CTEs computing AUC and AP per slice of ``source``(keys, label, score)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{out}_g AS (SELECT {k}{score} AS score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg
  FROM {source} GROUP BY {k}{score}),
{out}_c AS (SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) AS ctp, sum(neg) OVER ({part}ORDER BY score DESC) AS cfp FROM {out}_g),
{out} AS (SELECT {k}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(neg * (ctp - pos) + 0.5 * neg * pos) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) ELSE 0e0 END AS auc,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(CAST(pos AS DOUBLE) * ctp / (ctp + cfp)) / sum(pos) ELSE 0e0 END AS ap FROM {out}_c {group})"""


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
