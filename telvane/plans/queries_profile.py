"""Queries: behavioural profiles."""

from __future__ import annotations


from pyspark.sql import functions as F

from telvane.operators import online_profile as O
from telvane.operators import profile as P
from telvane.plans import sql as Q
from telvane.plans import views
from telvane.plans.catalog import query, r, rounded
from telvane.schema import GLOBAL_PROFILE, ProfilePreset
from telvane.session import scratch_path

_LINE = views.LINE_FEATURES
_PAIR = ["quantity", "discount"]
_EVENT_PAIR = ["byte_rate", "burst_length"]

TAIL = """tl AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, row_id DESC) - 1 AS r FROM li WHERE label = 0),
tw AS (SELECT *, count(*) OVER (PARTITION BY device_id) AS n FROM tl WHERE r < 100)"""
OVERALL = """gl AS (SELECT *, '__GLOBAL__' AS dev, row_number() OVER (ORDER BY ts DESC, row_id DESC) - 1 AS r FROM li WHERE label = 0),
gw AS (SELECT *, count(*) OVER () AS n FROM gl WHERE r < 100)"""


def ewma(f: str, alpha: str = "0.1e0") -> str:
    """SQL aggregate of the EWMA seeded by the oldest of n rows, r = 0 newest."""
    return f"sum((CASE WHEN r = n - 1 THEN pow(1e0 - {alpha}, n - 1) ELSE {alpha} * pow(1e0 - {alpha}, r) END) * {f})"


def stats(features: list[str], alpha: str = "0.1e0") -> str:
    return ", ".join(f"{ewma(f, alpha)} AS m_{f}, stddev_pop({f}) + 1e-8 AS s_{f}" for f in features)


def cov(a: str, b: str, ridge: float = 1e-5) -> str:
    extra = f" + {Q.d(ridge)}" if a == b else ""
    return f"covar_samp({a}, {b}){extra}"


_PROFILE = Q.with_(Q.LINE, TAIL, f"pr AS (SELECT device_id, count(*) AS n, {stats(_LINE)} FROM tw GROUP BY device_id HAVING count(*) >= 50)", body="")


def _line_profiles(spark, sf, mode="zscore", features=_LINE, **kw):
    return P.FrozenProfiles.fit(views.flow_lineitem(spark, sf), features, mode=mode, **kw)


def _flat(profiles, features=_LINE):
    cells = [c for i, f in enumerate(features) for c in (F.col("mean")[i].alias(f"m_{f}"), F.col("std")[i].alias(f"s_{f}"))]
    return profiles.select("device_id", "n", *cells)


@query("b01_profile_window", Q.with_(Q.LINE, TAIL, body="""SELECT device_id, count(*) AS n, round(sum(quantity), 4) AS quantity,
  strftime(min(ts), '%Y-%m-%d') AS oldest FROM tw GROUP BY device_id HAVING count(*) >= 50"""))
def _(spark, sf):
    tail = P.normal_tail(views.flow_lineitem(spark, sf), _LINE, 100)
    return tail.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"),
                                         F.date_format(F.min("ts"), "yyyy-MM-dd").alias("oldest")).filter("n >= 50")


@query("b02_ewma_mean", _PROFILE + f"SELECT device_id, {r(*[f'm_{f}' for f in _LINE])} FROM pr")
def _(spark, sf):
    return rounded(_flat(_line_profiles(spark, sf).table).select("device_id", *[f"m_{f}" for f in _LINE]))


_MOMENTS = f"{r('s_quantity', 's_discount')}, round(c_qq, 6) AS c_qq, round(c_qd, 6) AS c_qd, round(c_dd, 6) AS c_dd"


@query("b03_profile_moments", Q.with_(Q.LINE, TAIL, f"""pr AS (SELECT device_id, {stats(_PAIR)}, {cov('quantity', 'quantity')} AS c_qq,
  {cov('quantity', 'discount')} AS c_qd, {cov('discount', 'discount')} AS c_dd FROM tw GROUP BY device_id)""", body=f"SELECT device_id, {_MOMENTS} FROM pr"))
def _(spark, sf):
    """Population std, and the sample covariance as plain aggregates."""
    ridge = F.lit(ProfilePreset().ridge)
    tail = P.normal_tail(views.flow_lineitem(spark, sf), _PAIR, 100)
    return rounded(tail.groupBy("device_id").agg(
        *[(F.stddev_pop(f) + F.lit(1e-8)).alias(f"s_{f}") for f in _PAIR],
        (F.covar_samp("quantity", "quantity") + ridge).alias("c_qq"), F.covar_samp("quantity", "discount").alias("c_qd"),
        (F.covar_samp("discount", "discount") + ridge).alias("c_dd"),
    ))


def _inverse(out: str = "pr") -> str:
    return f"""{out}_i AS (SELECT *, vd / (vq * vd - vqd * vqd) AS i_qq, -vqd / (vq * vd - vqd * vqd) AS i_qd, vq / (vq * vd - vqd * vqd) AS i_dd FROM {out})"""


def _pair_stats(keys: str) -> str:
    return f"{keys}, count(*) AS n, {stats(_PAIR)}, {cov('quantity', 'quantity')} AS vq, {cov('quantity', 'discount')} AS vqd, {cov('discount', 'discount')} AS vd"


@query("b04_inverse_covariance", Q.with_(Q.LINE, TAIL, f"pr AS (SELECT {_pair_stats('device_id')} FROM tw GROUP BY device_id HAVING count(*) >= 50)", _inverse(),
       body=f"SELECT device_id, {r('i_qq', 'i_qd', 'i_dd')} FROM pr_i"))
def _(spark, sf):
    t = _line_profiles(spark, sf, "mahalanobis", _PAIR).table
    c = F.col("cov_inv")
    return rounded(t.select("device_id", c[0][0].alias("i_qq"), c[0][1].alias("i_qd"), c[1][1].alias("i_dd")))


@query("b05_global_profile", Q.with_(Q.LINE, OVERALL, f"pr AS (SELECT dev AS device_id, count(*) AS n, {stats(_LINE)} FROM gw GROUP BY dev)",
       body=f"SELECT device_id, n, {r(*[f'{x}_{f}' for f in _LINE for x in 'ms'])} FROM pr"))
def _(spark, sf):
    return rounded(_flat(_line_profiles(spark, sf, per_device=False).with_fallback()).filter(F.col("device_id") == GLOBAL_PROFILE))


# Events: some devices are cold at warm-up 50, so the fallback is exercised.
_EVENT_TAIL = """tl AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, row_id DESC) - 1 AS r FROM fl WHERE label = 0),
tw AS (SELECT *, count(*) OVER (PARTITION BY device_id) AS n FROM tl WHERE r < 100),
gl AS (SELECT *, '__GLOBAL__' AS dev, row_number() OVER (ORDER BY ts DESC, row_id DESC) - 1 AS r FROM fl WHERE label = 0),
gw AS (SELECT *, count(*) OVER () AS n FROM gl WHERE r < 100)"""
_A, _B = _EVENT_PAIR


def _event_stats() -> str:
    return f"{stats(_EVENT_PAIR)}, {cov(_A, _A)} AS va, {cov(_A, _B)} AS vab, {cov(_B, _B)} AS vb"


_EVENT_PROFILES = f"""pd AS (SELECT device_id, {_event_stats()} FROM tw GROUP BY device_id HAVING count(*) >= 50),
pg AS (SELECT {_event_stats()} FROM gw)"""
_CELLS = [f"{x}_{f}" for f in _EVENT_PAIR for x in "ms"] + ["va", "vab", "vb"]
_EVENT_JOIN = """j AS (SELECT fl.row_id, fl.device_id, fl.label, fl.""" + f"{_A}, fl.{_B}, " + ", ".join(f"coalesce(pd.{c}, pg.{c}) AS {c}" for c in _CELLS) + """
FROM fl LEFT JOIN pd ON fl.device_id = pd.device_id CROSS JOIN pg)"""
_Z = f"(abs(({_A} - m_{_A}) / s_{_A}) + abs(({_B} - m_{_B}) / s_{_B})) / 2e0"
_QUAD = (f"(({_A} - m_{_A}) * ({_A} - m_{_A}) * vb - 2 * ({_A} - m_{_A}) * ({_B} - m_{_B}) * vab + ({_B} - m_{_B}) * ({_B} - m_{_B}) * va)"
         " / (va * vb - vab * vab)")
_M = f"sqrt(greatest({_QUAD}, 0e0))"
_SCORED = Q.with_(Q.FLOW, _EVENT_TAIL, _EVENT_PROFILES, _EVENT_JOIN, body="")
_SCORED_GLOBAL = Q.with_(Q.FLOW, _EVENT_TAIL, f"pg AS (SELECT {_event_stats()} FROM gw)", body="")


def _event_profiles(spark, sf, **kw):
    flow = views.flow_events(spark, sf)
    return flow, P.FrozenProfiles.fit(flow, _EVENT_PAIR, **kw)


@query("b06_deviation_scores", _SCORED + f"SELECT row_id, round({_Z}, 6) AS z, round({_M}, 6) AS maha FROM j")
def _(spark, sf):
    flow, profiles = _event_profiles(spark, sf)
    return rounded(profiles.score(flow).select("row_id", "z", "maha"))


@query("b07_profile_modes", _SCORED + f"""SELECT row_id, 'zscore' AS mode, round({_Z}, 6) AS z, CAST(NULL AS DOUBLE) AS maha FROM j
UNION ALL SELECT row_id, 'mahalanobis', NULL, round({_M}, 6) FROM j
UNION ALL SELECT row_id, 'none', NULL, NULL FROM j
UNION ALL SELECT row_id, 'both global', round({_Z}, 6), round({_M}, 6) FROM fl, pg""")
def _(spark, sf):
    from telvane.operators.harmonise import append_all

    flow, profiles = _event_profiles(spark, sf)
    pooled = P.FrozenProfiles.fit(flow, _EVENT_PAIR, per_device=False)
    zname, mname = P.PROFILE_FEATURES
    parts = []
    for name, p, mode in [("zscore", profiles, "zscore"), ("mahalanobis", profiles, "mahalanobis"), ("none", profiles, "none"), ("both global", pooled, "both")]:
        out, _ = p.augment(flow, mode)
        null = F.lit(None).cast("double")
        parts.append(out.select("row_id", F.lit(name).alias("mode"), (F.col(zname) if zname in out.columns else null).alias("z"),
                                (F.col(mname) if mname in out.columns else null).alias("maha")))
    return rounded(append_all(parts))


@query("b08_saved_profile", _SCORED + f"SELECT row_id, round({_Z}, 6) AS z, round({_M}, 6) AS maha FROM j")
def _(spark, sf):
    flow, profiles = _event_profiles(spark, sf)
    path = scratch_path(spark, "profile-table")
    profiles.save(path)
    loaded = P.FrozenProfiles.load(spark.read.parquet(path), _EVENT_PAIR)
    return rounded(loaded.score(flow).select("row_id", "z", "maha"))


_ROLLED = f"""rl AS (SELECT row_id, device_id, ts, {_A}, {_B}, count(*) OVER w AS c, """ + ", ".join(
    f"avg({f}) OVER w AS rm_{f}, stddev_pop({f}) OVER w + 1e-8 AS rs_{f}" for f in _EVENT_PAIR
) + f""", covar_samp({_A}, {_A}) OVER w + 1e-6 AS va, covar_samp({_A}, {_B}) OVER w AS vab, covar_samp({_B}, {_B}) OVER w + 1e-6 AS vb
  FROM fl WINDOW w AS (PARTITION BY device_id ORDER BY ts, row_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""
_READY = lambda x: f"CASE WHEN c >= 10 THEN {x} END"


@query("b09_rolling_statistics", Q.with_(Q.FLOW, _ROLLED, body="SELECT row_id, " + ", ".join(
    f"round({_READY(f'rm_{f}')}, 8) AS roll_mean_{f}, round({_READY(f'rs_{f}')}, 8) AS roll_std_{f}" for f in _EVENT_PAIR) + " FROM rl"))
def _(spark, sf):
    out = O.rolling_statistics(views.flow_events(spark, sf), _EVENT_PAIR)
    return rounded(out.select("row_id", *[f"{x}_{f}" for f in _EVENT_PAIR for x in ("roll_mean", "roll_std")]), 8)


_EWMA_LISTS = ", ".join(f"list({x}_{f}) OVER v AS l_{x}_{f}" for f in _EVENT_PAIR for x in ("rm", "rs"))
_EWMA = f"""el AS (SELECT row_id, {_EWMA_LISTS} FROM rl WHERE c >= 10 WINDOW v AS (PARTITION BY device_id ORDER BY ts, row_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
ew AS (SELECT row_id, """ + ", ".join(
    f"list_sum([l_{x}_{f}[i] * (CASE WHEN i = 1 THEN pow(0.9e0, len(l_{x}_{f}) - 1) ELSE 0.1e0 * pow(0.9e0, len(l_{x}_{f}) - i) END) for i in range(1, len(l_{x}_{f}) + 1)]) AS {m}_{f}"
    for f in _EVENT_PAIR for x, m in (("rm", "m"), ("rs", "s"))
) + """ FROM el),
on_ AS (SELECT rl.*, ew.* EXCLUDE (row_id) FROM rl LEFT JOIN ew ON rl.row_id = ew.row_id)"""
_ONLINE = Q.with_(Q.FLOW, _ROLLED, _EWMA, body="")
_OZ = f"coalesce((abs(({_A} - m_{_A}) / (s_{_A} + 1e-8)) + abs(({_B} - m_{_B}) / (s_{_B} + 1e-8))) / 2e0, 0e0)"


def _online(spark, sf):
    return O.online_scores(views.flow_events(spark, sf).select("row_id", "device_id", "ts", *_EVENT_PAIR), _EVENT_PAIR)


@query("b10_online_zscore", _ONLINE + f"SELECT row_id, round({_OZ}, 6) AS deviation_zscore_mean FROM on_")
def _(spark, sf):
    return rounded(_online(spark, sf).select("row_id", "deviation_zscore_mean"))


@query("b11_online_mahalanobis", _ONLINE + f"SELECT row_id, round(CASE WHEN c >= 20 THEN {_M} ELSE 0e0 END, 6) AS mahalanobis_dist FROM on_")
def _(spark, sf):
    return rounded(_online(spark, sf).select("row_id", "mahalanobis_dist"))


@query("b12_update_then_score", _ONLINE + f"""SELECT device_id, count(*) AS n, round(avg({_OZ}), 6) AS z, round(avg(CASE WHEN c >= 20 THEN {_M} ELSE 0e0 END), 6) AS maha,
  CAST(sum(CASE WHEN c >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS warm_rows FROM on_ GROUP BY device_id""")
def _(spark, sf):
    return rounded(_online(spark, sf).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("deviation_zscore_mean").alias("z"), F.avg("mahalanobis_dist").alias("maha"),
        F.sum(F.col("is_warm").cast("int")).alias("warm_rows")))


_LAST = "ls AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, row_id DESC) AS rn, count(*) OVER (PARTITION BY device_id) AS seen FROM on_)"


@query("b13_device_states", _ONLINE.rstrip() + ",\n" + _LAST + f"""
SELECT device_id, seen AS n_updates, round(m_{_A}, 6) AS mean_a, round(s_{_B}, 6) AS std_b, round(va, 4) AS cov_a, c >= 20 AS is_warm FROM ls WHERE rn = 1""")
def _(spark, sf):
    flow = views.flow_events(spark, sf)
    out = O.fit_devices(flow, _EVENT_PAIR)
    return rounded(out.select("device_id", "n_updates", F.col("mean")[0].alias("mean_a"), F.col("std")[1].alias("std_b"),
                              F.round(F.col("cov")[0][0], 4).alias("cov_a"), "is_warm"))


_CONFIGS = "cf(config, alpha, window_size, warm_up) AS (VALUES " + ", ".join(
    f"({i}, {Q.d(p.alpha)}, {p.window}, {p.warm_up})" for i, (_, _, p) in enumerate(P.SENSITIVITY)) + ")"
_SENS = f"""t0 AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, row_id DESC) - 1 AS r FROM li WHERE label = 0),
t1 AS (SELECT cf.*, t0.*, count(*) OVER (PARTITION BY config, device_id) AS n FROM cf JOIN t0 ON r < window_size),
sp AS (SELECT config, device_id, {stats(_LINE, 'any_value(alpha)')} FROM t1 GROUP BY config, device_id, warm_up HAVING count(*) >= warm_up),
g0 AS (SELECT *, row_number() OVER (ORDER BY ts DESC, row_id DESC) - 1 AS r FROM li WHERE label = 0),
g1 AS (SELECT cf.*, g0.*, count(*) OVER (PARTITION BY config) AS n FROM cf JOIN g0 ON r < window_size),
sg AS (SELECT config, {stats(_LINE, 'any_value(alpha)')} FROM g1 GROUP BY config)""".replace("any_value(alpha)", "alpha")


@query("b14_profile_sensitivity", Q.with_(Q.LINE, _CONFIGS, _SENS, body="""SELECT cf.config, count(DISTINCT sp.device_id) AS warm_profiles, count(*) AS n, round(avg((""" + " + ".join(
    f"abs((li.{f} - coalesce(sp.m_{f}, sg.m_{f})) / coalesce(sp.s_{f}, sg.s_{f}))" for f in _LINE) + f""") / {len(_LINE)}e0), 6) AS mean_z
FROM li CROSS JOIN cf JOIN sg ON sg.config = cf.config LEFT JOIN sp ON sp.config = cf.config AND sp.device_id = li.device_id GROUP BY cf.config"""))
def _(spark, sf):
    from telvane.session import settle

    li = views.flow_lineitem(spark, sf)
    profiles = settle(P.sensitivity_profiles(li, _LINE), "sensitivity")
    scored = P.sensitivity_scores(li.select("device_id", *_LINE), profiles, _LINE)
    warm = profiles.groupBy("config").agg(F.count(F.when(F.col("device_id") != GLOBAL_PROFILE, 1)).alias("warm_profiles"))
    return rounded(scored.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z")).join(warm, "config"))


