"""Queries: cleaning, encoding, scaling, splitting, sampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from telvane.operators import clean, split
from telvane.operators.scale import RobustScale
from telvane.plans import sql as Q
from telvane.plans import views
from telvane.plans.catalog import query, r, rounded
from telvane.schema import FEATURES

_DIRTY = Q.EV + """, dt AS (SELECT CAST(event_id AS VARCHAR) AS row_id, event_id, k, value,
  CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS burst_length,
  CASE WHEN k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 THEN NULL ELSE value END AS byte_rate FROM ev)"""
_COLUMNS = ["burst_length", "byte_rate", "port_diversity"]
_LINE = views.LINE_FEATURES


@query("c01_select_features", Q.with_(Q.FLOW, body=f"SELECT row_id, {r(*FEATURES, digits=8)} FROM fl"))
def _(spark, sf):
    return rounded(clean.select_features(views.flow_events(spark, sf), ["row_id"]), 8)


@query("c02_numeric_coercion", Q.with_(_DIRTY, body="SELECT row_id, burst_length FROM dt"))
def _(spark, sf):
    return clean.coerce_numeric(views.dirty_events(spark, sf), ["burst_length"]).select("row_id", "burst_length")


@query("c03_first_appearance_codes", Q.with_(Q.EV, """nm AS (SELECT event_id, event_type || '_' || k AS name FROM ev)""",
       """fs AS (SELECT name, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM nm GROUP BY name)""",
       body="SELECT CAST(event_id AS VARCHAR) AS row_id, CAST(code AS DOUBLE) AS code FROM nm JOIN fs ON nm.name = fs.name"))
def _(spark, sf):
    ev = views.event_rows(spark, sf).select("event_id", F.concat_ws("_", "event_type", F.col("k").cast("string")).alias("name"))
    return clean.factorise(ev, "name", ["event_id"], "code").select(F.col("event_id").cast("string").alias("row_id"), "code")


@query("c04_infinities_to_null", Q.with_(_DIRTY, body="SELECT row_id, byte_rate FROM dt"))
def _(spark, sf):
    return clean.infinities_to_null(views.dirty_events(spark, sf), ["byte_rate"]).select("row_id", "byte_rate")


@query("c05_median_imputation", Q.with_(_DIRTY, "m AS (SELECT quantile_cont(burst_length, 0.5) AS mb, quantile_cont(byte_rate, 0.5) AS my FROM dt)", body="""
SELECT row_id, round(coalesce(burst_length, mb), 6) AS burst_length, round(coalesce(byte_rate, my), 6) AS byte_rate, 0e0 AS port_diversity FROM dt, m"""))
def _(spark, sf):
    return rounded(clean.impute_median(views.dirty_events(spark, sf), _COLUMNS).select("row_id", *_COLUMNS))


def _wave(fn: str, c: str, period: int) -> str:
    return f"{fn}({2 * math.pi!r}e0 * {c} / {period}e0)"


_CYCLES = ", ".join(f"round({_wave(fn, c, p)}, 6) AS {n}_{fn}" for c, n, p in (("time_of_day", "time", 24), ("day_of_week", "day", 7)) for fn in ("sin", "cos"))


@query("c06_cyclic_encoding", Q.with_(Q.FLOW, body=f"SELECT row_id, {_CYCLES}, CAST(time_of_day AS INTEGER) AS hour FROM fl"))
def _(spark, sf):
    out = clean.encode_cyclic(views.flow_events(spark, sf).select("row_id", "time_of_day", "day_of_week"), keep_hour="hour")
    return rounded(out)


_SCALED = ["byte_rate", "burst_length", "response_time", "session_duration", "inter_arrival_time"]


def robust(source: str, columns: list[str], where: str = "true", out: str = "rs") -> str:
    """SQL CTE with one row of medians and (non-zero) IQRs."""
    parts = ", ".join(
        f"quantile_cont({c}, 0.5) AS c_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1e0 "
        f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}" for c in columns
    )
    return f"{out} AS (SELECT {parts} FROM {source} WHERE {where})"


def scaled(columns: list[str]) -> str:
    return ", ".join(f"({c} - c_{c}) / s_{c} AS {c}" for c in columns)


@query("c07_robust_scaling", Q.with_(Q.FLOW, robust("fl", _SCALED), body=f"SELECT row_id, {', '.join(f'round(({c} - c_{c}) / s_{c}, 6) AS {c}' for c in _SCALED)} FROM fl, rs"))
def _(spark, sf):
    flow = views.flow_events(spark, sf).select("row_id", *_SCALED)
    return rounded(RobustScale.fit(flow, _SCALED).transform(flow))


@query("c08_foreign_scaler", Q.with_(Q.LINE, "eu AS (SELECT * FROM li WHERE label = 0)", robust("eu", _LINE), body=f"SELECT row_id, {', '.join(f'round(({c} - c_{c}) / s_{c}, 6) AS {c}' for c in _LINE)} FROM li, rs WHERE label = 1"))
def _(spark, sf):
    li = views.flow_lineitem(spark, sf)
    fitted = RobustScale.fit(li.filter("label = 0"), _LINE).table(spark)
    return rounded(RobustScale.from_table(fitted).transform(li.filter("label = 1").select("row_id", *_LINE)))


@query("c09_category_codes", Q.with_(Q.LINE, body="""SELECT row_id, attack_cat, CAST(dense_rank() OVER (ORDER BY attack_cat) - 1 AS DOUBLE) AS y_multi FROM li"""))
def _(spark, sf):
    from pyspark.ml.feature import StringIndexer

    li = views.flow_lineitem(spark, sf).select("row_id", "attack_cat")
    return StringIndexer(inputCol="attack_cat", outputCol="y_multi", stringOrderType="alphabetAsc").fit(li).transform(li)


@query("c10_hash_split", Q.with_(Q.EV, body=f"""SELECT CAST(event_id AS VARCHAR) AS row_id, {Q.split("CAST(event_id AS VARCHAR)")} AS split FROM ev"""))
def _(spark, sf):
    return views.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("row_id"),
                                                   split.split_column(F.col("event_id").cast("string")).alias("split"))


_RANKED = """rk AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) - 1 AS rn,
  count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS m FROM li)"""


@query("c10_stratified_split", Q.with_(Q.LINE, _RANKED, body="""SELECT row_id, label, CASE WHEN rn < floor(0.7e0 * n + 0.5e0) THEN 'train'
  WHEN rn < floor((0.7e0 + 0.1e0) * n + 0.5e0) THEN 'val' ELSE 'test' END AS split FROM rk"""))
def _(spark, sf):
    return split.stratified_split(views.flow_lineitem(spark, sf).select("row_id", "label"))


@query("c11_stratified_sample", Q.with_(Q.LINE, _RANKED, body="""SELECT row_id, label FROM rk WHERE rn < greatest(1, floor(5000e0 * n / m + 0.5e0))"""))
def _(spark, sf):
    return split.stratified_sample(views.flow_lineitem(spark, sf).select("row_id", "label"), 5000)


@query("c13_normal_rows", Q.with_(Q.LINE, body="SELECT device_id, count(*) AS n, round(sum(quantity), 2) AS quantity FROM li WHERE label = 0 GROUP BY device_id"))
def _(spark, sf):
    return split.normal_rows(views.flow_lineitem(spark, sf)).groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query("c14_attack_ratio", Q.with_(Q.LINE, body="SELECT round(least(greatest(avg(CASE WHEN label > 0 THEN 1e0 ELSE 0e0 END), 0.01e0), 0.45e0), 6) AS attack_ratio FROM li"))
def _(spark, sf):
    return rounded(split.attack_ratio(views.flow_lineitem(spark, sf)))


@query("c15_hold_out_class", Q.with_(Q.SCORES, "top AS (SELECT attack_cat, count(*) AS n FROM sc WHERE label = 1 AND split = 'train' GROUP BY attack_cat ORDER BY n DESC, attack_cat LIMIT 3)", body="""
SELECT top.attack_cat AS held_out, sc.split, sc.attack_cat, count(*) AS n FROM top, sc
WHERE sc.split <> 'train' OR sc.attack_cat <> top.attack_cat GROUP BY 1, 2, 3"""))
def _(spark, sf):
    sc = views.scores_events(spark, sf)
    parts = []
    for row in split.frequent_attacks(sc.filter("split = 'train'")).collect():  # three names
        kept = split.hold_out_class(sc, row["attack_cat"])
        parts.append(kept.groupBy(F.lit(row["attack_cat"]).alias("held_out"), "split", "attack_cat").agg(F.count(F.lit(1)).alias("n")))
    from telvane.operators.harmonise import append_all

    return append_all(parts)
