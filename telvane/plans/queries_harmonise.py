"""Queries: harmonising source tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from telvane.functions.labels import composite_category

from telvane.operators import harmonise as H
from telvane.operators import vocab as V
from telvane.plans import sql as Q
from telvane.plans import views
from telvane.plans.catalog import query, rounded

_KDD_FEATURES = list(V.KDD_RENAMES.values())


def _synthetic(feature: str, row_id: str = "row_id") -> str:
    """SQL form of the keyed stand-in value of a feature."""
    kind, a, b = V.FEATURE_DEFAULTS[feature]
    u = lambda at: f"((CAST('0x' || substr(md5('42:{feature}:' || {row_id}), {at}, 8) AS BIGINT) + 0.5e0) / 4294967296e0)"
    if kind == "uniform":
        return f"({Q.d(a)} + {Q.d(b - a)} * {u(1)})"
    if kind == "integer":
        return f"floor({Q.d(a)} + {Q.d(b - a)} * {u(1)})"
    drawn = f"abs({Q.d(a)} + {Q.d(b)} * sqrt(-2e0 * ln({u(1)})) * cos({2 * math.pi!r}e0 * {u(9)}))"
    return f"floor({drawn})" if kind == "whole normal" else drawn


@query("h01_kdd_renames", Q.with_(Q.KDD, body=f"""SELECT row_id, {', '.join(
    f'round({s}, 6) AS {t}' for s, t in V.KDD_RENAMES.items() if t != 'protocol_distribution')} FROM kd"""))
def _(spark, sf):
    out = H.harmonise_kdd(views.kdd_shaped(spark, sf))
    return rounded(out.select("row_id", *[f for f in _KDD_FEATURES if f != "protocol_distribution"]))


@query("h02_attack_taxonomy", Q.with_(Q.KDD, Q.TAXONOMY, body="""
SELECT row_id, lower(trim(attack_type)) AS attack_type, coalesce(cat, 'Unknown') AS attack_cat, coalesce(lab, 1) AS label
FROM kd LEFT JOIN tx ON lower(trim(attack_type)) = name"""))
def _(spark, sf):
    return H.with_taxonomy(views.kdd_shaped(spark, sf)).select("row_id", "attack_type", "attack_cat", "label")


@query("h03_protocol_code", Q.with_(Q.KDD, body="""
SELECT row_id, CASE lower(protocol_type) WHEN 'tcp' THEN 0 WHEN 'udp' THEN 1 WHEN 'icmp' THEN 2 ELSE 0 END AS protocol_distribution FROM kd"""))
def _(spark, sf):
    return H.harmonise_kdd(views.kdd_shaped(spark, sf)).select("row_id", "protocol_distribution")


@query("h04_kdd_csv", Q.with_(Q.KDD, Q.TAXONOMY, body="""
SELECT row_id, coalesce(cat, 'Unknown') AS attack_cat, CASE WHEN lower(trim(attack_type)) = 'normal' THEN 0 ELSE 1 END AS label,
  round(diff_srv_rate, 6) AS protocol_distribution, round(src_bytes, 6) AS byte_rate
FROM kd LEFT JOIN tx ON lower(trim(attack_type)) = name"""))
def _(spark, sf):
    raw = views.kdd_shaped(spark, sf).withColumnsRenamed({"attack_type": " Class ", "src_bytes": "Src_Bytes"})
    out = H.harmonise_kdd_csv(raw)
    return rounded(out.select("row_id", "attack_cat", "label", "protocol_distribution", "byte_rate"))


_CIC = {"session_duration": "value", "packet_rate": "CAST(k AS DOUBLE)", "burst_length": "CAST(k % 7 AS DOUBLE)", "byte_rate": "value * 3",
        "payload_size_mean": "value / 2", "payload_size_std": "value / 4", "inter_arrival_time": "value + k", "response_time": "k / 10e0",
        "port_diversity": "CAST(user_id AS DOUBLE)"}


@query("h05_cic_flows", Q.with_(Q.EV, body=f"""SELECT CAST(event_id AS VARCHAR) AS row_id, {', '.join(f'round({e}, 6) AS {f}' for f, e in _CIC.items())},
  label, CASE WHEN label = 0 THEN 'Normal' ELSE 'Attack' END AS attack_cat FROM ev"""))
def _(spark, sf):
    return rounded(H.harmonise_cic(views.cic_shaped(spark, sf)).select("row_id", *_CIC, "label", "attack_cat"))


@query("h06_rt_iot_flows", Q.with_(Q.EV, body="""SELECT CAST(event_id AS VARCHAR) AS row_id, round(value, 6) AS session_duration,
  CAST(k % 5 AS DOUBLE) AS byte_rate, round(value / 4, 6) AS payload_size_std, round(value + k, 6) AS inter_arrival_time, label,
  CASE WHEN label = 1 THEN 'DOS_SYN_Hping' ELSE 'Normal' END AS attack_cat FROM ev"""))
def _(spark, sf):
    out = H.harmonise_rt_iot(views.rt_iot_shaped(spark, sf))
    return rounded(out.select("row_id", "session_duration", "byte_rate", "payload_size_std", "inter_arrival_time", "label", "attack_cat"))


@query("h07_unsw_flows", Q.with_(Q.LINE, body=f"""SELECT row_id, round(quantity, 6) AS packet_rate, round(extendedprice, 4) AS byte_rate,
  round(tax, 6) AS session_duration, label, attack_cat, round({_synthetic('conn_frequency')}, 6) AS conn_frequency FROM li"""))
def _(spark, sf):
    out = H.harmonise_unsw(views.unsw_shaped(spark, sf))
    return out.select("row_id", F.round("packet_rate", 6).alias("packet_rate"), F.round("byte_rate", 4).alias("byte_rate"),
                      F.round("session_duration", 6).alias("session_duration"), "label", "attack_cat", F.round("conn_frequency", 6).alias("conn_frequency"))


@query("h08_normalise_headers", """SELECT CAST(o_orderkey AS VARCHAR) AS row_id, o_totalprice AS total_price, o_custkey AS cust_key FROM orders""")
def _(spark, sf):
    return H.normalise_headers(views.orders_shaped(spark, sf)).select("row_id", "total_price", "cust_key")


_CLASS = "CASE WHEN o_orderstatus = 'F' THEN ' Normal' WHEN o_orderstatus = 'O' THEN 'BENIGN' ELSE o_orderpriority END"


@query("h09_generic_labels", f"""SELECT CAST(o_orderkey AS VARCHAR) AS row_id, 'text' AS kind, CASE WHEN o_orderstatus IN ('F', 'O') THEN 0 ELSE 1 END AS label, {_CLASS} AS attack_cat FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'binary', CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, CASE WHEN o_orderstatus = 'F' THEN 'Attack' ELSE 'Normal' END FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'none', 0, 'Normal' FROM orders""")
def _(spark, sf):
    raw = views.orders_shaped(spark, sf)
    orders = views.table(spark, sf, "orders")
    binary = orders.select(F.col("o_orderkey").cast("string").alias("row_id"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("anomaly"))
    parts = {"text": H.normalise_headers(raw), "binary": binary, "none": orders.select(F.col("o_orderkey").cast("string").alias("row_id"))}
    return H.append_all([H.label_generic(df).select("row_id", F.lit(kind).alias("kind"), "label", "attack_cat") for kind, df in parts.items()])


@query("h10_generic_positional", f"""SELECT CAST(o_orderkey AS VARCHAR) AS row_id, o_totalprice AS packet_rate, CAST(o_custkey AS DOUBLE) AS byte_rate,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN 0 ELSE 1 END AS label,
  round({_synthetic('burst_length', 'CAST(o_orderkey AS VARCHAR)')}, 6) AS burst_length FROM orders""")
def _(spark, sf):
    out = H.harmonise_generic(views.orders_shaped(spark, sf))
    return out.select("row_id", "packet_rate", F.col("byte_rate").cast("double").alias("byte_rate"), "label", F.round("burst_length", 6).alias("burst_length"))


@query("h11_stand_in_features", f"""SELECT CAST(o_orderkey AS VARCHAR) AS row_id, {', '.join(
    f"round({_synthetic(f, 'CAST(o_orderkey AS VARCHAR)')}, 6) AS {f}" for f in V.FEATURE_DEFAULTS)} FROM orders""")
def _(spark, sf):
    keys = views.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("row_id"))
    return rounded(H.complete(keys).select("row_id", *V.FEATURE_DEFAULTS))


@query("h12_default_columns", f"""SELECT 0 AS label, 'Normal' AS attack_cat, format('device_{{:03d}}', {Q.md5_mod("'device:' || CAST(o_orderkey AS VARCHAR)", 20)}) AS device_id, count(*) AS n
FROM orders GROUP BY 3""")
def _(spark, sf):
    keys = views.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("row_id"))
    return H.complete(keys).groupBy("label", "attack_cat", "device_id").agg(F.count(F.lit(1)).alias("n"))


@query("h13_infer_labels", """SELECT CAST(event_id AS VARCHAR) AS row_id, CASE WHEN event_id % 5 > 0 THEN 1 ELSE 0 END AS y_number,
  CASE WHEN event_type IN ('click', 'view', 'signup') OR event_id % 3 = 0 THEN 0 ELSE 1 END AS y_text FROM events""")
def _(spark, sf):
    ev = views.table(spark, sf, "events")
    key = F.col("event_id").cast("string").alias("row_id")
    number = H.infer_labels(ev.select(key, (F.col("event_id") % 5).alias("Label")), "y_number").select("row_id", "y_number")
    kind = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_type") == "click", " Safe").when(F.col("event_type") == "view", "abNORMAL x") \
        .when(F.col("event_type") == "signup", "Benign traffic").otherwise("Botnet")
    text = H.infer_labels(ev.select(key, kind.alias("attack_type")), "y_text").select("row_id", "y_text")
    return number.join(text, "row_id")


@query("h14_infer_categories", Q.with_(Q.EV, body="""
SELECT CAST(event_id AS VARCHAR) AS row_id, CASE WHEN label = 0 THEN 'Normal' WHEN k % 4 = 0 THEN 'Unknown' ELSE event_type || k % 4 END AS category,
  CASE WHEN label = 0 THEN 'Normal' ELSE 'Attack' END AS without_names FROM ev"""))
def _(spark, sf):
    ev = views.event_rows(spark, sf).withColumn("y", F.when(F.col("event_type") == "error", 1).otherwise(0))
    name = F.when(F.col("k") % 4 != 0, F.concat("event_type", (F.col("k") % 4).cast("string")))
    both = ev.select(F.col("event_id").cast("string").alias("row_id"), "y", name.alias("attack_type"))
    named = H.infer_categories(both)
    return H.infer_categories(named.drop("attack_type"), out="without_names").select("row_id", "category", "without_names")


@query("h15_composite_category", Q.with_(Q.TELEMETRY, body="""
SELECT row_id, CASE WHEN attack = 0 THEN 'Normal' WHEN attack_P1 + attack_P2 + attack_P3 = 0 THEN 'HAI_System' ELSE
  'HAI_' || concat_ws('_', CASE WHEN attack_P1 = 1 THEN 'P1' END, CASE WHEN attack_P2 = 1 THEN 'P2' END, CASE WHEN attack_P3 = 1 THEN 'P3' END) END AS attack_cat FROM te"""))
def _(spark, sf):
    te = views.telemetry_events(spark, sf)
    return te.select("row_id", composite_category("attack", {p: f"attack_{p}" for p in ("P1", "P2", "P3")}).alias("attack_cat"))


