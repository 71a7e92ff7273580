"""Queries: sources, sinks and gates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from telvane.operators.alerts import build_alerts
from telvane.operators.evaluate import dataset_summary, metrics
from telvane.operators.harmonise import append_all
from telvane.plans import sql as Q
from telvane.plans import views
from telvane.plans.catalog import query, r, rounded
from telvane.session import scratch_path
from telvane.sources import readers, writers

_FLOW_COLUMNS = ["row_id", "device_id", "label", "attack_cat", "byte_rate", "session_duration", "time_of_day"]


@query("s01_read_unified", Q.with_(Q.FLOW, body=f"""
SELECT row_id, device_id, label, attack_cat, {r('byte_rate', 'session_duration', 'time_of_day')} FROM fl"""))
def _(spark, sf):
    path = writers.write_unified(views.flow_events(spark, sf), scratch_path(spark, "unified"))
    return rounded(readers.read_unified(spark, path).select(*_FLOW_COLUMNS))


@query("s02_write_unified", Q.with_(Q.EV, Q.LINE, body="""
SELECT 'events' AS source_dataset, label, count(*) AS n FROM ev GROUP BY label
UNION ALL SELECT 'lineitem', label, count(*) FROM li GROUP BY label"""))
def _(spark, sf):
    both = append_all([views.flow_events(spark, sf), views.flow_lineitem(spark, sf)])
    path = writers.write_unified(both, scratch_path(spark, "unified"), by_source=True)
    return readers.read_unified(spark, path).groupBy("source_dataset", "label").agg(F.count(F.lit(1)).alias("n"))


@query("s03_read_by_suffix", """
SELECT kind, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders,
  (VALUES ('parquet'), ('csv'), ('jsonl'), ('json')) AS f(kind) GROUP BY kind, o_orderstatus""")
def _(spark, sf):
    orders, base = views.table(spark, sf, "orders"), scratch_path(spark, "orders")
    orders.write.parquet(f"{base}.parquet")
    orders.write.csv(f"{base}.csv", header=True)
    orders.write.json(f"{base}.jsonl")
    # a .json file is one document: an array of the orders of a million keys
    arrays = orders.groupBy(F.floor(F.col("o_orderkey") / F.lit(1_000_000))).agg(F.to_json(F.collect_list(F.struct(*orders.columns))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{base}.json")
    parts = []
    for kind in ("parquet", "csv", "jsonl", "json"):
        df = readers.read_table(spark, f"{base}.{kind}", orders.schema)
        parts.append(df.select(F.lit(kind).alias("kind"), "o_orderstatus", "o_totalprice"))
    return append_all(parts).groupBy("kind", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price")
    )


@query("s04_read_delimited", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal
FROM customer WHERE c_custkey % 10 <> 0""")
def _(spark, sf):
    """Customers as text where every tenth line has a field too many and every seventh a bad number."""
    c = views.table(spark, sf, "customer")
    balance = F.when(F.col("c_custkey") % 7 == 0, "?").otherwise(F.col("c_acctbal").cast("string"))
    extra = F.when(F.col("c_custkey") % 10 == 0, "surplus")
    path = scratch_path(spark, "customers")
    c.select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", balance, extra)).write.text(path)
    schema = T.StructType([
        T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.DoubleType()),
    ])
    return readers.read_delimited(spark, path, schema, sep="|", header=False)


@query("s05_read_telemetry", Q.with_(Q.TELEMETRY, body="""
SELECT strftime(time, '%Y-%m-%d %H:%M:%S') AS time, round(P1_value, 6) AS P1_value, round(P4_k, 6) AS P4_k, attack, attack_P2 FROM te"""))
def _(spark, sf):
    path = scratch_path(spark, "telemetry")
    df = views.telemetry_events(spark, sf).drop("source_file", "row_id")
    df.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss")).write.csv(path, sep=";", header=True, compression="gzip")
    return rounded(readers.read_telemetry(spark, path).select("time", "P1_value", "P4_k", "attack", "attack_P2"))


@query("s06_positional_columns", Q.with_(Q.KDD, body="""
SELECT protocol_type, count(*) AS n, round(sum(duration), 4) AS duration, round(sum(dst_host_count), 4) AS dst_host_count,
  count(DISTINCT attack_type) AS names FROM kd GROUP BY protocol_type"""))
def _(spark, sf):
    path = scratch_path(spark, "records")
    views.kdd_shaped(spark, sf).drop("row_id").write.csv(path, ignoreLeadingWhiteSpace=False)
    return readers.read_connection_records(spark, path).groupBy("protocol_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 4).alias("duration"),
        F.round(F.sum("dst_host_count"), 4).alias("dst_host_count"), F.countDistinct("attack_type").alias("names"),
    )


@query("s07_first_valid_source", Q.with_(Q.EV, body="SELECT 'flow events' AS source, label, count(*) AS n FROM ev GROUP BY label"))
def _(spark, sf):
    name, df = readers.load_first_valid([
        ("missing cache", lambda: readers.read_unified(spark, f"{sf}/no-such-table.parquet")),
        ("wrong columns", lambda: views.table(spark, sf, "region")),
        ("flow events", lambda: views.flow_events(spark, sf)),
    ])
    return df.groupBy(F.lit(name).alias("source"), "label").agg(F.count(F.lit(1)).alias("n"))


@query("s08_validation_gate", Q.with_(Q.EV, body="""
SELECT count(*) AS n_rows, 0 AS n_missing_columns, count(*) >= 100 AS is_valid FROM ev"""))
def _(spark, sf):
    return readers.validation_report(views.flow_events(spark, sf))


def _alert_input(spark, sf):
    return views.scores_events(spark, sf).withColumns({
        "score": F.lit(0.4567) * F.col("s_if") + F.lit(0.5433) * F.col("p_rf"),
        "attack_type": F.col("attack_cat"), "device_type": F.lit("Camera"), "load": F.least(F.lit(1.0), F.col("z") / F.lit(4.9)),
    })


@query("s09_alert_sink", Q.with_(Q.SCORES, f"""al AS (SELECT row_id, 0.4567e0 * s_if + 0.5433e0 * p_rf AS score,
  {Q.tau('least(1e0, z / 4.9e0)', '0.6e0', 'hour', '0.5e0')} AS tau, s_if, p_rf, hour FROM sc)""", body="""
SELECT 'ALERT-' || substr(md5('alert:' || row_id), 1, 12) AS alert_id, round(score, 4) AS fused_score, round(tau, 4) AS threshold_used,
  CASE WHEN score < tau + 0.15e0 THEN 'WARNING' ELSE 'CRITICAL' END AS alert_level, CAST(hour AS BIGINT) AS hour
FROM al WHERE score >= tau"""))
def _(spark, sf):
    path = writers.write_alerts(build_alerts(_alert_input(spark, sf)), scratch_path(spark, "alerts"))
    schema = "alert_id string, fused_score double, threshold_used double, alert_level string, context struct<hour: bigint>"
    return spark.read.schema(schema).json(path).select("alert_id", "fused_score", "threshold_used", "alert_level", "context.hour")


def _metric_row(spark, sf):
    return metrics(views.scores_events(spark, sf).withColumn("score", F.col("p_rf")), 0.5)


_METRICS_SQL = Q.with_(Q.SCORES, f"c AS (SELECT {Q.counts('p_rf >= 0.5e0')} FROM sc)", "s AS (SELECT label, p_rf AS score FROM sc)", Q.ranking("s"),
                       body=f"""SELECT round({Q.PRECISION}, 4) AS precision, round({Q.F1}, 4) AS f1, round(auc, 4) AS roc_auc, tp, fn FROM c, rk""")
_METRIC_SCHEMA = "precision double, f1 double, roc_auc double, tp long, fn long"


@query("s10_result_sink", _METRICS_SQL)
def _(spark, sf):
    path = scratch_path(spark, "results")
    row = _metric_row(spark, sf).withColumn("experiment", F.lit("baseline"))
    writers.write_results([row, row.select("experiment", F.lit("note").alias("note"))], path, "run1")
    names = [c.split()[0] for c in _METRIC_SCHEMA.split(", ")]
    back = spark.read.csv(f"{path}/csv/latest", header=True).filter(F.col("note").isNull())
    return back.select(*[F.col(n).cast(t).alias(n) for n, t in (c.split() for c in _METRIC_SCHEMA.split(", "))]).select(*names)


@query("s11_metrics_sink", _METRICS_SQL)
def _(spark, sf):
    return spark.read.schema(_METRIC_SCHEMA).json(writers.write_metrics(_metric_row(spark, sf), scratch_path(spark, "metrics")))


@query("s13_append_tables", Q.with_(Q.FLOW, Q.LINE, body="""
SELECT source_dataset, count(*) AS n, count(byte_rate) AS with_byte_rate, count(quantity) AS with_quantity, CAST(sum(label) AS BIGINT) AS attacks FROM
  (SELECT source_dataset, byte_rate, NULL AS quantity, label FROM fl UNION ALL SELECT source_dataset, NULL, quantity, label FROM li)
GROUP BY source_dataset"""))
def _(spark, sf):
    both = append_all([views.flow_events(spark, sf), views.flow_lineitem(spark, sf)])
    return both.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("n"), F.count("byte_rate").alias("with_byte_rate"),
        F.count("quantity").alias("with_quantity"), F.sum("label").alias("attacks"),
    )


@query("s14_dataset_summary", Q.with_(Q.SCORES, body="""
SELECT attack_cat, split, count(*) AS rows, CAST(sum(1 - label) AS BIGINT) AS normal, CAST(sum(label) AS BIGINT) AS attack,
  round(avg(CAST(label AS DOUBLE)), 4) AS attack_ratio FROM sc GROUP BY attack_cat, split"""))
def _(spark, sf):
    return dataset_summary(views.scores_events(spark, sf), by=["split"])
