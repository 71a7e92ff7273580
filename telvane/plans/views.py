"""Detector-shaped views over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from telvane.operators import vocab as V
from telvane.operators.series import null_safe_join, with_series_columns
from telvane.operators.split import split_column

LINE_FEATURES = ["quantity", "extendedprice", "discount", "tax"]
ROLL, BUFFER = 30, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def device_name(c) -> F.Column:
    return F.format_string("device_%03d", F.col(c) if isinstance(c, str) else c)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).drop("props")


def event_category(label, value) -> F.Column:
    return F.when(label == 0, "Normal").when(value >= 50, "HighValue").otherwise("LowValue")


def flow_events(spark: SparkSession, sf_dir: str, max_rows: int | None = None) -> DataFrame:
    """One unified flow row per event; device = user, attack = error event."""
    ev = event_rows(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))

    def build(w):
        gap = (F.col("us") - F.lag("us").over(w)) / F.lit(1e6)
        roll, buffer = w.rowsBetween(-(ROLL - 1), 0), w.rowsBetween(-(BUFFER - 1), 0)
        return {
            "inter_arrival_time": F.greatest(F.lit(1.0), F.coalesce(gap, F.lit(1.0))),
            "conn_frequency": F.avg("value").over(roll),
            "response_time": F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0)),
            "payload_size_mean": F.avg("value").over(buffer),
            "payload_size_std": F.stddev_pop("value").over(buffer),
        }

    rows = with_series_columns(ev, "user_id", ["ts", "event_id"], BUFFER - 1, build, max_rows)
    starts = ev.groupBy("user_id").agg(F.min("us").alias("start_us"))
    label = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return null_safe_join(rows, starts, ["user_id"]).select(
        (F.lit(1.0) / F.col("inter_arrival_time")).alias("packet_rate"),
        F.col("value").alias("byte_rate"),
        F.col("k").cast("double").alias("burst_length"),
        "inter_arrival_time",
        "conn_frequency",
        (F.col("k") % 7).cast("double").alias("unique_dst_ips"),
        (F.col("k") / F.lit(100.0)).alias("port_diversity"),
        (F.col("k") % 3).cast("double").alias("protocol_distribution"),
        "response_time",
        (F.pmod(F.col("us") - F.col("start_us"), F.lit(3_600_000_000)) / F.lit(1e6)).alias("session_duration"),
        "payload_size_mean",
        "payload_size_std",
        F.hour("ts").cast("double").alias("time_of_day"),
        F.weekday("ts").cast("double").alias("day_of_week"),
        label.alias("label"),
        event_category(label, F.col("value")).alias("attack_cat"),
        device_name("user_id").alias("device_id"),
        F.lit("events").alias("source_dataset"),
        F.col("event_id").cast("string").alias("row_id"),
        "ts",
    )


def flow_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-feature flow rows; device = supplier, attack = returned line. Row key = digest of the whole row."""
    li = table(spark, sf_dir, "lineitem")
    key = [c for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return li.select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Returned_"), F.col("l_linestatus"))).otherwise("Normal").alias("attack_cat"),
        device_name("l_suppkey").alias("device_id"),
        F.lit("lineitem").alias("source_dataset"),
        F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key])).alias("row_id"),
        F.col("l_shipdate").alias("ts"),
    )


def scores_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table that needs no trained model: s_if and p_rf from the event's value and k."""
    ev = event_rows(spark, sf_dir)
    label = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return ev.select(
        F.col("event_id").cast("string").alias("row_id"), "ts",
        split_column(F.col("event_id").cast("string")).alias("split"),
        label.alias("label"),
        event_category(label, F.col("value")).alias("attack_cat"),
        device_name("user_id").alias("device_id"),
        F.hour("ts").alias("hour"),
        F.least(F.lit(1.0), F.col("value") / F.lit(200.0)).alias("s_if"),
        (F.col("k") / F.lit(100.0)).alias("p_rf"),
        (F.col("value") / F.lit(100.0)).alias("z"),
        (F.col("k") / F.lit(25.0)).alias("maha"),
    )


def telemetry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly process telemetry: mean value and k per event type as P1..P4 signals, one file per day."""
    ev = event_rows(spark, sf_dir).withColumn("time", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    kinds = {"P1": "click", "P2": "view", "P3": "purchase", "P4": "signup"}
    severe = (F.col("event_type") == "error") & (F.col("value") >= 150)
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    hourly = ev.groupBy("time").agg(
        *[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(f"{p}_value") for p, t in kinds.items()],
        *[F.avg(F.when(F.col("event_type") == t, F.col("k"))).alias(f"{p}_k") for p, t in kinds.items()],
        flag(severe).alias("attack"),
        *[flag(severe & (F.col("k") % 3 == i)).alias(f"attack_P{i + 1}") for i in range(3)],
    )
    return hourly.select(
        "time", *[f"{p}_{s}" for s in ("value", "k") for p in kinds], "attack", "attack_P1", "attack_P2", "attack_P3",
        F.date_format("time", "yyyy-MM-dd").alias("source_file"), F.date_format("time", "yyyy-MM-dd HH").alias("row_id"),
    )


# ---- source-shaped tables for the harmonisers ----

ATTACK_SPELLINGS = [*V.KDD_TAXONOMY, "zeroday", "unseen"]


def kdd_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection records in positional layout; names carry stray blanks and capitals."""
    ev = event_rows(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in ATTACK_SPELLINGS])
    name = F.element_at(names, (F.col("event_id") % len(ATTACK_SPELLINGS) + 1).cast("int"))
    protocols = F.array(*[F.lit(p) for p in ("tcp", "UDP", "icmp", "gre")])
    filled = {
        "duration": F.col("value"), "src_bytes": F.col("k") * 10.0, "dst_bytes": F.col("value") * 2,
        "count": F.col("k").cast("double"), "srv_count": (F.col("k") % 7).cast("double"),
        "dst_host_count": F.col("user_id").cast("double"), "dst_host_srv_count": (F.col("user_id") % 50).cast("double"),
        "same_srv_rate": F.col("k") / 100.0, "diff_srv_rate": F.lit(1.0) - F.col("k") / 100.0,
        "serror_rate": F.col("value") / 1000.0, "rerror_rate": F.col("value") / 500.0, "srv_serror_rate": F.col("value") / 250.0,
        "protocol_type": F.element_at(protocols, F.col("k") % 4 + 1), "service": F.lit("http"), "flag": F.lit("SF"),
        "attack_type": F.when(F.col("k") % 5 == 0, F.concat(F.lit(" "), F.upper(name))).otherwise(name),
    }
    return ev.select(*[filled.get(c, F.lit(0.0)).alias(c) for c in V.KDD_COLUMNS], F.col("event_id").cast("string").alias("row_id"))


def cic_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-meter rows with stray blanks in the header."""
    ev = event_rows(spark, sf_dir)
    return ev.select(
        F.col("value").alias(" Flow Duration"), F.col("k").cast("double").alias(" Total Fwd Packets"),
        (F.col("k") % 7).cast("double").alias(" Total Backward Packets"), (F.col("value") * 3).alias("Total Length of Fwd Packets"),
        (F.col("value") / 2).alias(" Fwd Packet Length Mean"), (F.col("value") / 4).alias(" Fwd Packet Length Std"),
        (F.col("value") + F.col("k")).alias(" Flow IAT Mean"), (F.col("k") / 10.0).alias(" Flow IAT Std"),
        F.col("user_id").cast("double").alias(" Destination Port"),
        F.when(F.col("event_type") == "error", "DDoS").when(F.col("event_type") == "click", " benign ").otherwise("BENIGN").alias(" Label"),
        F.col("event_id").cast("string").alias("row_id"),
    )


def rt_iot_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_rows(spark, sf_dir)
    return ev.select(
        F.col("value").alias("flow_duration"), F.col("k").cast("double").alias("fwd_pkts_tot"), (F.col("k") % 7).cast("double").alias("bwd_pkts_tot"),
        (F.col("k") % 5).cast("double").alias("fwd_data_pkts_tot"), (F.col("value") / 2).alias("flow_pkts_payload.mean"),
        (F.col("value") / 4).alias("flow_pkts_payload.std"), (F.col("value") + F.col("k")).alias("flow_iat.mean"),
        (F.col("k") / 10.0).alias("flow_iat.std"),
        F.when(F.col("event_type") == "error", "DOS_SYN_Hping").otherwise("Normal").alias("Attack_type"),
        F.col("event_id").cast("string").alias("row_id"),
    )


def unsw_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = flow_lineitem(spark, sf_dir)
    return li.select(
        F.col("quantity").alias("rate"), F.col("extendedprice").alias("sbytes"), (F.col("extendedprice") / 2).alias("dbytes"),
        F.col("discount").alias("sinpkt"), F.col("tax").alias("dur"), "label", "attack_cat", "row_id",
    )


def orders_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of unknown layout: capitals and blanks in names, text label in 'Class'."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_totalprice").alias("Total Price"), F.col("o_custkey").alias("Cust Key"),
        F.when(F.col("o_orderstatus") == "F", " Normal").when(F.col("o_orderstatus") == "O", "BENIGN").otherwise(F.col("o_orderpriority")).alias("Class"),
    )


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow rows with text numbers, infinities, NaN and nulls, for the cleaning operators."""
    ev = event_rows(spark, sf_dir)
    inf = F.lit(float("inf"))
    return ev.select(
        F.col("event_id").cast("string").alias("row_id"), "event_id",
        F.when(F.col("k") % 10 == 0, "n/a").otherwise(F.col("k").cast("string")).alias("burst_length"),
        F.when(F.col("k") % 11 == 0, inf).when(F.col("k") % 13 == 0, -inf).when(F.col("k") % 17 == 0, F.lit(float("nan")))
        .when(F.col("k") % 19 == 0, None).otherwise(F.col("value")).alias("byte_rate"),
        F.lit(None).cast("double").alias("port_diversity"),
    )



