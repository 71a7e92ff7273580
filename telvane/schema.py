"""The unified flow schema and the named presets every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Feature names of the unified flow table, by group.
FEATURE_GROUPS: dict[str, list[str]] = {
    "traffic_volume": ["packet_rate", "byte_rate", "burst_length", "inter_arrival_time"],
    "connection_behavior": ["conn_frequency", "unique_dst_ips", "port_diversity", "protocol_distribution"],
    "session_level": ["response_time", "session_duration", "payload_size_mean", "payload_size_std"],
    "temporal": ["time_of_day", "day_of_week"],
}

FEATURES: list[str] = [name for group in FEATURE_GROUPS.values() for name in group]
CYCLIC = {"time_of_day": ("time", 24), "day_of_week": ("day", 7)}
MODEL_FEATURES: list[str] = [f for f in FEATURES if f not in CYCLIC] + [
    f"{prefix}_{wave}" for prefix, _ in CYCLIC.values() for wave in ("sin", "cos")
]
PROFILE_FEATURES = ["profile_zscore_mean", "profile_mahalanobis"]

UNIFIED_SCHEMA = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in FEATURES]
    + [
        T.StructField("label", T.IntegerType()),
        T.StructField("attack_cat", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

GLOBAL_PROFILE = "__GLOBAL__"
SEED = 42


@dataclass(frozen=True)
class ThresholdPreset:
    """Constants of the context-adaptive threshold."""

    tau_base: float = 0.5
    beta_load: float = 0.05
    beta_risk: float = 0.025
    beta_time: float = 0.025
    margin: float = 0.15
    low: float = 0.1
    high: float = 0.9


# Device risk by device type, for live alerting and for offline experiments.
DEVICE_RISK_ONLINE = {
    "sensor": 0.3,
    "actuator": 0.5,
    "camera": 0.6,
    "gateway": 0.9,
    "controller": 1.0,
    "unknown": 0.5,
}
DEVICE_RISK_SUITE = {
    "gateway": 1.0,
    "camera": 0.6,
    "controller": 0.9,
    "sensor": 0.3,
    "actuator": 0.5,
}

ONLINE = ThresholdPreset()
SUITE = ThresholdPreset(low=0.01, high=0.99)


@dataclass(frozen=True)
class ProfilePreset:
    """Constants of the frozen per-device profile."""

    alpha: float = 0.10
    window: int = 100
    warm_up: int = 50
    ridge: float = 1e-5
    std_floor: float = 1e-8


@dataclass(frozen=True)
class OnlinePreset:
    """Constants of the online (update-then-score) profile."""

    alpha: float = 0.1
    window: int = 100
    min_mean: int = 10
    min_cov: int = 20
    ridge: float = 1e-6
    std_floor: float = 1e-8
