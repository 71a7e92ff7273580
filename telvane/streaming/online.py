"""Online device profiles as a stateful stream: every row updates its device's state, then is scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telvane.operators.online_profile import rolling_distance
from telvane.schema import OnlinePreset

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PIECE = 8192  # rows of a device scored at once
STATE = "seen bigint, buffer array<double>, mean array<double>, std array<double>"


def advance(state: tuple | None, x: np.ndarray, learn: np.ndarray, preset: OnlinePreset) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """Next state and the deviations (mean |z|, Mahalanobis, warm) of the rows of one device, in order.

    ``state`` is (rows learned, buffer rows, smoothed mean, smoothed std). Rows
    with ``learn`` false are scored against the state as it stands.
    """
    d = x.shape[1]
    seen, flat, mean0, std0 = state if state is not None else (0, [], None, None)
    buffer = np.asarray(flat, dtype=float).reshape(-1, d)
    old, new = len(buffer), x[learn]
    rows = np.vstack([buffer, new])
    rolling = pd.DataFrame(rows).rolling(preset.window, min_periods=preset.min_mean)
    means, stds = rolling.mean().to_numpy()[old:], rolling.std(ddof=0).to_numpy()[old:] + preset.std_floor

    def smooth(values: np.ndarray, before) -> np.ndarray:
        head = [] if before is None else [np.asarray(before, dtype=float)]
        out = pd.DataFrame(np.vstack([*head, values])).ewm(alpha=preset.alpha, adjust=False).mean().to_numpy()
        return out[len(head):]

    nothing = np.full((1, d), np.nan)
    first_mean = nothing if mean0 is None else np.asarray(mean0, dtype=float)[None, :]
    first_std = nothing if std0 is None else np.asarray(std0, dtype=float)[None, :]
    mean_path = np.vstack([first_mean, smooth(means, mean0)]) if len(new) else first_mean
    std_path = np.vstack([first_std, smooth(stds, std0)]) if len(new) else first_std
    at = np.cumsum(learn)  # how many new rows were learned when row i is scored
    center, spread = mean_path[at], std_path[at]
    z = np.where(np.isnan(center[:, 0]), 0.0, np.mean(np.abs((x - center) / (spread + 1e-8)), axis=1))
    padded = np.vstack([np.full((max(old - 1, 0), d), np.nan), mean_path]) if old else mean_path[1:]
    maha = rolling_distance(rows, padded, preset, x, old + at - 1) if len(rows) else np.zeros(len(x))
    warm = np.minimum(old + at, preset.window) >= preset.min_cov
    ready = not np.isnan(mean_path[-1][0])
    after = (seen + int(learn.sum()), rows[-preset.window:].ravel().tolist(),
             mean_path[-1].tolist() if ready else None, std_path[-1].tolist() if ready else None)
    return after, z, maha, warm


class OnlineProfile(StatefulProcessor):
    """Keeps the last rows and smoothed statistics of a device; rows of a micro-batch are taken in event order."""

    def __init__(self, features: list[str], order: list[str], columns: list[str], learn: str, preset: OnlinePreset, ttl_ms: int | None):
        self.features, self.order, self.columns = features, order, columns
        self.learn, self.preset, self.ttl_ms = learn, preset, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("profile", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, ignore_index=True)
        learn = np.ones(len(pdf), dtype=bool)
        if self.learn == "normal" and "label" in pdf.columns:
            learn = (pdf["label"].isna() | (pdf["label"] == 0)).to_numpy()
        state = tuple(self.state.get()) if self.state.exists() else None
        # Rows are held once; what is worked out from them, and what leaves, is a piece at a time.
        for a in range(0, len(pdf), PIECE):
            out = pdf[self.columns].iloc[a : a + PIECE].copy()
            x = pdf[self.features].iloc[a : a + PIECE].to_numpy(dtype=float)
            state, out["deviation_zscore_mean"], out["mahalanobis_dist"], out["is_warm"] = advance(state, x, learn[a : a + PIECE], self.preset)
            yield out
        self.state.update(state)

    def close(self) -> None:
        pass


def online_stream(stream: DataFrame, features: list[str], device: str = "device_id", order: list[str] = ("ts", "row_id"),
                  learn: str = "normal", preset: OnlinePreset = OnlinePreset(), idle_hours: int | None = None) -> DataFrame:
    """Score a stream against per-device state kept in RocksDB; idle devices can expire.

    ``learn`` = "normal" keeps rows labelled as attacks out of the profile; "all" learns every row. The session must
    keep its state stores in RocksDB (``ROCKSDB`` as provider class), and one device's rows of a micro-batch fit a task.
    """
    if stream.sparkSession.conf.get(PROVIDER) != ROCKSDB:
        raise RuntimeError(f"set {PROVIDER} to {ROCKSDB}")
    schema = T.StructType([
        *stream.schema.fields, T.StructField("deviation_zscore_mean", T.DoubleType()),
        T.StructField("mahalanobis_dist", T.DoubleType()), T.StructField("is_warm", T.BooleanType()),
    ])
    processor = OnlineProfile(list(features), list(order), stream.columns, learn, preset, idle_hours * 3_600_000 if idle_hours else None)
    mode = "ProcessingTime" if idle_hours else "None"
    return stream.groupBy(device).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)
