"""Update-then-score profiles over history: the batch form of the online profile.

Every row first enters its device's rolling buffer, then is scored against the
updated statistics. A device's rows form one bounded group; devices above the
row limit are cut into time chunks with enough preceding rows for the rolling
buffer and for the exponential tail to fade below double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telvane.operators.series import IS_HALO, in_chunks, with_series_columns
from telvane.schema import OnlinePreset

ORDER = ["ts", "row_id"]
SLAB = 2048


def rolling_statistics(df: DataFrame, features: list[str], device: str = "device_id", order: list[str] = ORDER,
                       preset: OnlinePreset = OnlinePreset(), max_rows: int | None = None) -> DataFrame:
    """Rolling-buffer mean and floored population std per feature, null before ``min_mean`` rows."""

    def build(w) -> dict[str, Column]:
        frame = w.rowsBetween(-(preset.window - 1), 0)
        ready = F.count(F.lit(1)).over(frame) >= preset.min_mean
        out = {}
        for f in features:
            out[f"roll_mean_{f}"] = F.when(ready, F.avg(f).over(frame))
            out[f"roll_std_{f}"] = F.when(ready, F.stddev_pop(f).over(frame) + F.lit(preset.std_floor))
        return out

    return with_series_columns(df, device, order, preset.window - 1, build, max_rows)


def halo_rows(preset: OnlinePreset) -> int:
    """Rows before a chunk that still matter: the buffer, plus the EWMA tail down to 1e-16."""
    return preset.window - 1 + math.ceil(math.log(1e-16) / math.log(1.0 - preset.alpha))


def online_scores(df: DataFrame, features: list[str], device: str = "device_id", order: list[str] = ORDER,
                  preset: OnlinePreset = OnlinePreset(), z: str = "deviation_zscore_mean",
                  maha: str = "mahalanobis_dist", max_rows: int | None = None) -> DataFrame:
    """Append the update-then-score deviations and ``is_warm`` to every row."""
    chunked = in_chunks(df, device, order, halo_rows(preset), max_rows or 200_000)
    schema = T.StructType(
        [*chunked.df.schema.fields, T.StructField(z, T.DoubleType()), T.StructField(maha, T.DoubleType()),
         T.StructField("is_warm", T.BooleanType())]
    )

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        x = pdf[features].to_numpy(dtype=float)
        mean, std = smoothed_statistics(x, preset)
        known = ~np.isnan(mean[:, 0])
        zs = np.where(known, np.mean(np.abs((x - mean) / (std + 1e-8)), axis=1), 0.0)
        warm = np.minimum(np.arange(1, len(x) + 1), preset.window) >= preset.min_cov
        if IS_HALO in pdf.columns:
            warm = warm | (~pdf[IS_HALO].to_numpy() & bool(pdf[IS_HALO].any()))
        pdf[z], pdf[maha], pdf["is_warm"] = zs, rolling_distance(x, mean, preset), warm
        return pdf

    return chunked.finish(chunked.df.groupBy(*chunked.keys).applyInPandas(block, schema))


def smoothed_statistics(x: np.ndarray, preset: OnlinePreset) -> tuple[np.ndarray, np.ndarray]:
    """EWMA of the rolling mean and of the floored rolling std; NaN before ``min_mean`` rows."""
    rolling = pd.DataFrame(x).rolling(preset.window, min_periods=preset.min_mean)
    smooth = lambda frame: frame.ewm(alpha=preset.alpha, adjust=False).mean().to_numpy()
    return smooth(rolling.mean()), smooth(rolling.std(ddof=0) + preset.std_floor)


def rolling_distance(x: np.ndarray, mean: np.ndarray, preset: OnlinePreset, points: np.ndarray | None = None,
                     at: np.ndarray | None = None) -> np.ndarray:
    """Mahalanobis distance of points to the smoothed mean under the rolling covariance; 0 while cold.

    Point i is measured against the buffer that ends with row ``at[i]`` of ``x``
    (-1: no row yet); by default every row is its own point.
    """
    points, at = (x, np.arange(len(x))) if points is None else (points, at)
    n, d = x.shape
    out = np.zeros(len(points))
    for start in range(0, n, SLAB):
        stop, first = min(start + SLAB, n), max(0, start - preset.window + 1)
        here = np.nonzero((at >= start) & (at < stop))[0]
        rows = np.unique(at[here])
        rows = rows[np.minimum(rows + 1, preset.window) >= preset.min_cov]
        if not len(rows):
            continue
        part = x[first:stop] - x[first:stop].mean(axis=0)
        sums = np.vstack([np.zeros(d), np.cumsum(part, axis=0)])
        squares = np.concatenate([np.zeros((1, d, d)), np.cumsum(part[:, :, None] * part[:, None, :], axis=0)])
        ends = rows - first + 1
        begins = np.maximum(ends - preset.window, 0)
        size = (ends - begins).astype(float)[:, None, None]
        s, c = sums[ends] - sums[begins], squares[ends] - squares[begins]
        cov = (c - s[:, :, None] * s[:, None, :] / size) / (size - 1) + np.eye(d) * preset.ridge
        inverse = np.linalg.pinv(cov, rcond=d * np.finfo(float).eps, hermitian=True)
        here = here[np.isin(at[here], rows)]
        which = np.searchsorted(rows, at[here])
        diff = points[here] - mean[at[here]]
        out[here] = np.sqrt(np.maximum(np.einsum("ni,nij,nj->n", diff, inverse[which], diff), 0.0))
    return out


def fit_devices(df: DataFrame, features: list[str], device: str = "device_id", order: list[str] = ORDER,
                preset: OnlinePreset = OnlinePreset()) -> DataFrame:
    """State of every device after its history: rows seen, smoothed mean/std, buffer covariance, warm flag.

    Only the last rows matter (the buffer and the fading tail), so each device
    contributes a bounded tail, extracted in two salted rounds.
    """
    from telvane.operators.series import last_rows

    tail_rows = halo_rows(preset) + 1
    seen = df.groupBy(device).agg(F.count(F.lit(1)).alias("n_updates"))
    tail = last_rows(df.select(device, *order, *features), [device], order, tail_rows)
    device_type = dict(df.dtypes)[device]
    schema = f"{device} {device_type}, mean array<double>, std array<double>, cov array<array<double>>, is_warm boolean"

    def state(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r", ascending=False)
        x = pdf[features].to_numpy(dtype=float)
        mean, std = smoothed_statistics(x, preset)
        buffer = x[-preset.window:]
        warm = len(buffer) >= preset.min_cov
        d = x.shape[1]
        cov = (np.cov(buffer.T).reshape(d, d) + np.eye(d) * preset.ridge).tolist() if warm else None
        ready = len(buffer) >= preset.min_mean
        return pd.DataFrame([{
            device: pdf[device].iloc[0], "mean": mean[-1].tolist() if ready else None,
            "std": std[-1].tolist() if ready else None, "cov": cov, "is_warm": warm,
        }])

    return tail.groupBy(device).applyInPandas(state, schema).join(seen, device)
