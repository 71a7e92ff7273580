"""Frozen behavioural profiles: per-device statistics of the last normal rows, and deviation scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telvane.functions.scalars import total
from telvane.operators.series import last_rows
from telvane.schema import GLOBAL_PROFILE, PROFILE_FEATURES, ProfilePreset
from telvane.session import settle

ORDER = ["ts", "row_id"]
MODES = ("none", "zscore", "mahalanobis", "both")
BROADCAST_BYTES = 64 * 1024 * 1024


def ewma_weights_sum(x: Column, alpha: Column | float) -> Column:
    """Sum of alpha*(1-alpha)^r * x, with r counted from the newest row."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return F.sum(a * F.pow(F.lit(1.0) - a, F.col("r")) * x)


def profile_statistics(tail: DataFrame, keys: list[str], features: list[str], alpha, preset: ProfilePreset) -> DataFrame:
    """n, EWMA mean and floored population std per key from rows numbered ``r`` (0 = newest).

    The recursive EWMA seeded by the oldest row unrolls to fixed weights, so it
    is one ordinary aggregate: every row weighs alpha*(1-alpha)^r, and the
    oldest gets a further (1-alpha)^n.
    """
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    seed = F.pow(F.lit(1.0) - F.first(a), F.count(F.lit(1)))
    oldest = F.max_by(F.array(*features), F.col("r"))
    return tail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[ewma_weights_sum(F.col(f), alpha) + seed * oldest[i] for i, f in enumerate(features)]).alias("mean"),
        F.array(*[F.stddev_pop(f) + F.lit(preset.std_floor) for f in features]).alias("std"),
        F.collect_list(F.array(*features)).alias("rows"),
    )


def inverse_covariance(data: np.ndarray, ridge: float) -> np.ndarray:
    """Pseudo-inverse of sample covariance plus a ridge; the identity for a single row."""
    d = data.shape[1]
    cov = np.cov(data.T).reshape(d, d) + np.eye(d) * ridge if len(data) >= 2 else np.eye(d)
    return np.linalg.pinv(cov, rcond=d * np.finfo(float).eps, hermitian=True)


def inverse_covariance_column(rows: str, ridge: float) -> Column:
    """Inverse covariance of every profile's collected rows (at most ``window`` rows each)."""

    @F.pandas_udf("array<array<double>>")
    def invert(batch: pd.Series) -> pd.Series:
        return pd.Series([inverse_covariance(np.stack([np.asarray(v, dtype=float) for v in r]), ridge).tolist() for r in batch])

    return invert(F.col(rows))


def normal_tail(df: DataFrame, features: list[str], window: int, device: str = "device_id", label: str = "label",
                order: list[str] = ORDER) -> DataFrame:
    """The last ``window`` normal rows per device, numbered from the newest."""
    normal = df.filter(F.col(label) == 0).select(device, *order, *features)
    return last_rows(normal, [device], order, window)


def overall_tail(df: DataFrame, features: list[str], window: int, label: str = "label", order: list[str] = ORDER) -> DataFrame:
    """The last ``window`` normal rows of the whole table (a top-k, no full sort)."""
    newest = [F.col(c).desc() for c in order]
    top = df.filter(F.col(label) == 0).select(*order, *features).orderBy(*newest).limit(window)
    return top.withColumn("r", F.row_number().over(Window.orderBy(*newest)) - 1)  # at most `window` rows


@dataclass
class FrozenProfiles:
    """A profile table (one row per warm device) and the fallback for every other device."""

    table: DataFrame
    fallback: dict
    features: list[str]
    preset: ProfilePreset = field(default_factory=ProfilePreset)
    per_device: bool = True
    device: str = "device_id"
    mode: str = "both"

    @classmethod
    def fit(
        cls, train: DataFrame, features: list[str], preset: ProfilePreset = ProfilePreset(), device: str = "device_id",
        label: str = "label", order: list[str] = ORDER, per_device: bool = True, mode: str = "both",
    ) -> FrozenProfiles:
        """Profiles from normal training rows.

        A device is warm when its rows *after* truncation to the window reach
        ``warm_up``; with warm_up > window no device is, and all use the fallback.
        """
        parts = overall_tail(train, features, preset.window, label, order)
        whole = cls._finish(
            profile_statistics(parts.withColumn(device, F.lit(GLOBAL_PROFILE)), [device], features, preset.alpha, preset),
            preset, mode,
        )
        fallback = whole.first().asDict()
        if per_device:
            tail = normal_tail(train, features, preset.window, device, label, order)
            stats = profile_statistics(tail, [device], features, preset.alpha, preset).filter(F.col("n") >= preset.warm_up)
            table = settle(cls._finish(stats, preset, mode), "profiles")
        else:
            table = whole.limit(0)
        return cls(table, fallback, features, preset, per_device, device, mode)

    @staticmethod
    def _finish(stats: DataFrame, preset: ProfilePreset, mode: str) -> DataFrame:
        if mode in ("mahalanobis", "both"):
            stats = stats.withColumn("cov_inv", inverse_covariance_column("rows", preset.ridge))
        else:
            stats = stats.withColumn("cov_inv", F.lit(None).cast("array<array<double>>"))
        return stats.drop("rows")

    def with_fallback(self) -> DataFrame:
        """The profile table including the fallback as its ``__GLOBAL__`` row."""
        one = self.table.sparkSession.createDataFrame([self.fallback], self.table.schema)
        return self.table.unionByName(one)

    def save(self, path: str) -> None:
        self.with_fallback().write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, df: DataFrame, features: list[str], preset: ProfilePreset = ProfilePreset(), per_device: bool = True,
             mode: str = "both", device: str = "device_id") -> FrozenProfiles:
        fallback = df.filter(F.col(device) == GLOBAL_PROFILE).first().asDict()
        return cls(df.filter(F.col(device) != GLOBAL_PROFILE), fallback, features, preset, per_device, device, mode)

    # -- scoring --

    def small(self) -> bool:
        """Whether the counted profile table is small enough to broadcast."""
        d = len(self.features)
        return self.table.count() * (2 * d + d * d) * 8 <= BROADCAST_BYTES

    def _matched(self, df: DataFrame, small: bool) -> DataFrame:
        cells = ["mean", "std", "cov_inv"] if not small else ["mean", "std"]
        side = self.table.select(self.device, *[F.col(c).alias(f"__{c}") for c in cells])
        joined = df.join(F.broadcast(side) if small else side, self.device, "left") if self.per_device else df
        for c in cells:
            known = F.col(f"__{c}") if self.per_device else F.lit(None)
            joined = joined.withColumn(f"__{c}", F.coalesce(known, _literal(self.fallback[c])))
        return joined

    def zscore(self) -> Column:
        terms = [F.abs((F.col(f) - F.col("__mean")[i]) / F.col("__std")[i]) for i, f in enumerate(self.features)]
        return total(terms) / F.lit(float(len(terms)))

    def score(self, df: DataFrame, z: str | None = "z", maha: str | None = "maha") -> DataFrame:
        """Append the mean |z| and/or the Mahalanobis distance of each row to its profile."""
        small = self.small()
        out = self._matched(df, small or not maha)
        if z:
            out = out.withColumn(z, self.zscore())
        if maha:
            out = out.withColumn(maha, self._python_distance(out) if small else array_distance(self.features))
        return out.drop("__mean", "__std", "__cov_inv")

    def _python_distance(self, df: DataFrame) -> Column:
        """Vectorised quadratic form; the size-checked profiles travel to the workers once."""
        rows = self.table.select(self.device, "mean", "cov_inv").collect() if self.per_device else []
        index = {r[self.device]: i + 1 for i, r in enumerate(rows)}
        means = np.array([self.fallback["mean"]] + [r["mean"] for r in rows])
        inverses = np.array([self.fallback["cov_inv"]] + [r["cov_inv"] for r in rows])
        shared = df.sparkSession.sparkContext.broadcast((index, means, inverses))

        @F.pandas_udf("double")
        def distance(device: pd.Series, x: pd.DataFrame) -> pd.Series:
            index, means, inverses = shared.value
            at = device.map(index).fillna(0).to_numpy(dtype=int)
            diff = x.to_numpy(dtype=float) - means[at]
            out = np.empty(len(at))
            for part in np.array_split(np.arange(len(at)), max(1, len(at) // 4096)):
                half = np.matmul(inverses[at[part]], diff[part][:, :, None])[:, :, 0]
                out[part] = np.sqrt(np.maximum(np.sum(diff[part] * half, axis=1), 0.0))
            return pd.Series(out)

        return distance(F.col(self.device), F.struct(*self.features))

    def augment(self, df: DataFrame, mode: str | None = None) -> tuple[DataFrame, list[str]]:
        """Rows plus the profile features of the chosen mode, and the resulting feature list."""
        mode = mode or self.mode
        if mode not in MODES:
            raise ValueError(f"unknown profile mode: {mode}")
        if mode == "none":
            return df, list(self.features)
        z = PROFILE_FEATURES[0] if mode in ("zscore", "both") else None
        m = PROFILE_FEATURES[1] if mode in ("mahalanobis", "both") else None
        return self.score(df, z, m), [*self.features, *[c for c in (z, m) if c]]


def array_distance(features: list[str]) -> Column:
    """Quadratic form over the ``__mean`` and ``__cov_inv`` arrays of a row."""
    diff = F.array(*[F.col(f) - F.col("__mean")[i] for i, f in enumerate(features)])
    zero = F.lit(0.0)
    inner = lambda row: F.aggregate(F.zip_with(row, diff, lambda p, x: p * x), zero, lambda a, b: a + b)
    quad = F.aggregate(F.zip_with(F.col("__cov_inv"), diff, lambda row, x: inner(row) * x), zero, lambda a, b: a + b)
    return F.sqrt(F.greatest(quad, zero))


def _literal(value) -> Column:
    if value is None:
        return F.lit(None)
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value])
    return F.lit(float(value))


# The one-at-a-time settings of the profile sensitivity study.
SENSITIVITY = (
    [("alpha", v, ProfilePreset(alpha=v)) for v in (0.05, 0.10, 0.15, 0.20, 0.30)]
    + [("window_size", v, ProfilePreset(window=v)) for v in (25, 50, 100, 150, 200)]
    + [("warm_up", v, ProfilePreset(warm_up=v)) for v in (10, 20, 50, 100, 150)]
)


def sensitivity_tails(train: DataFrame, features: list[str], device: str = "device_id", label: str = "label",
                      order: list[str] = ORDER, settings=SENSITIVITY) -> tuple[DataFrame, DataFrame]:
    """Tails for all settings from one extraction of the longest window: (per device, overall).

    Both carry ``config`` (position in ``settings``), ``alpha`` and ``warm_up``.
    """
    longest = max(p.window for _, _, p in settings)
    grid = F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("config"), F.lit(p.alpha).alias("alpha"), F.lit(p.window).alias("window"),
                     F.lit(p.warm_up).alias("warm_up"))
            for i, (_, _, p) in enumerate(settings)
        ])
    )

    def spread(tail: DataFrame) -> DataFrame:
        wide = settle(tail, "tail").withColumn("__g", grid)
        return wide.select("*", "__g.*").drop("__g").filter(F.col("r") < F.col("window"))

    per_device = spread(normal_tail(train, features, longest, device, label, order))
    overall = spread(overall_tail(train, features, longest, label, order).withColumn(device, F.lit(GLOBAL_PROFILE)))
    return per_device, overall


def sensitivity_profiles(train: DataFrame, features: list[str], device: str = "device_id", label: str = "label",
                         order: list[str] = ORDER, settings=SENSITIVITY, mode: str = "zscore") -> DataFrame:
    """Profile rows (config, device, n, mean, std, cov_inv) of every setting, fallback rows included."""
    preset = ProfilePreset()
    per_device, overall = sensitivity_tails(train, features, device, label, order, settings)
    stats = [
        profile_statistics(t, ["config", "warm_up", device], features, F.col("alpha"), preset) for t in (per_device, overall)
    ]
    return FrozenProfiles._finish(stats[0].filter(F.col("n") >= F.col("warm_up")).unionByName(stats[1]), preset, mode)


def sensitivity_scores(df: DataFrame, profiles: DataFrame, features: list[str], device: str = "device_id",
                       z: str = "z", maha: str | None = None, configs: int = len(SENSITIVITY)) -> DataFrame:
    """Deviations of every row under every setting: one join on the device, which brings the profiles of all settings.

    ``profiles`` should be settled. The side of one row per device is broadcast
    if it is counted small, else joined by shuffle.
    """
    cells = ["mean", "std"] + (["cov_inv"] if maha else [])
    held = F.map_from_entries(F.collect_list(F.struct("config", F.struct(*cells).alias("cells"))))  # one entry per setting
    own = profiles.filter(F.col(device) != GLOBAL_PROFILE).groupBy(device).agg(held.alias("__own"))
    rest = profiles.filter(F.col(device) == GLOBAL_PROFILE).agg(held.alias("__rest"))  # one row
    d = len(features)
    small = profiles.count() * (2 * d + (d * d if maha else 0)) * 8 <= BROADCAST_BYTES
    joined = df.join(F.broadcast(own) if small else own, device, "left").join(F.broadcast(rest), how="left")
    each = joined.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(configs - 1))))
    picked = F.coalesce(F.try_element_at("__own", F.col("config")), F.try_element_at("__rest", F.col("config")))
    each = each.withColumn("__p", picked).filter(F.col("__p").isNotNull()).withColumns({f"__{c}": F.col(f"__p.{c}") for c in cells})
    terms = [F.abs((F.col(f) - F.col("__mean")[i]) / F.col("__std")[i]) for i, f in enumerate(features)]
    out = each.withColumn(z, total(terms) / F.lit(float(d)))
    if maha:
        out = out.withColumn(maha, array_distance(features))
    return out.drop("__own", "__rest", "__p", *[f"__{c}" for c in cells])
