"""Context-adaptive threshold expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from telvane.functions.scalars import clip, col, hash_mod
from telvane.schema import DEVICE_RISK_ONLINE, DEVICE_RISK_SUITE, ONLINE, ThresholdPreset


def activity_factor(hour: Column | str) -> Column:
    """Cosine day curve: 1 at noon, 0 at midnight."""
    return clip(F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * (col(hour) - 12) / F.lit(12.0))), 0.0, 1.0)


def adaptive_tau(load, risk, hour, preset: ThresholdPreset = ONLINE, tau_base=None, betas=None) -> Column:
    """tau_base + b1*load - b2*risk - b3*(1 - activity), clipped to the preset's range."""
    base = F.lit(preset.tau_base) if tau_base is None else (F.lit(tau_base) if isinstance(tau_base, float) else tau_base)
    b1, b2, b3 = betas or (preset.beta_load, preset.beta_risk, preset.beta_time)
    tau = base + F.lit(b1) * col(load) - F.lit(b2) * col(risk) - F.lit(b3) * (F.lit(1.0) - activity_factor(hour))
    return clip(tau, preset.low, preset.high)


def alert_level(score, tau, margin: float = ONLINE.margin) -> Column:
    score, tau = col(score), col(tau)
    return F.when(score < tau, "NONE").when(score < tau + F.lit(margin), "WARNING").otherwise("CRITICAL")


def device_risk(device_type, table: dict[str, float] = DEVICE_RISK_ONLINE) -> Column:
    """Risk of a device type, case-insensitive; unlisted types take the 'unknown' risk."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(col(device_type))), F.lit(table.get("unknown", 0.5)))


def pseudo_device_type(device_id, table: dict[str, float] = DEVICE_RISK_SUITE) -> Column:
    """A stable device type for devices without one, by hash of the id."""
    names = F.array(*[F.lit(name) for name in table])
    return F.element_at(names, hash_mod(len(table), device_id) + 1)


def load_proxy(z, p95: float) -> Column:
    """Deviation as a stand-in for network load: z over its 95th percentile, clipped."""
    return clip(col(z) / F.lit(max(p95, 1e-8)), 0.0, 1.0)
