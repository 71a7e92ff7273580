"""Fusing an anomaly score with an attack probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telvane.functions.scalars import clip, col

METHODS = ["weighted_linear", "max", "product", "stacking", "bayesian_reliability", "rank_based"]


def weighted_linear(s_if, p_rf, alpha: float | Column) -> Column:
    a = F.lit(alpha) if isinstance(alpha, float | int) else alpha
    return a * col(s_if) + (F.lit(1.0) - a) * col(p_rf)


def logistic(s_if, p_rf, coefficients: tuple[float, float, float]) -> Column:
    """Stacked probability for (weight of s_if, weight of p_rf, intercept)."""
    w_if, w_rf, intercept = coefficients
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(w_if) * col(s_if) + F.lit(w_rf) * col(p_rf) + F.lit(intercept))))


def fuse(
    s_if="s_if",
    p_rf="p_rf",
    method: str = "weighted_linear",
    alpha: float | Column = 0.45,
    stacker: tuple[float, float, float] | None = None,
    reliability: tuple[float, float] | None = None,
    ranks: tuple[Column | str, Column | str] | None = None,
) -> Column:
    """One fused score in [0, 1].

    ``stacking`` without coefficients falls back to the weighted blend;
    ``rank_based`` blends the two empirical-rank columns given in ``ranks``.
    """
    s, p = clip(s_if, 0.0, 1.0), clip(p_rf, 0.0, 1.0)
    if method == "weighted_linear" or (method == "stacking" and stacker is None):
        out = weighted_linear(s, p, alpha)
    elif method == "max":
        out = F.greatest(s, p)
    elif method == "product":
        out = s * p
    elif method == "stacking":
        out = logistic(s, p, stacker)
    elif method == "bayesian_reliability":
        w_if, w_rf = reliability or (0.5, 0.5)
        out = (F.lit(w_if) * s + F.lit(w_rf) * p) / F.lit(max(w_if + w_rf, 1e-8))
    elif method == "rank_based":
        if ranks is None:
            raise ValueError("rank_based fusion needs two rank columns")
        out = weighted_linear(ranks[0], ranks[1], alpha)
    else:
        raise ValueError(f"unknown fusion method: {method}")
    return clip(out, 0.0, 1.0)
