"""Confusion counts and the rates derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telvane.functions.scalars import col, ratio

COUNTS = ["tp", "fp", "tn", "fn"]


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def confusion_counts(label="label", flagged: Column | str = "flagged") -> list[Column]:
    """Four aggregates for a boolean prediction."""
    attack, flagged = col(label) == 1, col(flagged)
    return [
        count_where(attack & flagged).alias("tp"),
        count_where(~attack & flagged).alias("fp"),
        count_where(~attack & ~flagged).alias("tn"),
        count_where(attack & ~flagged).alias("fn"),
    ]


def precision(tp="tp", fp="fp") -> Column:
    return ratio(col(tp), col(tp) + col(fp))


def recall(tp="tp", fn="fn") -> Column:
    return ratio(col(tp), col(tp) + col(fn))


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    return ratio(2 * col(tp), 2 * col(tp) + col(fp) + col(fn))


def false_positive_rate(fp="fp", tn="tn") -> Column:
    return ratio(col(fp), col(fp) + col(tn))


def false_negative_rate(fn="fn", tp="tp") -> Column:
    return ratio(col(fn), col(fn) + col(tp))


def rates(digits: int | None = 4) -> dict[str, Column]:
    """precision, recall, f1, fpr and fnr of a row holding tp/fp/tn/fn."""
    out = {
        "precision": precision(),
        "recall": recall(),
        "f1": f1(),
        "fpr": false_positive_rate(),
        "fnr": false_negative_rate(),
    }
    return out if digits is None else {name: F.round(c, digits) for name, c in out.items()}
