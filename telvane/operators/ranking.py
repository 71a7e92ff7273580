"""Exact ranking metrics and empirical ranks, on counts per distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telvane.functions.scalars import col, ratio
from telvane.operators.buckets import ROWS_PER_BUCKET, bucketed
from telvane.session import settle


def score_counts(df: DataFrame, slices: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives per slice and distinct score; combines in the map tasks."""
    # rows without a label or a score count nowhere, as in the confusion counts
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*slices, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("long").alias("neg"),
    )


def ranking_metrics(
    df: DataFrame,
    slices: list[str] | None = None,
    score: str = "score",
    label: str = "label",
    digits: int | None = 4,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """ROC-AUC (ties count half) and step-wise average precision per slice; 0 with one class only."""
    slices = slices or []
    cut = bucketed(
        score_counts(df, slices, score, label), slices, "score", {"tp": "pos", "fp": "neg"}, rows_per_bucket, descending=True
    )
    # Above a score lie tp-pos positives; each of its negatives loses to them and ties with its positives.
    parts = cut.groupBy(*slices).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos")).cast("double") + F.col("neg") * F.col("pos") * F.lit(0.5)).alias("wins"),
        F.sum(ratio(F.col("pos") * F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).alias("area"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    auc = F.when(both, ratio(F.col("wins"), F.col("p").cast("double") * F.col("n"))).otherwise(0.0)
    ap = F.when(both, ratio(F.col("area"), F.col("p"))).otherwise(0.0)
    if digits is not None:
        auc, ap = F.round(auc, digits), F.round(ap, digits)
    return parts.select(*slices, auc.alias("roc_auc"), ap.alias("avg_precision"))


def empirical_rank(
    df: DataFrame, score: str, reference: Column, out: str, rows_per_bucket: int | None = None
) -> DataFrame:
    """Share of the reference rows whose score is <= the row's score (right side: ties count).

    ``reference`` marks the reference rows of ``df``. Works on one row per distinct score. Rows without a score have
    no rank and count nowhere. Up to ``rows_per_bucket`` distinct scores are joined back by broadcast; beyond, only
    the scores that hold a thousandth of the rows or more are (at most a thousand), and the others by shuffle.
    """
    value = F.col(score).cast("double")
    per_score = df.groupBy(value.alias("__score")).agg(
        F.sum(F.when(reference, 1).otherwise(0)).cast("long").alias("__ref"), F.count(F.lit(1)).alias("__rows")
    )
    ranked = settle(bucketed(per_score, [], "__score", {"__through": "__ref"}, rows_per_bucket), "ranks")
    sizes = ranked.agg(F.coalesce(F.sum("__ref"), F.lit(0)).alias("ref"), F.coalesce(F.sum("__rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("scores")).first()
    share = ranked.select("__score", "__rows", (F.col("__through") / F.lit(float(max(sizes["ref"], 1)))).alias("__share"))
    scored = df.withColumn("__score", value)
    if sizes["scores"] <= (rows_per_bucket or ROWS_PER_BUCKET):
        return scored.join(F.broadcast(share), "__score", "left").withColumn(out, F.col("__share")).drop("__score", "__rows", "__share")
    hot = share.filter(F.col("__rows") * 1000 >= sizes["rows"])
    often = scored.join(F.broadcast(hot), "__score")
    rest = scored.join(F.broadcast(hot.select("__score")), "__score", "left_anti").join(share, "__score", "left")
    return often.unionByName(rest).withColumn(out, F.col("__share")).drop("__score", "__rows", "__share")


def search_best(df: DataFrame, objective: str, order: str, slices: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The row with the largest objective, the smallest ``order`` on ties, per slice; a plain aggregate."""
    keep = keep or [c for c in df.columns if c not in (slices or [])]
    best = F.max_by(F.struct(*keep), F.struct(col(objective), -col(order))).alias("__best")
    return df.groupBy(*(slices or [])).agg(best).select(*(slices or []), *[F.col(f"__best.{c}").alias(c) for c in keep])
