"""Threshold and weight searches: one pass over the scores, then arithmetic on a few hundred rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telvane.functions import confusion as C
from telvane.functions import fusion
from telvane.functions.context import activity_factor
from telvane.functions.scalars import clip, grid_bin, total
from telvane.operators.ranking import ranking_metrics, search_best
from telvane.schema import SUITE, ThresholdPreset


@dataclass(frozen=True)
class Grid:
    """Thresholds i/steps for i = 1..top."""

    steps: int
    top: int


FINE = Grid(100, 99)     # 0.01 .. 0.99
COARSE = Grid(20, 19)    # 0.05 .. 0.95

# Fusion weights searched by the studies (in hundredths).
ALPHAS_FINE = [i / 20 for i in range(0, 21)]
ALPHAS_JOINT = [i / 20 for i in range(2, 15)]
ALPHAS_COARSE = [i / 10 for i in range(1, 8)]
ALPHAS_MITIGATION = [0.45, 0.40, 0.35, 0.30, 0.25]
ALPHAS_SENSITIVITY = [0.10, 0.20, 0.30, 0.40, 0.45, 0.50, 0.60, 0.70]
TAUS_RAISED = [0.2137, 0.22, 0.23, 0.25, 0.28, 0.30]
BETA_LOAD = [0.05, 0.10, 0.15, 0.20]
BETA_RISK = [0.025, 0.05, 0.10, 0.15]
BETA_TIME = [0.025, 0.05, 0.10, 0.15]

OBJECTIVES = ("f1_small_fpr", "recall_995", "f1_fpr", "f1")


def objective(name: str) -> Column:
    """What a search maximises, over a row of tp/fp/tn/fn."""
    f1, fpr = C.f1(), C.false_positive_rate()
    if name == "f1_small_fpr":
        return f1 - F.lit(0.05) * fpr
    if name == "recall_995":
        return F.when(C.recall() >= 0.995, -fpr).otherwise(C.recall() - F.lit(1.0))
    if name == "f1_fpr":
        return f1 - F.lit(0.3) * fpr
    if name == "f1":
        return f1
    raise ValueError(f"unknown objective: {name}")


def threshold_counts(df: DataFrame, score: str = "score", label: str = "label", grid: Grid = FINE,
                     slices: list[str] | None = None) -> DataFrame:
    """tp/fp/tn/fn at every grid threshold, from one histogram aggregate per slice."""
    slices = slices or []
    hist = (
        df.select(*slices, F.col(label).alias("__y"), grid_bin(score, grid.steps, grid.top).alias("bin"))
        .groupBy(*slices, "bin")
        .agg(C.count_where(F.col("__y") == 1).alias("pos"), C.count_where(F.col("__y") != 1).alias("neg"))
    )
    # From here on at most grid.top + 1 rows per slice.
    whole = hist.groupBy(*slices).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.collect_list(F.struct("bin", "pos", "neg")).alias("bins")
    )
    steps = whole.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(grid.top))))
    above = lambda side: F.aggregate(
        "bins", F.lit(0).cast("long"),
        lambda acc, b: acc + F.when(b["bin"] >= F.col("step"), b[side]).otherwise(F.lit(0).cast("long")),
    )
    counted = steps.withColumn("tp", above("pos")).withColumn("fp", above("neg"))
    return counted.select(
        *slices, "step", (F.col("step") / F.lit(float(grid.steps))).alias("threshold"), "tp", "fp",
        (F.col("N") - F.col("fp")).alias("tn"), (F.col("P") - F.col("tp")).alias("fn"),
    )


def best_threshold(df: DataFrame, score: str = "score", label: str = "label", grid: Grid = FINE,
                   goal: str = "f1_small_fpr", slices: list[str] | None = None) -> DataFrame:
    """The first best threshold per slice with its counts and objective."""
    counted = threshold_counts(df, score, label, grid, slices).withColumn("objective", objective(goal))
    return search_best(counted, "objective", "step", slices)


def best_threshold_value(df: DataFrame, score: str = "score", label: str = "label", grid: Grid = FINE,
                         goal: str = "f1_small_fpr") -> float:
    row = best_threshold(df, score, label, grid, goal).first()
    return round(row["threshold"], 4) if row else 0.5


def top_thresholds(df: DataFrame, score: str = "score", label: str = "label", goal: str = "f1", n: int = 5) -> DataFrame:
    """The n best coarse thresholds; earlier ones first on ties, metrics rounded before ranking."""
    f1, fpr = F.round(C.f1(), 4), F.round(C.false_positive_rate(), 4)
    value = f1 if goal == "f1" else f1 - F.lit(0.3) * fpr
    counted = threshold_counts(df, score, label, COARSE).select("step", "threshold", f1.alias("f1"), fpr.alias("fpr"), value.alias("objective"))
    return counted.orderBy(F.desc("objective"), "step").limit(n)


def _grid_rows(entries: list[Column]) -> Column:
    return F.explode(F.array(*entries))


def alpha_counts(df: DataFrame, alphas: list[float] = ALPHAS_FINE, threshold: float = 0.5, label: str = "label") -> DataFrame:
    """tp/fp/tn/fn of the weighted blend per alpha at one threshold.

    Rows are narrowed to the blended score before they are multiplied, and
    counted per alpha inside the map tasks.
    """
    spread = spread_alphas(df, alphas, [label]).withColumnRenamed("a", "i")
    return spread.groupBy("i", "alpha").agg(*C.confusion_counts(label, F.col("score") >= threshold))


def best_alpha(df: DataFrame, alphas: list[float] = ALPHAS_FINE, threshold: float = 0.5, label: str = "label") -> DataFrame:
    counted = alpha_counts(df, alphas, threshold, label).withColumn("f1", C.f1())
    return search_best(counted, "f1", "i").select("alpha", F.round("f1", 4).alias("f1"))


def spread_alphas(df: DataFrame, alphas: list[float], keep: list[str] = ("label",)) -> DataFrame:
    """One row per (row, alpha) holding only ``keep`` and the blended score."""
    entries = [F.struct(F.lit(i).alias("a"), F.lit(a).alias("alpha"), fusion.fuse("s_if", "p_rf", alpha=a).alias("score"))
               for i, a in enumerate(alphas)]
    return df.select(*keep, _grid_rows(entries).alias("g")).select(*keep, "g.*")


def best_alpha_and_threshold(df: DataFrame, alphas: list[float] = ALPHAS_JOINT, label: str = "label") -> DataFrame:
    """Joint search: per alpha its best fine threshold, then the alpha whose F1 there is largest."""
    scored = spread_alphas(df, alphas, [label])
    per_alpha = best_threshold(scored, "score", label, FINE, "f1_small_fpr", ["a", "alpha"]).withColumn("f1", C.f1())
    return search_best(per_alpha, "f1", "a").select("alpha", "threshold", F.round("f1", 4).alias("f1"))


def compare_methods(df: DataFrame, alpha: float, stacker=None, threshold: float = 0.5, label: str = "label") -> DataFrame:
    """F1, AUC and FPR of each fusion method at one threshold; ``best`` marks the first with the largest F1."""
    methods = ["weighted_linear", "max", "product"] + (["stacking"] if stacker else [])
    scored = stack_methods(df, {m: fusion.fuse("s_if", "p_rf", m, alpha, stacker) for m in methods}, [label])
    counts = scored.groupBy("i", "method").agg(*C.confusion_counts(label, F.col("score") >= threshold))
    ranks = ranking_metrics(scored, ["i", "method"], "score", label)
    first = Window.orderBy(F.desc("f1"), "i")  # one row per method
    return (
        counts.join(ranks, ["i", "method"])
        .select("i", "method", F.round(C.f1(), 4).alias("f1"), "roc_auc", F.round(C.false_positive_rate(), 4).alias("fpr"))
        .withColumn("best", F.row_number().over(first) == 1)
        .drop("i")
    )


def stack_methods(df: DataFrame, scores: dict[str, Column], keep: list[str], name: str = "method") -> DataFrame:
    """Long form: one row per (row, variant) with columns i, name, score."""
    entries = [F.struct(F.lit(i).alias("i"), F.lit(m).alias(name), c.cast("double").alias("score")) for i, (m, c) in enumerate(scores.items())]
    return df.select(*keep, _grid_rows(entries).alias("g")).select(*keep, "g.*")


def beta_counts(df: DataFrame, tau_base: float, preset: ThresholdPreset = SUITE, score: str = "score", label: str = "label",
                betas: tuple[list[float], list[float], list[float]] = (BETA_LOAD, BETA_RISK, BETA_TIME)) -> DataFrame:
    """Counts per (beta1, beta2, beta3) over load, risk and hour columns.

    A larger beta3 never raises the threshold, so the beta3 values that flag a
    row are the largest ones: how many they are says which. Rows are multiplied
    by the (beta1, beta2) pairs only, and counted per pair and that number.
    """
    loads, risks, times = betas
    pairs = [(a, b) for a in loads for b in risks]
    slim = df.select((F.col(label) == 1).alias("y"), F.col(score).alias("s"), "load", "risk",
                     (F.lit(1.0) - activity_factor("hour")).alias("quiet"))
    entries = [F.struct(F.lit(i).alias("i"), (F.lit(tau_base) + F.lit(a) * F.col("load") - F.lit(b) * F.col("risk")).alias("part"))
               for i, (a, b) in enumerate(pairs)]
    spread = slim.select("y", "s", "quiet", _grid_rows(entries).alias("g")).select("y", "s", "quiet", "g.*")
    ordered = sorted(times)
    hits = total([
        F.when(F.col("s") >= clip(F.col("part") - F.lit(c) * F.col("quiet"), preset.low, preset.high), 1).otherwise(0) for c in ordered
    ])
    counted = spread.groupBy("i", hits.alias("hits")).agg(C.count_where(F.col("y")).alias("pos"), C.count_where(~F.col("y")).alias("neg"))
    # From here on: (pairs x values of beta3) rows.
    per_pair = counted.groupBy("i").agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        *[F.sum(F.when(F.col("hits") >= len(ordered) - j, F.col(side))).alias(f"{side}{j}") for j in range(len(ordered)) for side in ("pos", "neg")],
    )
    combos = F.explode(F.array(*[
        F.struct(F.lit(times.index(c)).alias("k"), F.lit(c).alias("beta3"), F.coalesce(F.col(f"pos{j}"), F.lit(0)).alias("tp"),
                 F.coalesce(F.col(f"neg{j}"), F.lit(0)).alias("fp")) for j, c in enumerate(ordered)
    ]))
    of_pair = lambda at: F.element_at(F.array(*[F.lit(p[at]) for p in pairs]), F.col("i") + 1)
    return per_pair.withColumn("g", combos).select(
        (F.col("i") * len(times) + F.col("g.k")).alias("i"), of_pair(0).alias("beta1"), of_pair(1).alias("beta2"), "g.beta3",
        "g.tp", "g.fp", (F.col("N") - F.col("g.fp")).alias("tn"), (F.col("P") - F.col("g.tp")).alias("fn"),
    )


def beta_search(df: DataFrame, tau_base: float, **kwargs) -> DataFrame:
    """Every combination with F1, FPR and loss; ``is_best`` marks the first smallest loss."""
    loss = (F.lit(1.0) - C.f1()) + F.lit(0.25) * C.false_positive_rate()
    scored = beta_counts(df, tau_base, **kwargs).withColumn("loss", loss)
    first = Window.orderBy("loss", "i")  # 64 rows
    return scored.select(
        "beta1", "beta2", "beta3",
        F.round(C.f1(), 4).alias("validation_f1"),
        F.round(C.false_positive_rate(), 4).alias("validation_fpr"),
        F.round("loss", 4).alias("validation_loss"),
        (F.row_number().over(first) == 1).alias("is_best"),
    )


def tau_sweep(df: DataFrame, taus: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """Counts and rates at arbitrary fixed thresholds, from one histogram over them."""
    ordered = sorted(set(taus))
    passed = total([F.when(F.col(score) >= t, 1).otherwise(0) for t in ordered])
    y = F.col(label) == 1
    hist = df.groupBy(passed.alias("bin")).agg(C.count_where(y).alias("pos"), C.count_where(~y).alias("neg"))
    one = hist.agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        *[F.coalesce(F.sum(F.when(F.col("bin") > i, F.col(side))), F.lit(0)).alias(f"{side}{i}") for i in range(len(ordered)) for side in ("pos", "neg")],
    )
    rows = one.select("P", "N", _grid_rows([
        F.struct(F.lit(t).alias("tau"), F.col(f"pos{i}").alias("tp"), F.col(f"neg{i}").alias("fp")) for i, t in enumerate(ordered)
    ]).alias("g"))
    counts = rows.select("g.*", (F.col("N") - F.col("g.fp")).alias("tn"), (F.col("P") - F.col("g.tp")).alias("fn"))
    return counts.select("tau", *C.COUNTS, *[c.alias(n) for n, c in C.rates().items() if n != "fnr"])
