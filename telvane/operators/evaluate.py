"""Metrics over score tables, plain or sliced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telvane.functions import confusion as C
from telvane.functions.scalars import col, ratio
from telvane.operators.quantiles import exact_quantiles
from telvane.operators.ranking import ranking_metrics
from telvane.operators.search import best_threshold, spread_alphas
from telvane.operators.series import first_rows

# The quality targets a detector is checked against.
TARGETS = {
    "roc_auc": 0.97,
    "avg_precision": 0.93,
    "f1": 0.92,
    "precision": 0.90,
    "recall": 0.95,
    "detection_rate": 0.95,
    "fpr": 0.05,
}
LOWER_IS_BETTER = {"fpr"}
#: Targets that are set for a metric under another name.
SAME_AS = {"detection_rate": "recall"}


def metrics(df: DataFrame, threshold: float | Column | str = 0.5, score: str = "score", label: str = "label",
            slices: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """The full metric row per slice at a constant or per-row threshold (its mean is reported)."""
    slices = slices or []
    tau = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else col(threshold)
    flat = df.select(*slices, F.col(label).alias("label"), F.col(score).alias("score"), tau.alias("tau"))
    counts = flat.groupBy(*slices).agg(
        *C.confusion_counts("label", F.col("score") >= F.col("tau")), F.avg("tau").alias("threshold")
    )
    ranks = ranking_metrics(flat, slices, "score", "label", digits)
    # One row per slice on both sides.
    both = counts.join(ranks, slices) if slices else counts.join(ranks.withColumn("__k", F.lit(1)), F.lit(1) == F.col("__k")).drop("__k")
    shown = F.col("threshold") if digits is None else F.round("threshold", digits)
    return both.select(*slices, *[c.alias(n) for n, c in C.rates(digits).items()], "roc_auc", "avg_precision",
                       shown.alias("threshold"), *C.COUNTS)


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class, from counts per (label, prediction)."""
    pairs = df.groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    ))
    hit = F.when((F.col("y") == F.col("p")) & (F.col("s.support") > 0), F.col("n")).otherwise(0)
    per_class = (
        pairs.withColumn("s", sides)
        .select("s.*", hit.alias("hits"))
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    return per_class.select(
        "class",
        F.round(ratio(F.col("hits"), F.col("predicted")), digits).alias("precision"),
        F.round(ratio(F.col("hits"), F.col("support")), digits).alias("recall"),
        F.round(ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")), digits).alias("f1"),
        "support",
    )


def weighted_f1(df: DataFrame, label: str = "label", prediction: str = "prediction", slices: list[str] | None = None) -> DataFrame:
    """Support-weighted mean of per-class F1 (per slice)."""
    slices = slices or []
    sides = F.explode(F.array(
        F.struct(F.col(label).cast("string").alias("class"), F.lit(1).alias("s"), F.lit(0).alias("q"),
                 F.when(F.col(label) == F.col(prediction), 1).otherwise(0).alias("h")),
        F.struct(F.col(prediction).cast("string").alias("class"), F.lit(0).alias("s"), F.lit(1).alias("q"), F.lit(0).alias("h")),
    ))
    per_class = (
        df.select(*slices, sides.alias("x")).groupBy(*slices, "x.class")
        .agg(F.sum("x.s").alias("s"), F.sum("x.q").alias("q"), F.sum("x.h").alias("h"))
    )
    f1 = ratio(2 * F.col("h"), F.col("s") + F.col("q"))
    return per_class.groupBy(*slices).agg(ratio(F.sum(f1 * F.col("s")), F.sum("s")).alias("weighted_f1"))


def check_targets(row: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """metric, value, target, met for every targeted metric of a one-row metric table."""
    row = row.withColumns({m: F.col(c) for m, c in SAME_AS.items() if m not in row.columns and c in row.columns})
    present = [m for m in targets if m in row.columns]
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(targets[m]).alias("target"),
                 ((F.col(m) <= targets[m]) if m in LOWER_IS_BETTER else (F.col(m) >= targets[m])).alias("met"))
        for m in present
    ])).alias("t"))
    return long.select("t.*")


def score_statistics(df: DataFrame, score: str = "score", slices: list[str] | None = None, digits: int = 4) -> DataFrame:
    return df.groupBy(*(slices or [])).agg(
        F.round(F.min(score), digits).alias("min"), F.round(F.max(score), digits).alias("max"),
        F.round(F.avg(score), digits).alias("mean"), F.round(F.stddev_pop(score), digits).alias("std"),
    )


def detection_contribution(df: DataFrame, tau_if: float, tau_rf: float, tau_fused: float, fused: str = "fused",
                           label: str = "label") -> DataFrame:
    """Among fused alerts: found by the anomaly score only, the classifier only, or both."""
    a, r, f = F.col("s_if") >= tau_if, F.col("p_rf") >= tau_rf, F.col(fused) >= tau_fused
    groups = {"IF_only_detection": a & ~r & f, "RF_only_detection": r & ~a & f, "consensus_detection": r & a & f}
    sums = [C.count_where(f).alias("flagged")]
    for i, g in enumerate(groups.values()):
        sums += [C.count_where(g).alias(f"n{i}"), C.count_where(g & (F.col(label) == 1)).alias(f"a{i}")]
    rows = df.agg(*sums).select("flagged", F.explode(F.array(*[
        F.struct(F.lit(name).alias("contribution"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("attacks"))
        for i, name in enumerate(groups)
    ])).alias("g"))
    return rows.select(
        "g.contribution", F.col("g.n").alias("count"),
        F.round(ratio(F.col("g.n"), F.greatest(F.col("flagged"), F.lit(1))), 4).alias("percent_of_fused_alerts"),
        F.round(ratio(F.col("g.attacks"), F.col("g.n")), 4).alias("attack_rate"),
    )


def rare_attacks(df: DataFrame, share: float = 0.35, label: str = "label", category: str = "attack_cat") -> list[str]:
    """Attack classes whose row count is at most the given quantile of all class counts."""
    counts = df.filter(F.col(label) == 1).groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    cut = exact_quantiles(counts, ["n"], [share])["n"][0]
    return [] if cut is None else [r[category] for r in counts.filter(F.col("n") <= cut).collect()]


def score_distribution(df: DataFrame, score: str = "s_if", label: str = "label", category: str = "attack_cat") -> DataFrame:
    """n, mean, p50, p95 of a score for benign, known and rare rows (rare rows also count as known)."""
    rare = rare_attacks(df, label=label, category=category)
    groups = {"benign": F.col(label) == 0, "known_attack": F.col(label) == 1, "rare_attack": F.col(category).isin(rare)}
    spark, rows = df.sparkSession, []
    means = df.agg(*[x for g, c in groups.items() for x in (C.count_where(c).alias(f"n_{g}"), F.avg(F.when(c, F.col(score))).alias(f"m_{g}"))]).first()
    q = exact_quantiles(df.select(*[F.when(c, F.col(score)).alias(g) for g, c in groups.items()]), list(groups), [0.5, 0.95])
    for g in groups:
        if means[f"n_{g}"]:
            rows.append((g, int(means[f"n_{g}"]), float(means[f"m_{g}"]), float(q[g][0]), float(q[g][1])))
    out = spark.createDataFrame(rows, "`group` string, n long, m double, p50 double, p95 double")
    return out.select("group", "n", F.round("m", 4).alias("if_score_mean"), F.round("p50", 4).alias("if_score_p50"),
                      F.round("p95", 4).alias("if_score_p95"))


def suppress(df: DataFrame, score: str = "s_if", distance: str = "maha", below: float = 0.70, within: float = 2.0,
             out: str = "s_if") -> DataFrame:
    """Zero the anomaly score of rows that score low and lie close to their device's profile."""
    mask = (F.col(score) < below) & (F.col(distance) < within)
    return df.withColumn("suppressed", mask).withColumn(out, F.when(mask, 0.0).otherwise(F.col(score)))


def suppression_effect(df: DataFrame, label: str = "label") -> DataFrame:
    n = C.count_where(F.col("suppressed"))
    hits = C.count_where(F.col("suppressed") & (F.col(label) == 1))
    return df.agg(n.alias("suppressed_rows"), F.round(ratio(hits, n), 4).alias("suppressed_attack_rate"))


def time_window(hour: Column | str = "hour") -> Column:
    """Six-hour window label such as '06-12'."""
    low = (F.floor(col(hour) / 6) * 6).cast("int")
    return F.format_string("%02d-%02d", low, low + 6)


def metrics_by_time_window(df: DataFrame, tau: str | float, score: str = "score", label: str = "label") -> DataFrame:
    """Metrics per six-hour window; windows without an attack are left out."""
    out = metrics(df.withColumn("time_window", time_window()), tau, score, label, ["time_window"])
    return out.filter(F.col("tp") + F.col("fn") > 0).withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))


def metrics_by_device_type(df: DataFrame, tau: str | float, score: str = "score", label: str = "label") -> DataFrame:
    out = metrics(df, tau, score, label, ["device_type"])
    return out.withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))


def warm_up_impact(df: DataFrame, flagged: Column, first: int = 50, device: str = "device_id", label: str = "label",
                   order: list[str] = ("ts", "row_id")) -> DataFrame:
    """FP and FN rate over the first rows of every device and over its later rows.

    The first rows are ranked in two salted rounds, so no task receives a whole
    device; the later rows are what all rows have more.
    """
    flat = df.select(device, *order, F.col(label).alias("__label"), flagged.alias("__flagged"))
    counts = [F.count(F.lit(1)).alias("n"), *C.confusion_counts("__label", "__flagged")]
    early = first_rows(flat, [device], list(order), first).agg(*counts).withColumn("sign", F.lit(-1))
    both = early.unionByName(flat.agg(*counts).withColumn("sign", F.lit(1)))
    names = ["n", *C.COUNTS]
    parts = F.array(
        F.struct(F.lit(f"warm_up_first_{first}").alias("segment"), *[F.when(F.col("sign") < 0, F.col(c)).otherwise(0).alias(c) for c in names]),
        F.struct(F.lit(f"after_warm_up_{first + 1}_plus").alias("segment"), *[(F.col(c) * F.col("sign")).alias(c) for c in names]),
    )
    summed = both.select(F.explode(parts).alias("x")).groupBy("x.segment").agg(*[F.sum(f"x.{c}").alias(c) for c in names])
    return summed.filter("n > 0").select(
        "segment", "n", F.round(C.false_positive_rate(), 4).alias("fp_rate"), F.round(C.false_negative_rate(), 4).alias("fn_rate")
    )


def held_out_recall(df: DataFrame, attack: str, thresholds: dict[str, tuple[str, float]], label: str = "label",
                    category: str = "attack_cat") -> DataFrame:
    """Recall on a held-out class and on the known attacks, per variant name -> (score column, threshold)."""
    unseen = F.col(category) == attack
    known = (F.col(label) == 1) & ~unseen
    sums = [C.count_where(unseen).alias("u"), C.count_where(known).alias("k")]
    for i, (score, tau) in enumerate(thresholds.values()):
        sums += [C.count_where(unseen & (F.col(score) >= tau)).alias(f"u{i}"), C.count_where(known & (F.col(score) >= tau)).alias(f"k{i}")]
    rows = df.agg(*sums).select("u", "k", F.explode(F.array(*[
        F.struct(F.lit(name).alias("variant"), F.lit(float(tau)).alias("threshold"), F.col(f"u{i}").alias("hu"), F.col(f"k{i}").alias("hk"))
        for i, (name, (_, tau)) in enumerate(thresholds.items())
    ])).alias("g"))
    return rows.select(
        F.lit(attack).alias("held_out_attack"), "g.variant", F.col("u").alias("zero_day_n"),
        F.round(ratio(F.col("g.hu"), F.col("u")), 4).alias("zero_day_recall"),
        F.round(ratio(F.col("g.hk"), F.col("k")), 4).alias("known_attack_recall"), "g.threshold",
    )


def top_rows(df: DataFrame, by: str = "f1", n: int = 30, ties: list[str] = ()) -> DataFrame:
    """The n best rows without the columns that are null throughout the table."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    shown = [c for c in df.columns if filled[c]]
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n).select(*[F.col(f"`{c}`") for c in shown])


def dataset_summary(df: DataFrame, label: str = "label", category: str = "attack_cat", by: list[str] | None = None) -> DataFrame:
    """Rows, normal/attack counts and attack share per category (and further keys)."""
    return df.groupBy(category, *(by or [])).agg(
        F.count(F.lit(1)).alias("rows"), C.count_where(F.col(label) == 0).alias("normal"), C.count_where(F.col(label) == 1).alias("attack"),
        F.round(F.avg(F.col(label).cast("double")), 4).alias("attack_ratio"),
    )


def alpha_sweep(val, test, alphas: list[float]):
    """Per alpha: best validation threshold, and the test metrics there."""
    best = best_threshold(spread_alphas(val, alphas), slices=["a", "alpha"]).select("a", F.col("threshold").alias("tau"))
    scored = spread_alphas(test, alphas).join(F.broadcast(best), "a")  # one row per alpha
    return metrics(scored, "tau", slices=["alpha"])


def metrics_at_best(long: DataFrame, variant: str = "variant", at_least: float = 0.0, label: str = "label") -> DataFrame:
    """Per variant of a long table (split, label, i, variant, score): threshold from 'val', metrics on 'test'."""
    best = best_threshold(long.filter(F.col("split") == "val"), label=label, slices=["i"])
    tau = best.select("i", F.greatest("threshold", F.lit(at_least)).alias("tau"))
    # One row per variant.
    tested = long.filter(F.col("split") == "test").join(F.broadcast(tau), "i")
    return metrics(tested, "tau", label=label, slices=[variant])
