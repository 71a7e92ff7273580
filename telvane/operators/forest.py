"""Random forest with feature selection, Platt calibration and cross-validation.

Forests come from ``operators.trees``: any number of them (folds, calibration parts, variants) is trained by the same
passes over one table whose rows name the models they belong to.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telvane.functions.labels import NORMAL_CLASS_SPELLINGS
from telvane.functions.scalars import clip
from telvane.operators import trees as T
from telvane.operators.evaluate import weighted_f1
from telvane.operators.split import ranked_bands, stratum_sizes
from telvane.schema import SEED
from telvane.session import settle

MIN_SELECTED = 5
MAX_FOLDS = 5


@dataclass
class Forest:
    """A fitted forest (or a calibrated ensemble) over named feature columns."""

    model: T.ArrayForest
    features: list[str]
    calibrated: list[tuple[T.ArrayForest, float, float]] = field(default_factory=list)

    def importances(self) -> list[tuple[str, float]]:
        return self.model.importances()

    def top_importances(self, df: DataFrame, n: int = 10) -> DataFrame:
        table = df.sparkSession.createDataFrame(self.importances(), "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature").limit(n)

    def score(self, df: DataFrame, out: str = "p_rf") -> DataFrame:
        """P(attack) of every row."""
        models = [m for m, _, _ in self.calibrated] or [self.model]
        raw = T.probabilities(df, {f"__raw{i}": (model, None) for i, model in enumerate(models)}, sum(m.size() for m in models))
        if not self.calibrated:
            return raw.withColumn(out, clip(F.col("__raw0"), 0.0, 1.0)).drop("__raw0")
        parts = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * F.col(f"__raw{i}") + F.lit(intercept)))) for i, (_, slope, intercept) in enumerate(self.calibrated)]
        mean = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
        return raw.withColumn(out, clip(mean, 0.0, 1.0)).drop(*[f"__raw{i}" for i in range(len(parts))])

    def predict(self, df: DataFrame, threshold: float = 0.5, out: str = "p_rf") -> DataFrame:
        """P(attack), the flag at a threshold, the predicted class and both class probabilities."""
        p = F.col(out)
        return (
            self.score(df, out)
            .withColumn("flagged", p >= threshold)
            .withColumn("prediction", F.when(p > 0.5, 1).otherwise(0))
            .withColumn("probabilities", F.array(F.lit(1.0) - p, p))
        )


def normal_class_index(classes: list) -> int | None:
    """Position of the first benign spelling, else 0; None without classes."""
    for i, c in enumerate(classes):
        if str(c) in NORMAL_CLASS_SPELLINGS:
            return i
    return 0 if classes else None


def attack_probability(probabilities: Column, classes: list) -> Column:
    """1 - P(normal) from a probability array ordered as ``classes``."""
    return clip(F.lit(1.0) - F.get(probabilities, normal_class_index(classes) or 0), 0.0, 1.0)


def class_weights(df: DataFrame, label: str = "label") -> Column:
    """Balanced weight of a row's class: rows / (classes * rows of the class)."""
    sizes = stratum_sizes(df, label)
    n, k = sum(sizes.values()), len(sizes)
    out = F.lit(1.0)
    for y, m in sizes.items():
        out = F.when(F.col(label) == y, n / (k * m)).otherwise(out)
    return out


def fit_plain(train: DataFrame, features: list[str], trees: int = 200, depth: int | None = None, label: str = "label", bins: int = 64,
              seed: int = SEED, row_id: str = "row_id") -> T.ArrayForest:
    """One balanced forest; depth is unlimited by default."""
    return fit_models(train, features, {0: F.lit(True)}, T.Growth(trees, depth, bins, seed=seed), label, row_id)[0]


def fit_models(train: DataFrame, features: list[str], members: dict[int, Column], growth: T.Growth, label: str = "label", row_id: str = "row_id") -> dict[int, T.ArrayForest]:
    """A forest per entry of ``members``, on the rows where its condition holds, all in the same passes."""
    models = F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in members.items()]))
    table = T.fit(T.training_rows(train, features, label, row_id, models), len(features), growth, list(members))
    return {m: T.ArrayForest(table.where(F.col("model") == m), features) for m in members}


def select_features(importances: list[tuple[str, float]]) -> list[str]:
    """Features at or above the mean importance; all of them if fewer than five would stay."""
    mean = float(np.mean([v for _, v in importances]))
    kept = [f for f, v in importances if v >= mean]
    return kept if len(kept) >= MIN_SELECTED else [f for f, _ in importances]


def with_folds(df: DataFrame, folds: int, label: str = "label", row_id: str = "row_id", seed: int = SEED) -> DataFrame:
    """Column ``fold``: equal stratified parts by row digest."""
    cuts = F.array(*[F.bround(F.col("__n") * F.lit(i) / F.lit(folds)) for i in range(1, folds)])
    return ranked_bands(df, label, cuts, row_id, seed).withColumnRenamed("band", "fold")


def platt(scored: DataFrame, score: str, label: str = "label") -> tuple[float, float]:
    """Slope and intercept of a sigmoid on a score, with Platt's smoothed targets."""
    return platt_each(scored.withColumn("__all", F.lit(0)), score, "__all", label)[0]


def platt_each(scored: DataFrame, score: str, by: str, label: str = "label", steps: int = 50) -> dict:
    """A sigmoid per value of ``by`` (few values): all take their Newton steps in the same job.

    Fitted on one row per distinct score and side, so its size follows the number of distinct scores (leaf averages).
    A step that does not lower the loss is halved.
    """
    y = F.col(label) == 1
    counts = settle(scored.groupBy(F.col(by).alias("g"), F.col(score).alias("s")).agg(
        F.sum(F.when(y, 1.0).otherwise(0.0)).alias("pos"), F.sum(F.when(y, 0.0).otherwise(1.0)).alias("neg")
    ), "platt")
    sizes = {r["g"]: (r["pos"], r["neg"]) for r in counts.groupBy("g").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}
    at = {g: np.array([0.0, np.log((p + 1.0) / (n + 1.0))]) for g, (p, n) in sizes.items()}
    best = {g: (np.inf, None, None) for g in at}
    reached = dict(at)
    for _ in range(steps):
        a, b, up = F.lit(0.0), F.lit(0.0), F.lit(0.0)
        for g, (p, n) in sizes.items():
            own = F.col("g").eqNullSafe(F.lit(g))
            a, b = F.when(own, float(at[g][0])).otherwise(a), F.when(own, float(at[g][1])).otherwise(b)
            up = F.when(own, F.col("pos") * ((p + 1.0) / (p + 2.0)) + F.col("neg") * (1.0 / (n + 2.0))).otherwise(up)
        z, w = a * F.col("s") + b, F.col("pos") + F.col("neg")
        q = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        rows = counts.withColumns({"__z": z, "__q": q, "__up": up, "__w": w})
        slope, curve, s = F.col("__w") * F.col("__q") - F.col("__up"), F.col("__w") * F.col("__q") * (F.lit(1.0) - F.col("__q")), F.col("s")
        loss = F.col("__w") * (F.greatest(F.col("__z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs(F.col("__z"))))) - F.col("__up") * F.col("__z")
        found = rows.groupBy("g").agg(
            F.sum(loss).alias("loss"), F.sum(slope * s).alias("ga"), F.sum(slope).alias("gb"),
            F.sum(curve * s * s).alias("haa"), F.sum(curve * s).alias("hab"), F.sum(curve).alias("hbb"),
        ).collect()  # one row per value of ``by``
        moved = False
        for r in found:
            g = r["g"]
            if r["loss"] < best[g][0] - 1e-12 * max(1.0, abs(r["loss"])):
                hessian = np.array([[r["haa"] + 1e-12, r["hab"]], [r["hab"], r["hbb"] + 1e-12]])
                step = -np.linalg.solve(hessian, np.array([r["ga"], r["gb"]]))
                best[g], reached[g] = (r["loss"], at[g], step), at[g]
            else:
                best[g] = (best[g][0], best[g][1], best[g][2] / 2)
            if np.abs(best[g][2]).max() > 1e-9 * (1.0 + np.abs(best[g][1]).max()):
                moved = True
            at[g] = best[g][1] + best[g][2]
        if not moved:
            break
    return {g: (float(v[0]), float(v[1])) for g, v in reached.items()}


def _held_out(parts: DataFrame, forests: dict[int, T.ArrayForest], out: str) -> DataFrame:
    """Every row's probability by the forest that did not see its fold."""
    names = {i: f"__held{i}" for i in forests}
    scored = T.probabilities(parts, {names[i]: (f, F.col("fold") == i) for i, f in forests.items()}, max((f.size() for f in forests.values()), default=0))
    return scored.withColumn(out, sum((F.col(n) for n in names.values()), F.lit(0.0))).drop(*names.values())


def fit(train: DataFrame, features: list[str], trees: int = 200, depth: int | None = None, select: bool = True, calibrate: bool = True,
        label: str = "label", row_id: str = "row_id", bins: int = 64) -> Forest:
    """Fit, keep features of at least mean importance, refit, and calibrate by held-out folds.

    The refitted forest and those of all folds are trained together.
    """
    growth = T.Growth(trees, depth, bins)
    kept, first = features, None
    if select or not calibrate:
        first = fit_models(train, features, {0: F.lit(True)}, growth, label, row_id)[0]
        kept = select_features(first.importances()) if select else features
    members = {} if first and kept == features else {0: F.lit(True)}
    rows = train
    if calibrate:
        smallest = min(stratum_sizes(train, label).values())
        folds = max(2, min(3, smallest // 2))
        rows = settle(with_folds(train.select(row_id, label, *kept), folds, label, row_id), "folds")
        members |= {i + 1: F.col("fold") != i for i in range(folds)}
    fitted = fit_models(rows, kept, members, growth, label, row_id) if members else {}
    forest = Forest(fitted.get(0, first), kept)
    if calibrate:
        held = _held_out(rows, {i: fitted[i + 1] for i in range(folds)}, "__p")
        sigmoids = platt_each(held, "__p", "fold", label)
        forest.calibrated = [(fitted[i + 1], *sigmoids[i]) for i in range(folds)]
    return forest


def cross_validate(train: DataFrame, features: list[str], trees: int = 200, depth: int | None = None, folds: int = MAX_FOLDS,
                   label: str = "label", row_id: str = "row_id", bins: int = 64) -> list[float]:
    """Weighted F1 of each stratified fold; the forests of all folds are trained together."""
    folds = max(2, min(folds, min(stratum_sizes(train, label).values())))
    rows = settle(with_folds(train.select(row_id, label, *features), folds, label, row_id), "folds")
    fitted = fit_models(rows, features, {i: F.col("fold") != i for i in range(folds)}, T.Growth(trees, depth, bins), label, row_id)
    held = _held_out(rows, fitted, "__p").withColumn("prediction", F.when(F.col("__p") > 0.5, 1).otherwise(0))
    return [r["weighted_f1"] for r in weighted_f1(held, label, slices=["fold"]).orderBy("fold").collect()]


def fit_stacker(val: DataFrame, label: str = "label", strength: float = 1.0) -> tuple[float, float, float]:
    """Balanced logistic regression on (s_if, p_rf): (weight, weight, intercept).

    L2 with inverse strength C on the summed loss equals regParam = 1 / (C * total weight) on the mean loss.
    """
    weighted = val.select("s_if", "p_rf", label).withColumn("__w", class_weights(val, label))
    mass = weighted.agg(F.sum("__w")).first()[0]
    assembled = VectorAssembler(inputCols=["s_if", "p_rf"], outputCol="__x").transform(weighted)
    m = LogisticRegression(
        featuresCol="__x", labelCol=label, weightCol="__w", maxIter=500, tol=1e-10, standardization=False, regParam=1.0 / (strength * mass)
    ).fit(assembled)
    return float(m.coefficients[0]), float(m.coefficients[1]), float(m.intercept)
