"""End-to-end flows: preparation, profile-only alerting, and the trained detector."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telvane.functions import fusion
from telvane.functions.context import load_proxy
from telvane.operators import alerts as A
from telvane.operators import forest, ocsvm
from telvane.operators.clean import encode_cyclic, impute_median, require_features
from telvane.operators.evaluate import held_out_recall, metrics, metrics_at_best
from telvane.operators.harmonise import append_all
from telvane.operators.profile import SENSITIVITY, FrozenProfiles, sensitivity_profiles, sensitivity_scores
from telvane.operators.scale import RobustScale
from telvane.operators.quantiles import exact_quantiles
from telvane.operators.search import ALPHAS_JOINT, best_alpha, best_alpha_and_threshold, best_threshold_value, compare_methods
from telvane.operators.smote import balance
from telvane.operators.trees import ArrayForest
from telvane.operators.split import attack_ratio, frequent_attacks, hold_out_class, split_column
from telvane.schema import CYCLIC, FEATURES, MODEL_FEATURES, PROFILE_FEATURES, ProfilePreset
from telvane.session import settle
from telvane.sources.writers import load_bundle, save_bundle

KEYS = ["row_id", "ts", "device_id", "label", "attack_cat", "split", "hour"]


@dataclass
class Prepared:
    """Split and scaled rows, written to the shared folder, with the scaler that made them."""

    rows: DataFrame
    scaler: RobustScale
    features: list[str]

    def part(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("split") == name)


def prepare(flow: DataFrame, scaler: RobustScale | None = None) -> Prepared:
    """Clean -> encode -> split -> scale. The scaler is fitted on training rows only, or given.

    The flow table is read three times (medians, quartiles, scaled output), so
    it is settled once first: its windows are then not recomputed.
    """
    plain = [f for f in FEATURES if f not in CYCLIC]
    base = settle(require_features(flow).select("row_id", "ts", "device_id", "label", "attack_cat", *FEATURES), "flow")
    filled = impute_median(base, plain)
    encoded = encode_cyclic(filled, keep_hour="hour").withColumn("split", split_column())
    scaler = scaler or RobustScale.fit(encoded.filter(F.col("split") == "train"), MODEL_FEATURES)
    rows = settle(scaler.transform(encoded).select(*KEYS, *MODEL_FEATURES), "prepared")
    return Prepared(rows, scaler, list(MODEL_FEATURES))


def profile_alert_summary(flow: DataFrame) -> DataFrame:
    """Alert totals per device type when the profile deviation alone is the score."""
    prepared = prepare(flow)
    profiles = FrozenProfiles.fit(prepared.part("train"), prepared.features, ProfilePreset(), mode="zscore")
    # From here on: one narrow row per event, read by the percentiles and the alerts.
    scored = settle(profiles.score(prepared.rows.filter(F.col("split") != "train"), "z", None).select(*KEYS, "z"), "deviation")
    val = scored.filter(F.col("split") == "val")
    loaded = A.with_load(scored, val, "z", "score")
    tau = A.calibrate_tau(loaded.filter(F.col("split") == "val"))
    test = A.with_device_context(loaded.filter(F.col("split") == "test"))
    alerts = A.build_alerts(
        test.withColumn("load", F.col("score")), raised_only=True, attack_type="attack_cat",
        s_if="score", p_rf="score", tau_base=tau,
    )
    return A.alert_summary(alerts.withColumn("device_type", F.col("context.device_type")), ["device_type"])


@dataclass
class Detector:
    """Everything fitted: scaler, profiles, anomaly model, classifier, fusion weight and threshold."""

    scaler: RobustScale
    profiles: FrozenProfiles | None
    svm: ocsvm.OneClassSVM
    forest: forest.Forest
    mode: str = "both"
    alpha: float = 0.45
    tau: float = 0.5
    method: str = "weighted_linear"
    stacker: tuple[float, float, float] | None = None
    reliability: tuple[float, float] | None = None
    tau_rf: float = 0.5
    load_scale: float = 0.0

    def fused(self) -> Column:
        """The fused score by the method chosen in training."""
        return fusion.fuse(method=self.method, alpha=self.alpha, stacker=self.stacker, reliability=self.reliability)

    def prepare(self, flow: DataFrame) -> DataFrame:
        """Raw flow rows of a table or stream as this detector scores them; map-only. Missing values become the centre."""
        encoded = encode_cyclic(flow.withColumn("split", F.lit("new")), keep_hour="hour")
        return self.scaler.transform(encoded).fillna(0.0, list(self.scaler.center)).select(*[c for c in KEYS if c in encoded.columns], *self.scaler.center)

    def alerts(self, scores: DataFrame, raised_only: bool = True) -> DataFrame:
        """Alert records of scored rows: pseudo device types, load from the deviation, attack type from the classifier."""
        z = PROFILE_FEATURES[0]
        load = load_proxy(z, self.load_scale) if z in scores.columns else F.lit(0.5)
        rows = A.with_device_context(scores.withColumn("load", load).withColumn("attack_type", A.predicted_attack_type("p_rf", self.tau_rf)))
        return A.build_alerts(rows, raised_only=raised_only, tau_base=self.tau)

    def augment(self, rows: DataFrame) -> DataFrame:
        return self.profiles.augment(rows, self.mode)[0] if self.profiles else rows

    def score(self, rows: DataFrame) -> DataFrame:
        """Score table of prepared rows: keys, deviations, s_if, p_rf and the fused score."""
        out = self.forest.score(self.svm.score(self.augment(rows)))
        keep = [c for c in (*KEYS, *PROFILE_FEATURES, "s_if", "p_rf") if c in out.columns]
        return out.select(*keep).withColumn("score", self.fused())

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        settings = {"svm": self.svm.settings(), "forest": self.forest.features, "mode": self.mode, "alpha": self.alpha, "tau": self.tau,
                    "method": self.method, "stacker": self.stacker, "reliability": self.reliability, "tau_rf": self.tau_rf, "load_scale": self.load_scale,
                    "sigmoids": [[slope, intercept] for _, slope, intercept in self.forest.calibrated]}
        models = {"forest": self.forest.model.table, **{f"calibrated{i}": m.table for i, (m, _, _) in enumerate(self.forest.calibrated)}}
        save_bundle(path, models, self.profiles, self.scaler.table(spark), settings)

    @classmethod
    def load(cls, spark, path: str) -> Detector:
        models, profiles, scaler, s = load_bundle(spark, path)
        trees = {name: ArrayForest(table, s["forest"]) for name, table in models.items()}
        calibrated = [(trees[f"calibrated{i}"], *pair) for i, pair in enumerate(s["sigmoids"])]
        return cls(RobustScale.from_table(scaler), profiles, ocsvm.OneClassSVM.from_settings(s["svm"]),
                   forest.Forest(trees["forest"], s["forest"], calibrated), s["mode"], s["alpha"], s["tau"], s["method"],
                   tuple(s["stacker"]) if s["stacker"] else None, tuple(s["reliability"]) if s["reliability"] else None, s["tau_rf"], s["load_scale"])


@dataclass
class TrainingPlan:
    """Sizes of a training run."""

    trees: int = 220
    depth: int | None = None
    passes: int = 30
    rebalance: bool = True
    alphas: list[float] = field(default_factory=lambda: list(ALPHAS_JOINT))
    select: bool = False
    calibrate: bool = False


@dataclass(frozen=True)
class Variant:
    """What a training run changes: how rows are profiled, and the attack class it never sees."""

    mode: str = "both"
    per_device: bool = True
    hold_out: str | None = None


def train_detector(prepared: Prepared, plan: TrainingPlan = TrainingPlan(), mode: str = "both", per_device: bool = True,
                   preset: ProfilePreset = ProfilePreset(), hold_out: str | None = None) -> tuple[Detector, DataFrame]:
    """Profiles -> augmented rows -> anomaly model and classifier -> score table -> weight and threshold.

    ``hold_out`` removes one attack class from the training rows first.
    """
    return train_detectors(prepared, [Variant(mode, per_device, hold_out)], plan, preset)[0]


def train_detectors(prepared: Prepared, variants: list[Variant], plan: TrainingPlan = TrainingPlan(),
                    preset: ProfilePreset = ProfilePreset()) -> list[tuple[Detector, DataFrame]]:
    """A detector per variant. The forests of all variants with the same features are grown by the same passes."""
    fitted, training = [], {}
    for i, v in enumerate(variants):
        rows = hold_out_class(prepared.rows, v.hold_out) if v.hold_out else prepared.rows
        train = rows.filter(F.col("split") == "train")
        profiles = None if v.mode == "none" else FrozenProfiles.fit(train, prepared.features, preset, per_device=v.per_device, mode="both")
        augmented, features = profiles.augment(train, v.mode) if profiles else (train, prepared.features)
        augmented = settle(augmented.select("row_id", "label", *features), "augmented")
        nu = attack_ratio(augmented).first()["attack_ratio"]
        svm = ocsvm.fit(ocsvm.normal_training_rows(augmented, features), features, nu, plan.passes)
        balanced = balance(augmented, features) if plan.rebalance else augmented
        part = balanced.select("row_id", "label", *features, F.lit(i).alias("variant"))
        held = training.get(tuple(features))
        training[tuple(features)] = held.unionByName(part) if held is not None else part
        fitted.append((rows, profiles, svm, features))
    trees = {}
    for features, table in training.items():
        if plan.select or plan.calibrate:  # each variant chooses its own features
            table = settle(table, "training")
            for i in (i for i, f in enumerate(fitted) if tuple(f[3]) == features):
                trees[i] = forest.fit(table.filter(F.col("variant") == i), list(features), plan.trees, plan.depth, plan.select, plan.calibrate)
            continue
        members = {i: F.col("variant") == i for i, f in enumerate(fitted) if tuple(f[3]) == features}
        grown = forest.fit_models(settle(table, "training"), list(features), members, forest.T.Growth(plan.trees, plan.depth))
        trees |= {i: forest.Forest(model, list(features)) for i, model in grown.items()}
    out = []
    for i, (v, (rows, profiles, svm, features)) in enumerate(zip(variants, fitted)):
        detector = Detector(prepared.scaler, profiles, svm, trees[i], v.mode)
        scores = settle(detector.score(rows), "scores")
        best = best_alpha_and_threshold(scores.filter(F.col("split") == "val"), plan.alphas).first()
        detector.alpha, detector.tau = best["alpha"], best["threshold"]
        out.append((detector, scores.withColumn("score", fusion.fuse(alpha=detector.alpha))))
    return out


@dataclass
class Run:
    """The main pipeline's results: the tuned detector, all scores, the methods compared, alerts, totals and test metrics."""

    detector: Detector
    scores: DataFrame
    comparison: DataFrame
    alerts: DataFrame
    summary: DataFrame
    metrics: DataFrame


#: The main pipeline's forest: chosen features, calibrated probabilities.
MAIN_PLAN = TrainingPlan(trees=200, select=True, calibrate=True)


def main_pipeline(prepared: Prepared, plan: TrainingPlan = MAIN_PLAN, method: str = "auto", target_fpr: float = 0.05) -> Run:
    """Models -> fusion weight, stacker and best method on validation rows -> base threshold -> alerts and test metrics.

    ``method``: one of ``fusion.METHODS`` but ranks (which need a reference table), or "auto" for the largest F1.
    Reliabilities are the validation F1 of both models at their own best thresholds.
    """
    detector, scores = train_detector(prepared, plan)
    val, test = (scores.filter(F.col("split") == part) for part in ("val", "test"))
    detector.alpha = best_alpha(val).first()["alpha"]
    detector.stacker = forest.fit_stacker(val)
    detector.tau_rf = best_threshold_value(val, "p_rf")
    own = [metrics(val, best_threshold_value(val, s), s, digits=None).first()["f1"] for s in ("s_if", "p_rf")]
    detector.reliability = (own[0], own[1])
    comparison = settle(compare_methods(val, detector.alpha, detector.stacker), "methods")
    detector.method = comparison.filter("best").first()["method"] if method == "auto" else method
    fused = settle(scores.withColumn("score", detector.fused()), "fused")
    val, test = (fused.filter(F.col("split") == part) for part in ("val", "test"))
    detector.tau = A.calibrate_tau(val, target_fpr=target_fpr)
    detector.load_scale = exact_quantiles(val, [PROFILE_FEATURES[0]], [0.95])[PROFILE_FEATURES[0]][0] or 0.0
    alerts = settle(detector.alerts(test), "alerts")
    found = metrics(test, detector.tau).select("*", F.lit(detector.method).alias("best_method"), F.lit(float(detector.alpha)).alias("best_alpha"))
    return Run(detector, fused, comparison, alerts, A.alert_summary(alerts), found)


def detect_stream(detector: Detector, stream: DataFrame) -> DataFrame:
    """Raised alerts of raw flow rows that arrive: profile, score, fuse, threshold; no state."""
    return A.rounded(detector.alerts(detector.score(detector.prepare(stream))))


def zero_day(prepared: Prepared, plan: TrainingPlan, classes: int = 3) -> DataFrame:
    """Recall on attack classes left out of training; the forests without each of them are grown together."""
    names = [r["attack_cat"] for r in frequent_attacks(prepared.part("train"), classes).collect()]  # at most ``classes``
    out = []
    for name, (detector, scores) in zip(names, train_detectors(prepared, [Variant(hold_out=n) for n in names], plan)):
        val, test = scores.filter(F.col("split") == "val"), scores.filter(F.col("split") == "test")
        taus = {"RF_only": ("p_rf", best_threshold_value(val, "p_rf")), "IF_only": ("s_if", best_threshold_value(val, "s_if")),
                "IF_RF_fused": ("score", detector.tau)}
        out.append(held_out_recall(test, name, taus))
    return append_all(out)


# The profiling variants compared by retraining.
PROFILING_VARIANTS = [
    ("without_profile", "none", True),
    ("ewma_zscore_only", "zscore", True),
    ("mahalanobis_only", "mahalanobis", True),
    ("both_per_device", "both", True),
    ("both_global", "both", False),
]


def profiling_ablation(prepared: Prepared, plan: TrainingPlan, variants=PROFILING_VARIANTS) -> DataFrame:
    """Test metrics after retraining with each way of profiling."""
    out = []
    trained = train_detectors(prepared, [Variant(mode, per_device) for _, mode, per_device in variants], plan)
    for (name, mode, per_device), (detector, scores) in zip(variants, trained):
        row = metrics(scores.filter(F.col("split") == "test"), detector.tau)
        out.append(row.select(F.lit(name).alias("variant"), F.lit(mode).alias("profile_mode"), F.lit(per_device).alias("per_device"),
                              F.lit(detector.alpha).alias("alpha"), "*"))
    return append_all(out)


def profile_sensitivity(prepared: Prepared, detector: Detector, settings=SENSITIVITY) -> DataFrame:
    """Test metrics under other profile settings, reusing the fitted models (weight 0.45).

    All settings go through the same jobs: one tail extraction, one profile
    table, one scoring join, one threshold histogram, one metric table.
    """
    spark = prepared.rows.sparkSession
    table = settle(sensitivity_profiles(prepared.part("train"), prepared.features, settings=settings, mode="both"), "sensitivity")
    z, maha = PROFILE_FEATURES
    rows = sensitivity_scores(prepared.rows.filter(F.col("split") != "train"), table, prepared.features, z=z, maha=maha, configs=len(settings))
    scored = detector.forest.score(detector.svm.score(rows)).withColumn("score", fusion.fuse(alpha=0.45))
    long = settle(scored.select("split", "label", F.col("config").alias("i"), "config", "score"), "sensitivity")
    names = spark.createDataFrame(
        [(i, p, float(v), s.alpha, s.window, s.warm_up, s == ProfilePreset()) for i, (p, v, s) in enumerate(settings)],
        "config int, ablation string, value double, alpha double, window_size int, warm_up int, chosen_config boolean",
    )
    return metrics_at_best(long, "config").join(names, "config").drop("config")


def cross_dataset(detector: Detector, flow: DataFrame) -> DataFrame:
    """Test metrics on another dataset with this detector's scaler, profiles, models and threshold."""
    target = prepare(flow, detector.scaler)
    return metrics(detector.score(target.part("test")), detector.tau)
