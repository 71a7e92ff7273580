import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telvane.operators import forest, neighbours, ocsvm, smote


@pytest.fixture(scope="module")
def points(spark):
    """Clusters, a third of identical rows, and single points."""
    rng = np.random.default_rng(5)
    v = np.vstack([np.tile([[1.0, 2.0, 3.0]], (100, 1)), rng.normal(0, 0.1, (100, 3)), rng.normal(5, 3, (120, 3))])
    ids = [f"p{i:03d}" for i in range(len(v))]
    return ids, v, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, v)], "row_id string, vec array<double>")


@pytest.mark.parametrize("block", [7, 1024])
def test_neighbours_equal_brute_force(points, block):
    ids, v, df = points
    got = {r["row_id"]: [(round(n["distance"], 9), n["row_id"]) for n in r["neighbours"]] for r in neighbours.nearest(df, 4, block=block).collect()}
    assert len(got) == len(ids)
    for i, name in enumerate(ids):
        d = np.zeros(len(ids))
        for j in range(3):
            d += (v[:, j] - v[i, j]) ** 2
        d = np.sqrt(d)
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (d[j], ids[j]))[:4]
        assert got[name] == [(round(d[j], 9), ids[j]) for j in order]


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(6)
    n = 600
    y = (rng.random(n) < 0.2).astype(int)
    pdf = pd.DataFrame({"row_id": [f"r{i:04d}" for i in range(n)], "label": y})
    for j in range(6):
        pdf[f"f{j}"] = rng.normal(size=n) + (2.5 * y if j < 2 else 0)
    return pdf, spark.createDataFrame(pdf)


FEATURES = [f"f{j}" for j in range(6)]


def test_smote_reaches_parity_on_segments(spark, signal):
    pdf, df = signal
    out = smote.balance(df, FEATURES).toPandas()
    assert out.groupby("label").size().nunique() == 1
    made = out[out["synthetic"]]
    few = pdf[pdf["label"] == 1]
    real = few.set_index("row_id")[FEATURES]
    for r in made.head(25).itertuples():
        base = real.loc[r.row_id.split("-")[1]].to_numpy()
        x = np.array([getattr(r, f) for f in FEATURES])
        gaps = [np.linalg.norm((x - base) - ((x - base) @ (o - base)) / max((o - base) @ (o - base), 1e-300) * (o - base)) for o in real.to_numpy()]
        assert min(gaps) < 1e-9
    again = smote.balance(df.repartition(1), FEATURES, block=16).toPandas()
    key = lambda p: p.sort_values("row_id")[["row_id", *FEATURES]].reset_index(drop=True)
    pd.testing.assert_frame_equal(key(out), key(again))


def test_smote_leaves_tiny_minorities_alone(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("c", 1, 3.0)], "row_id string, label int, x double")
    assert smote.balance(df, ["x"]).count() == 3


def test_one_class_svm_objective(spark):
    """Away from the origin there is something to gain: the objective falls below nu and never rises."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame(pd.DataFrame(rng.normal([4.0, 3.0], 0.5, (500, 2)), columns=["a", "b"]))
    m = ocsvm.fit(df, ["a", "b"], 0.1, passes=60)
    assert m.history[0] == pytest.approx(0.1) and all(b <= a + 1e-12 for a, b in zip(m.history, m.history[1:]))
    assert m.history[-1] < 0.1 * 0.9
    # compare with a fine search around the reached point
    x = np.array(df.collect())
    value = lambda w, b: 0.05 * w @ w + 0.1 * b + np.mean(np.maximum(0, 1 - x @ w - b))
    reached = value(np.array(m.weights), m.bias)
    assert reached == pytest.approx(m.history[-1], rel=1e-9)
    trials = [value(np.array(m.weights) + rng.normal(0, 0.05, 2), m.bias + rng.normal(0, 0.1)) for _ in range(3000)]
    assert min(trials) > reached - 1e-3
    scores = [r[0] for r in m.score(df).select("s_if").collect()]
    assert min(scores) == 0.0 and max(scores) == 1.0


def test_forest_finds_the_signal(signal):
    _, df = signal
    fitted = forest.fit(df, FEATURES, trees=10, depth=5)
    scored = fitted.predict(df, 0.5).toPandas()
    assert scored["p_rf"].between(0, 1).all()
    assert scored[scored["label"] == 1]["p_rf"].mean() > scored[scored["label"] == 0]["p_rf"].mean() + 0.3
    assert [r["feature"] for r in fitted.top_importances(df, 2).collect()] in (["f0", "f1"], ["f1", "f0"])


def test_selection_is_dropped_below_five():
    few = [(f"f{i}", v) for i, v in enumerate([0.9, 0.02, 0.02, 0.02, 0.02, 0.02])]
    assert forest.select_features(few) == [f for f, _ in few]
    many = [(f"f{i}", 0.2 if i < 5 else 0.0) for i in range(8)]
    assert forest.select_features(many) == ["f0", "f1", "f2", "f3", "f4"]


def test_calibration_is_monotone(signal):
    _, df = signal
    from telvane.operators.split import split_column

    scored = df.withColumn("s", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("f0") / 5))).withColumn("split", split_column())
    slope, _ = forest.platt(scored, "s")
    assert slope > 0


def test_normal_class_index():
    assert forest.normal_class_index(["Attack", "benign"]) == 1
    assert forest.normal_class_index([0, 1]) == 0
    assert forest.normal_class_index(["x", "y"]) == 0
    assert forest.normal_class_index([]) is None


def test_model_queries_train_by_the_default_plan(monkeypatch):
    from inspect import signature
    from unittest.mock import MagicMock

    from telvane.plans import catalog, flows, queries_models

    catalog.load_all()
    whole = flows.TrainingPlan()
    want = {"plan": whole, "trees": whole.trees, "depth": whole.depth, "passes": whole.passes, "classes": 3}
    seen = []

    class Stop(Exception):
        pass

    def stop(call):
        def run(*args, **kwargs):
            bound = signature(call).bind(*args, **kwargs)
            bound.apply_defaults()
            seen.append({k: v for k, v in bound.arguments.items() if k in want})
            raise Stop

        return run

    for owner, names in ((flows, ("train_detector", "zero_day", "profiling_ablation")), (forest, ("fit", "fit_plain", "cross_validate")), (ocsvm, ("fit", "tune_nu"))):
        for name in names:
            monkeypatch.setattr(owner, name, stop(getattr(owner, name)))
    monkeypatch.setattr(ocsvm, "normal_training_rows", MagicMock())
    for name in ("_prepared", "_line_train"):
        monkeypatch.setattr(queries_models, name, MagicMock())
    names = ["m01_one_class_svm", "m03_nu_search", "m04_random_forest", "m05_feature_selection", "m06_calibrated_forest", "m07_cross_validation", "m09_full_prediction",
             "m11_top_importances", "m13_score_table", "s12_saved_detector", "e12_zero_day", "e19_profiling_ablation", "e21_cross_dataset", "b14_sensitivity_metrics"]
    for name in names:
        with pytest.raises(Stop):
            catalog.QUERIES[name](MagicMock(), "none")
        assert seen[-1] and all(v == want[k] for k, v in seen[-1].items()), name
