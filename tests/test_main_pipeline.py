"""The main flow end to end, its saved detector on tables and streams, and every fusion method in a bundle."""

import math

import pytest
from pyspark.sql import functions as F

from telvane.operators.alerts import rounded
from telvane.plans import flows, views
from telvane.streaming import alerts

PLAN = flows.TrainingPlan(trees=6, depth=6, passes=4, rebalance=False, alphas=[0.3, 0.6], select=True, calibrate=True)


@pytest.fixture(scope="module")
def run(spark, sf):
    return flows.main_pipeline(flows.prepare(views.flow_events(spark, sf)), PLAN)


def test_choices_follow_the_validation_rows(run):
    best = [r for r in run.comparison.collect() if r["best"]]
    assert [r["method"] for r in best] == [run.detector.method]
    assert best[0]["f1"] == max(r["f1"] for r in run.comparison.collect())
    assert len(run.detector.forest.calibrated) == 3 and 0.1 <= run.detector.tau <= 0.9
    m = run.metrics.first()
    test = run.scores.filter("split = 'test'")
    assert m["tp"] + m["fp"] == test.filter(F.col("score") >= run.detector.tau).count()
    assert m["best_method"] == run.detector.method
    assert run.summary.first()["total_alerts"] == run.alerts.count() == run.alerts.select("alert_id").distinct().count()


def test_every_method_survives_saving(spark, run, tmp_path):
    d = run.detector
    rows = run.scores.select("row_id", "s_if", "p_rf")
    for method in ("weighted_linear", "max", "product", "stacking", "bayesian_reliability"):
        d.method = method
        d.save(str(tmp_path / method))
        loaded = flows.Detector.load(spark, str(tmp_path / method))
        assert (loaded.method, loaded.tau, loaded.tau_rf, loaded.load_scale) == (method, d.tau, d.tau_rf, d.load_scale)
        for r in rows.withColumn("a", d.fused()).withColumn("b", loaded.fused()).limit(50).collect():
            s, p = min(1.0, max(0.0, r["s_if"])), r["p_rf"]
            w, (u, v) = d.stacker, d.reliability
            want = {"weighted_linear": d.alpha * s + (1 - d.alpha) * p, "max": max(s, p), "product": s * p,
                    "stacking": 1 / (1 + math.exp(-(w[0] * s + w[1] * p + w[2]))), "bayesian_reliability": (u * s + v * p) / max(u + v, 1e-8)}[method]
            assert r["a"] == r["b"] == pytest.approx(min(1.0, max(0.0, want)))


def test_a_loaded_detector_raises_the_same_alerts_on_a_stream(spark, sf, run, tmp_path):
    flow = views.flow_events(spark, sf)
    flow.repartition(3).write.parquet(str(tmp_path / "arriving"))
    run.detector.save(str(tmp_path / "bundle"))
    loaded = flows.Detector.load(spark, str(tmp_path / "bundle"))
    stream = alerts.read_files(spark, str(tmp_path / "arriving"), flow.schema, 1)
    got = {r["alert_id"]: r.asDict() for r in alerts.run_to_table(flows.detect_stream(loaded, stream)).collect()}
    table = rounded(run.detector.alerts(run.detector.score(run.detector.prepare(flow))))
    want = {r["alert_id"]: r.asDict() for r in table.collect()}
    assert got and got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["fused_score"] == pytest.approx(r["fused_score"], abs=1e-4) and got[k]["alert_level"] == r["alert_level"]


def test_missing_values_in_arriving_rows(spark, sf, run):
    flow = views.flow_events(spark, sf).limit(5).withColumn("byte_rate", F.lit(None).cast("double"))
    assert all(r["score"] is not None for r in run.detector.score(run.detector.prepare(flow)).collect())
