"""A saved detector scores as it did before saving: with a calibrated ensemble, with and without profiles."""

import pytest

from telvane.plans import flows, views


@pytest.mark.parametrize("mode", ["none", "both"])
def test_saved_detector(spark, sf, tmp_path, mode):
    prepared = flows.prepare(views.flow_events(spark, sf))
    plan = flows.TrainingPlan(trees=2, depth=2, passes=2, rebalance=False, alphas=[0.45])
    detector, _ = flows.train_detector(prepared, plan, mode=mode)
    model = detector.forest.model
    detector.forest.calibrated = [(model, 2.0, -1.0), (model, 1.0, 0.5)]
    detector.save(str(tmp_path / "bundle"))
    loaded = flows.Detector.load(spark, str(tmp_path / "bundle"))
    rows = prepared.part("test")
    before, after = ({r["row_id"]: (r["p_rf"], r["score"]) for r in d.score(rows).collect()} for d in (detector, loaded))
    assert before and before.keys() == after.keys()
    assert all(after[k] == pytest.approx(v) for k, v in before.items())
