"""The compiled loops against numpy, and nodes cut inside a task against the same nodes cut by passes over the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telvane.operators import forest
from telvane.operators import trees as T
from telvane.operators.kernels import kernel


def awkward(rng, n):
    """Ties, signed zeros, infinities, nulls, a constant, values that differ in their last bits only."""
    return np.stack([
        rng.integers(0, 5, n).astype(float), rng.normal(size=n), np.full(n, 3.0), rng.choice([0.0, -0.0, np.inf, -np.inf, np.nan, 1.0], n),
        1.0 + rng.integers(0, 2000, n) * 2.0**-52, -rng.exponential(size=n) ** 9,
    ], 1)


def test_subtrees_equal_numpy(spark):
    rng = np.random.default_rng(5)
    tasks = []
    for n in (0, 1, 2, 9, 40, 300, 3000):
        for depth, tried in ((None, None), (3, 6), (None, 1)):
            y, c = (rng.random(n) < 0.3).astype(np.int64), rng.integers(1, 6, n)
            n0, n1 = np.bincount(y, c, 2)
            growth = T.Growth(depth=depth, tried=tried)
            head = T.task_head(n, [np.zeros(0)] * 6, int(rng.integers(1 << 62)) * 2 + 1, 0, T.class_weights(np.array(n0), np.array(n1)), growth)
            tasks.append((len(tasks), head, awkward(rng, n).tobytes(), T.low_bits(c, y)))
    assert kernel(spark, "Grow") is not None
    found = {r["i"]: bytes(r["nodes"]) for r in T.subtrees(spark.createDataFrame(tasks, f"i int, {T.TASK}")).collect()}
    for i, head, x, low in tasks:
        got, want = (T.unpacked_nodes(b, 6) for b in (found[i], T.grown_here(head, x, low)))
        assert all(np.array_equal(a, b) for a, b in zip(got[:3], want[:3])) and got[3] == pytest.approx(want[3], rel=1e-9)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 900
    x = awkward(rng, n)
    y = (rng.random(n) < 0.2 + 0.4 * (np.nan_to_num(x[:, 1]) > 0.5)).astype(int)
    data = [(f"r{i}", int(y[i]), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(n)]
    return spark.createDataFrame(data, "row_id string, label int, " + ", ".join(f"f{j} double" for j in range(6))).repartition(5).cache()


@pytest.mark.parametrize(("limit", "bins", "depth"), [(30, 4, None), (200, 16, None), (30, 2, 5)])
def test_tasks_cut_large_nodes_as_passes_do(rows, monkeypatch, limit, bins, depth):
    """The same trees, and no pass over the rows for nodes that fit a task: before, each level of large nodes took one."""
    names, growth = [f"f{j}" for j in range(6)], T.Growth(5, depth, bins, limit=limit, wave=3)
    passes, counted = [], T._histograms
    monkeypatch.setattr(T, "_histograms", lambda *a: passes.append(1) or counted(*a))
    got = []
    for small, room in ((T.SMALL, T.ROOM), (0, T.ROOM), (0, 150 * 49), (0, 0)):  # whole trees, trees from routed rows, lower parts, passes only
        monkeypatch.setattr(T, "SMALL", small), monkeypatch.setattr(T, "ROOM", room)
        passes.clear()
        fitted = forest.fit_models(rows, names, {0: F.lit(True)}, growth)[0]
        scores = {r["row_id"]: r["p"] for r in rows.withColumn("p", fitted.probability()).collect()}
        got.append((scores, dict(fitted.importances()), len(passes)))
    assert [g[2] > 0 for g in got] == [False, False, got[2][2] > 0, True]
    for scores, importances, _ in got[1:]:
        assert scores == got[0][0] and importances == pytest.approx(got[0][1], rel=1e-9)


def test_numpy_takes_over(spark, rows, monkeypatch):
    """Where the session compiles nothing, the same trees come from numpy."""
    names, growth = [f"f{j}" for j in range(6)], T.Growth(4, limit=100)
    want, got = [], []
    for out in (want, got):
        fitted = forest.fit_models(rows, names, {0: F.lit(True)}, growth)[0]
        out += sorted((r["row_id"], r["p"]) for r in rows.withColumn("p", fitted.probability()).collect())
        monkeypatch.setattr(T, "kernel", lambda spark, name: None)
    assert got == want


def test_large_forests_stay_on_the_executors(spark, rows, monkeypatch):
    """Trees that would be too large to broadcast meet the rows in blocks: the same scores, and nothing passes the driver."""
    names = [f"f{j}" for j in range(6)]
    folds = forest.with_folds(rows, 3).withColumn("again", F.lit(1)).unionByName(forest.with_folds(rows, 3).withColumn("again", F.lit(2)))
    fitted = forest.fit_models(folds, names, {i: F.col("fold") != i for i in range(3)}, T.Growth(7))
    calibrated = forest.Forest(fitted[0], names, [(fitted[0], 1.5, -0.2), (fitted[1], 2.0, 0.1)])

    def found():
        one = {(r["row_id"], r["again"]): r["p_rf"] for r in forest.Forest(fitted[2], names).score(folds).collect()}
        held = {(r["row_id"], r["again"]): r["p"] for r in forest._held_out(folds, fitted, "p").collect()}
        return one, held, {(r["row_id"], r["again"]): r["p_rf"] for r in calibrated.score(folds).collect()}

    want = found()
    for model in fitted.values():
        monkeypatch.setattr(model, "parts", lambda: pytest.fail("the forest passed the driver"))
    monkeypatch.setattr(T, "LARGE", 100), monkeypatch.setattr(T, "BUNDLE", 5000), monkeypatch.setattr(T, "SMALL", 20_000)
    got = found()
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-11) and len(b) == 2 * rows.count()
    empty = forest.Forest(fitted[2], names).score(folds.limit(0))
    assert empty.count() == 0 and empty.columns == [*folds.columns, "p_rf"]
