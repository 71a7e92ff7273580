"""Forests against trees grown one node at a time, in memory and by passes; scoring against walking node by node."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telvane.operators import forest
from telvane.operators import trees as T

NAMES = [f"f{i}" for i in range(5)]


@pytest.fixture(scope="module")
def table(spark):
    """Ties, a constant feature, nulls, skewed values; classes that no tree can separate fully."""
    rng = np.random.default_rng(11)
    n = 300
    y = (rng.random(n) < 0.25).astype(int)
    pdf = pd.DataFrame({"row_id": [f"r{i}" for i in range(n)], "label": y})
    pdf["f0"] = rng.integers(0, 4, n) + y
    pdf["f1"] = rng.integers(0, 9, n).astype(float)
    pdf["f2"] = 7.0
    pdf["f3"] = np.where(rng.random(n) < 0.9, 0.0, rng.integers(1, 6, n) ** 3)
    pdf["f4"] = np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 30, n) + 3 * y)
    pdf["fold"] = np.arange(n) % 3
    return pdf, spark.createDataFrame(pdf.astype({"f0": float})).replace(float("nan"), None)


def keys_of(df):
    return {r["row_id"]: r["k"] for r in df.select("row_id", F.xxhash64("row_id").alias("k")).collect()}


def by_hand(x, y, c, path, depth, weights, growth):
    """(feature, cut, left, right) or a probability."""
    x = np.where(np.isnan(x), np.inf, x)
    n0, n1 = (c * (y == 0)).sum() * weights[0], (c * (y == 1)).sum() * weights[1]
    p = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1 or (growth.depth is not None and depth >= growth.depth):
        return p
    mask = T.tried_features(np.array([path], np.uint64), x.shape[1], growth.features_tried(x.shape[1]))[0]
    for tried in (mask, ~mask):
        best = None
        for f in np.flatnonzero(tried):
            values = np.unique(x[:, f])
            for a, b in zip(values, values[1:]):
                left = x[:, f] <= a
                parts = [((c * (y == k))[side].sum() * weights[k]) for side in (left, ~left) for k in (0, 1)]
                score = sum((u * u + v * v) / (u + v) for u, v in (parts[:2], parts[2:]))
                if best is None or score > best[0] + 1e-9:
                    cut = a + (b - a) / 2
                    best = score, f, a, cut if math.isfinite(cut) and cut < b else a
        if best:
            left = x[:, best[1]] <= best[2]
            sides = T.child_paths(np.array([path], np.uint64)).tolist()
            return best[1], best[3], *(by_hand(x[s], y[s], c[s], k, depth + 1, weights, growth) for s, k in zip((left, ~left), sides))
    return p


def reach(node, row):
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def expected(pdf, keys, growth, model=0, rows=None):
    own = pdf if rows is None else pdf[rows]
    x, y, k = own[NAMES].to_numpy(float), own["label"].to_numpy(), np.array([keys[r] for r in own["row_id"]]).view(np.uint64)
    out = []
    for t in range(growth.trees):
        c = T.bag_counts(k, model, t, growth)
        sizes = [(c * (y == v)).sum() for v in (0, 1)]
        weights = [sum(sizes) / (2 * s) for s in sizes]
        out.append(by_hand(x[c > 0], y[c > 0], c[c > 0], T.root_path(model, t, growth), 0, weights, growth))
    rows = np.where(np.isnan(pdf[NAMES].to_numpy(float)), np.inf, pdf[NAMES].to_numpy(float))
    return np.array([np.mean([reach(t, r) for t in out]) for r in rows])


def scored(df, model):
    return {r["row_id"]: r["p"] for r in df.select("row_id", model.probability().alias("p")).collect()}


@pytest.mark.parametrize(("depth", "limit"), [(None, 200_000), (4, 200_000), (None, 40), (None, 7), (3, 40)])
def test_trees_equal_brute_force(table, depth, limit):
    """With a low limit upper nodes are split by histograms, whose bins hold one value each here."""
    pdf, df = table
    growth = T.Growth(3, depth, bins=400, limit=limit, wave=2)
    got = scored(df, forest.fit_models(df, NAMES, {0: F.lit(True)}, growth)[0])
    want = expected(pdf, keys_of(df), growth)
    assert got == pytest.approx(dict(zip(pdf["row_id"], want)), abs=1e-12)


@pytest.mark.parametrize("limit", [200_000, 25])
def test_partitioning_does_not_matter(table, limit):
    _, df = table
    growth = T.Growth(6, bins=4, limit=limit, wave=4)
    first = scored(df, forest.fit_models(df.repartition(7), NAMES, {0: F.lit(True)}, growth)[0])
    assert first == scored(df, forest.fit_models(df.coalesce(1).orderBy(F.desc("row_id")), NAMES, {0: F.lit(True)}, growth)[0])


@pytest.mark.parametrize("limit", [200_000, 30])
def test_many_forests_in_one_pass(spark, table, limit):
    """Each fold's forest equals one trained alone on its rows; the number of jobs does not depend on the folds."""
    pdf, df = table
    growth = T.Growth(4, bins=400, limit=limit, wave=100)
    keys = keys_of(df)
    jobs = []
    for folds in (2, 3):
        spark.sparkContext.setJobGroup(f"folds{folds}", "")
        fitted = forest.fit_models(df, NAMES, {i: F.col("fold") != i for i in range(folds)}, growth)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds{folds}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for i, model in fitted.items():
        want = expected(pdf, keys, growth, i, (pdf["fold"] != i).to_numpy())
        assert scored(df, model) == pytest.approx(dict(zip(pdf["row_id"], want)), abs=1e-12)
    assert jobs[1] - jobs[0] <= (2 if limit > 300 else 8)  # levels differ by the deepest tree


def test_weights_are_balanced_within_each_bag(table):
    pdf, df = table
    growth = T.Growth(5, depth=0)
    got = [t["cut"][0] for t in T.fit(T.training_rows(df, NAMES), 5, growth).orderBy("tree").collect()]
    assert got == pytest.approx([0.5] * 5)  # both classes weigh the same in every bag
    keys = np.array(list(keys_of(df).values())).view(np.uint64)
    counts = np.array([T.bag_counts(keys, 0, t, growth) for t in range(400)])
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.03 and (counts.sum(1) != len(keys)).any()


def test_rows_that_share_every_bin(spark):
    """Approximate quantiles put all values into one bin: ranges are halved until tasks can finish."""
    rows = [(f"a{i}", i % 2, 1.0 + (i % 2) * 1e-9 if i % 10 else 5.0) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id string, label int, f0 double")
    growth = T.Growth(2, bins=2, limit=20, bootstrap=False)
    got = scored(df, forest.fit_models(df, ["f0"], {0: F.lit(True)}, growth)[0])
    odd = sum(y for _, y, x in rows if x == 5.0) / 40
    assert all(got[i] == pytest.approx(odd if x == 5.0 else float(y)) for i, y, x in rows)


def test_awkward_tables(spark):
    schema = "row_id string, label int, f0 double, f1 double"
    empty = spark.createDataFrame([], schema)
    one = spark.createDataFrame([("a", 1, 2.0, None), ("b", None, 1.0, 1.0), (None, 0, 1.0, 1.0)], schema)
    for df, want in ((empty, 0.0), (one, 1.0)):
        for limit in (10, 0):
            model = forest.fit_models(df, ["f0", "f1"], {0: F.lit(True)}, T.Growth(3, limit=limit, bootstrap=False))[0]
            assert set(scored(one, model).values()) == {want}


def test_scoring_in_parts(monkeypatch, table):
    _, df = table
    model = forest.fit_models(df, NAMES, {0: F.lit(True)}, T.Growth(9))[0]
    whole = scored(df, model)
    monkeypatch.setattr(T, "PART", 2000)
    small = T.ArrayForest(model.table, NAMES)
    assert len(small.parts()) > 3 and scored(df, small) == pytest.approx(whole)


def test_importances_add_up(table):
    _, df = table
    shares = dict(forest.fit_models(df, NAMES, {0: F.lit(True)}, T.Growth(20))[0].importances())
    assert sum(shares.values()) == pytest.approx(1.0) and shares["f2"] == 0.0 and shares["f0"] > shares["f3"]


def test_sigmoids_of_all_folds_at_once(spark):
    """Newton steps for several groups reach the optimum of Platt's objective."""
    rng = np.random.default_rng(3)
    rows = [(g, float(s), int(rng.random() < 1 / (1 + math.exp(-(a * s + b))))) for g, (a, b) in enumerate([(4.0, -2.0), (-3.0, 1.0)]) for s in rng.random(400)]
    rows += [(2, float(i >= 20), int(i >= 20)) for i in range(40)]  # separable
    got = forest.platt_each(spark.createDataFrame(rows, "g int, s double, label int"), "s", "g")
    for g, (a, b) in got.items():
        s, y = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        q = 1 / (1 + np.exp(-(a * s + b)))
        assert abs(((q - t) * s).sum()) < 1e-5 and abs((q - t).sum()) < 1e-5


def test_passes_do_not_grow_with_the_number_of_trees(spark, monkeypatch):
    """The upper parts of all trees share the passes over the rows; trees of one model do not depend on the others."""
    rng = np.random.default_rng(3)
    rows = [(f"r{i}", int(rng.random() < 0.3), *map(float, rng.normal(size=3))) for i in range(600)]
    table = T.training_rows(spark.createDataFrame(rows, "row_id string, label int, a double, b double, c double"), ["a", "b", "c"])
    passes, counted = [], T._histograms
    monkeypatch.setattr(T, "_histograms", lambda *a: passes.append(1) or counted(*a))
    grown = {}
    for trees in (2, 9):
        passes.clear()
        grown[trees] = {r["tree"]: r for r in T.fit(table, 3, T.Growth(trees, limit=150, wave=2)).collect()}
        assert len(grown[trees]) == trees and len(passes) <= 12
    assert all(grown[9][t] == grown[2][t] for t in grown[2])


def test_best_cuts_pass_over_no_better_one():
    """Cuts left out between entries of one class never change the best one, its quality or which of equal ones is first."""
    rng = np.random.default_rng(4)
    for n, ranks in ((2, 2), (9, 4), (40, 12), (40, 400)):
        for _ in range(50):
            rank, y, c, node = rng.integers(0, ranks, n), rng.integers(0, 2, n), rng.integers(1, 5, n), np.sort(rng.integers(0, 3, n))
            total = np.stack([np.bincount(node, c * (y == k), 3) for k in (0, 1)], 1).astype(np.int64)
            total[(total == 0).any(1)] = 0
            open_ = (total > 0).all(1)[node]
            rank, y, c, node = rank[open_], y[open_], c[open_], node[open_]
            if not len(node):
                continue
            weights = np.array([[0.7, 1.9]])
            sums = total.sum(1) + (total[:, 1] << 32)
            found = T.best_cuts((node << (9 + T.LOW)) | (rank << T.LOW) | (c << 1) | y, 9, total, np.cumsum(sums) - sums, weights)
            want = []
            for k in np.unique(node).tolist():
                r, v, m = rank[node == k], y[node == k], c[node == k]
                cuts = []
                for a, b in zip(np.unique(r)[:-1].tolist(), np.unique(r)[1:].tolist()):
                    sides = [np.array([m[s & (v == i)].sum() for i in (0, 1)]) * weights[0] for s in (r <= a, r > a)]
                    cuts.append((sum(float(T.quality(*s)) for s in sides), -a, b))
                if cuts:
                    score, a, b = max(cuts)
                    want.append((k, score, -a, b))
            assert (list(zip(*(v.tolist() for v in found))) if found else []) == want


def test_scoring_by_many_trees_is_dealt_out(spark, table):
    """A table in one part is scored by all cores, with the same scores; few trees are not worth a shuffle."""
    _, df = table
    one = df.coalesce(1)
    for trees, spread in ((T.MANY, True), (2, False)):
        fitted = forest.Forest(forest.fit_plain(df, NAMES, trees, 3), NAMES)
        scored = fitted.score(one)
        assert (scored.rdd.getNumPartitions() > 1) == spread
        raw = {r["row_id"]: r["p"] for r in one.withColumn("p", fitted.model.probability()).collect()}
        assert {r["row_id"]: r["p_rf"] for r in scored.collect()} == raw


def test_small_batches_are_scored_together():
    batches = [(pd.Series([True] * n), pd.Series(np.arange(n) + 10.0 * n)) for n in (3, 4, 1, 2)]
    got = list(T.joined(iter(batches), 5))
    assert [len(b[0]) for b in got] == [7, 3]
    assert [v for b in got for v in b[1]] == [v for b in batches for v in b[1]]


def test_subtrees_hang_below_their_nodes():
    """Three subtrees, one of them a leaf, given in any order."""
    schema = pa.schema([("node", pa.int64()), ("feature", pa.list_(pa.int16())), ("cut", pa.list_(pa.float64())), ("child", pa.list_(pa.int32())), ("gain", pa.list_(pa.float64()))])
    rows = [
        {"node": 4, "feature": [2, -1, -1], "cut": [0.5, 0.1, 0.2], "child": [1, 0, 0], "gain": [0.0, 0.0, 3.0]},
        {"node": -1, "feature": [0, 1, -1, -1, -1], "cut": [9.0, 8.0, 0.0, 0.0, 0.0], "child": [1, 3, 0, 0, 0], "gain": [1.0, 2.0, 0.0]},
        {"node": 2, "feature": [-1], "cut": [0.7], "child": [0], "gain": [0.0, 0.0, 0.0]},
        {"node": 3, "feature": [1, 0, -1, -1, -1], "cut": [4.0, 3.0, 0.3, 0.4, 0.6], "child": [1, 3, 0, 0, 0], "gain": [5.0, 6.0, 0.0]},
    ]
    feature, cut, child, gain = T.hung(pa.Table.from_pylist(rows, schema))
    assert feature.tolist() == [0, 1, -1, 1, 2, 0, -1, -1, -1, -1, -1]
    assert cut.tolist() == [9.0, 8.0, 0.7, 4.0, 0.5, 3.0, 0.3, 0.4, 0.6, 0.1, 0.2]
    assert child.tolist() == [1, 3, 0, 5, 9, 7, 0, 0, 0, 0, 0]
    assert gain.tolist() == [6.0, 8.0, 3.0]
