import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telvane.operators.evaluate import metrics
from telvane.operators.ranking import empirical_rank, ranking_metrics


def brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    ap, before = 0.0, 0
    for t in np.unique(s)[::-1]:
        tp, n = np.sum((s >= t) & (y == 1)), np.sum(s >= t)
        ap += (tp - before) / len(pos) * tp / n
        before = tp
    return auc, ap


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 2000
    y = rng.integers(0, 2, n)
    # a third of all rows share one score, and most others crowd into a narrow range
    s = np.where(rng.random(n) < 0.33, 0.5, 0.997 + 1e-4 * rng.random(n) * (1 + y))
    return pd.DataFrame({"label": y, "score": s, "id": np.arange(n)})


@pytest.mark.parametrize("per_bucket", [25, 10**6])
def test_auc_and_ap(spark, scored, per_bucket):
    r = ranking_metrics(spark.createDataFrame(scored), digits=None, rows_per_bucket=per_bucket).first()
    auc, ap = brute(scored["label"].to_numpy(), scored["score"].to_numpy())
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert r["avg_precision"] == pytest.approx(ap, abs=1e-12)


def test_ties_and_single_class(spark):
    rows = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("one", 1, 0.3), ("one", 1, 0.4)]
    df = spark.createDataFrame(rows, "k string, label int, score double")
    got = {r["k"]: (r["roc_auc"], r["avg_precision"]) for r in ranking_metrics(df, ["k"]).collect()}
    assert got["a"] == (0.875, 0.8333)
    assert got["one"] == (0.0, 0.0)


@pytest.mark.parametrize("per_bucket", [25, 10**6])
def test_empirical_rank_counts_ties(spark, scored, per_bucket):
    df = spark.createDataFrame(scored)
    got = {r["id"]: r["rank"] for r in empirical_rank(df, "score", F.col("id") % 3 == 0, "rank", per_bucket).collect()}
    ref = np.sort(scored.loc[scored["id"] % 3 == 0, "score"].to_numpy())
    expected = np.searchsorted(ref, scored["score"].to_numpy(), side="right") / len(ref)
    assert len(got) == len(scored) and all(got[i] == pytest.approx(expected[i], abs=1e-12) for i in got)


def test_zero_divisions_give_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, score double")
    r = metrics(df, 0.5).first()
    assert (r["precision"], r["recall"], r["f1"], r["fpr"], r["fnr"]) == (0.0, 0.0, 0.0, 0.0, 0.0)
