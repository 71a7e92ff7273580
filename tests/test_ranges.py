"""Prefix sums, empirical ranks and exact shares at tiny limits, with hot scores, nulls and strata of all sizes."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from telvane.functions.scalars import digest
from telvane.operators import ranking, split
from telvane.operators.buckets import bucketed


@pytest.mark.parametrize(("limit", "descending"), [(1, False), (7, True), (40, False), (10**6, True)])
def test_running_totals(spark, limit, descending):
    rng = np.random.default_rng(limit)
    rows = [(s, float(k), int(rng.integers(1, 9)), 1) for s in ("a", "b", None) for k in rng.permutation(150 if s == "a" else 20)]
    rows.append(("a", None, 5, 5))
    df = spark.createDataFrame(rows, "s string, k double, x long, __group long").withColumnRenamed("__group", "y")
    got = {(r["s"], r["k"]): (r["sx"], r["sy"]) for r in bucketed(df, ["s"], "k", {"sx": "x", "sy": "y"}, limit, descending).collect()}
    want = {}
    for s, k, *_ in rows[:-1]:
        own = [r for r in rows[:-1] if r[0] == s and (r[1] >= k if descending else r[1] <= k)]
        want[s, k] = (sum(r[2] for r in own), len(own))
    assert got == want


@pytest.mark.parametrize("limit", [5, 10**6])
def test_ranks_with_a_third_on_one_score(spark, limit):
    rng = np.random.default_rng(2)
    scores = [0.5] * 100 + [None] * 5 + rng.integers(0, 40, 200).astype(float).tolist()
    rows = [(i, s, bool(rng.random() < 0.5)) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "i int, s double, ref boolean")
    got = {r["i"]: r["rank"] for r in ranking.empirical_rank(df, "s", F.col("ref"), "rank", limit).collect()}
    ref = [s for _, s, r in rows if r and s is not None]
    assert got == {i: None if s is None else sum(x <= s for x in ref) / len(ref) for i, s, _ in rows}


@pytest.mark.parametrize(("prefix", "limit"), [(1, 10), (1, 1), (3, 10), (5, 10**6)])
def test_bands_by_a_refined_digest(spark, prefix, limit):
    sizes = {"x": 300, "y": 41, None: 25, "z": 1}
    rows = [(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "row_id string, s string")
    cuts = F.array(F.floor(F.col("__n") * 0.7 + 0.5), F.floor(F.col("__n") * 0.8 + 0.5))
    got = {r["row_id"]: r["band"] for r in split.ranked_bands(df, "s", cuts, prefix=prefix, limit=limit).collect()}
    keys = {r["row_id"]: r["d"] for r in df.select("row_id", digest(split.SEED, "row_id").alias("d")).collect()}
    want = {}
    for s, n in sizes.items():
        edges = [int(n * 0.7 + 0.5), int(n * 0.8 + 0.5)]
        for rank, name in enumerate(sorted((r for r, t in rows if t == s), key=lambda r: keys[r])):
            want[name] = sum(e <= rank for e in edges)
    assert got == want and len(keys) == len(rows)


def test_bands_of_equal_keys(spark):
    df = spark.createDataFrame([("same", "x")] * 50, "row_id string, s string")
    got = collections.Counter(r["band"] for r in split.ranked_bands(df, "s", F.array(F.lit(20)), limit=10).collect())
    assert got == {0: 20, 1: 30}


def test_sample_and_split_of_empty_tables(spark):
    df = spark.createDataFrame([], "row_id string, label int")
    assert split.stratified_split(df).collect() == [] and split.stratified_sample(df, 5).collect() == []
