"""Exact quantiles (linear interpolation) that do not hold a large column in one task.

Up to ``direct_rows`` rows a column is sorted in one aggregate. Beyond, an
approximate sketch brackets the wanted ranks, exact counts confirm the
bracket, and only the bracket's rows are looked at again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telvane.operators.buckets import bucketed
from telvane.operators.series import null_safe_join
from telvane.session import settle

DIRECT_ROWS = 500_000
SKETCH = 10_000


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], direct_rows: int | None = None
) -> dict[str, list[float | None]]:
    """column -> quantile values, nulls and NaN skipped. Two jobs for ordinary tables."""
    direct_rows = direct_rows or DIRECT_ROWS
    values = df.select(*[_value(c).alias(c) for c in columns])
    counts = values.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first().asDict()
    find = _from_sorted if counts["__rows"] <= direct_rows else _from_brackets
    found = find(values, {c: [_ranks(q, counts[c]) for q in probs] for c in columns if counts[c]}, counts, direct_rows)
    return {c: [_interpolate(q, counts[c], found[c]) if counts[c] else None for q in probs] for c in columns}


def quantiles_frame(df: DataFrame, columns: list[str], prob: float, direct_rows: int | None = None) -> DataFrame:
    """The same as a one-row DataFrame, one column per input column."""
    got = exact_quantiles(df, columns, [prob], direct_rows)
    schema = ", ".join(f"`{c}` double" for c in columns)
    return df.sparkSession.createDataFrame([tuple(got[c][0] for c in columns)], schema)


def grouped_quantile(
    df: DataFrame, group: str, columns: list[str], prob: float, direct_rows: int | None = None
) -> DataFrame:
    """One quantile per group and column. Groups above ``direct_rows`` are bracketed, all of them together."""
    direct_rows = direct_rows or DIRECT_ROWS
    values = df.select(group, *[_value(c).alias(c) for c in columns])
    sized = values.groupBy(group).agg(F.count(F.lit(1)).alias("__rows"), F.array(*[F.count(F.col(f"`{c}`")) for c in columns]).alias("__counts"))
    if (sized.agg(F.max("__rows")).first()[0] or 0) <= direct_rows:
        return values.groupBy(group).agg(*[F.percentile(F.col(f"`{c}`"), prob).alias(c) for c in columns])
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # never null
    large = settle(sized.filter(F.col("__rows") > direct_rows).withColumn("__key", key), "large-groups")
    small = null_safe_join(values, large.select(group), [group], "left_anti")
    direct = small.groupBy(group).agg(*[F.percentile(F.col(f"`{c}`"), prob).alias(c) for c in columns])
    held = null_safe_join(values, large, [group]).drop(group, "__rows")
    found = _grouped_values(held, columns, prob)
    return direct.unionByName(large.select(group, "__key").join(found, "__key", "left").select(group, *columns))


def _grouped_values(held: DataFrame, columns: list[str], prob: float) -> DataFrame:
    """__key and the quantile of each column; held: __key, __counts (values of each column) and the columns.

    A sketch of each group and column brackets the two wanted ranks, exact counts confirm the bracket (else all values
    stay in it), and running totals over the distinct values inside give the order statistics.
    """
    shares = [max(prob - 2 / SKETCH, 0.0), min(prob + 2 / SKETCH, 1.0)]
    sketch = held.groupBy("__key").agg(F.array(*[F.percentile_approx(F.col(f"`{c}`"), shares, SKETCH) for c in columns]).alias("__sketch"))
    sketch = settle(sketch, "sketch")
    checked = held.join(sketch, "__key")
    ends = lambda i: (F.col("__sketch")[i][0], F.col("__sketch")[i][1])
    counted = checked.groupBy("__key").agg(
        F.first("__sketch").alias("__sketch"), F.first("__counts").alias("__counts"),
        F.array(*[F.count(F.when(F.col(f"`{c}`") < ends(i)[0], 1)) for i, c in enumerate(columns)]).alias("__below"),
        F.array(*[F.count(F.when(F.col(f"`{c}`").between(*ends(i)), 1)) for i, c in enumerate(columns)]).alias("__inside"),
    )

    def bracket(i: int) -> Column:
        n, below, inside = F.col("__counts")[i], F.col("__below")[i], F.col("__inside")[i]
        at = F.lit(prob) * (n - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = (below <= low) & (high < below + inside)
        return F.struct(
            F.lit(i).alias("column"), at.alias("at"), low.alias("low"), high.alias("high"),
            F.when(holds, below).otherwise(0).alias("below"),
            F.when(holds, F.col("__sketch")[i][0]).otherwise(-math.inf).alias("first"),
            F.when(holds, F.col("__sketch")[i][1]).otherwise(math.inf).alias("last"),
        )

    brackets = settle(counted.select("__key", F.array(*[bracket(i) for i in range(len(columns))]).alias("__brackets")), "brackets")
    entry = lambda i, c: F.when(
        F.col(f"`{c}`").between(F.col("__brackets")[i]["first"], F.col("__brackets")[i]["last"]),
        F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").alias("value")),
    )
    inside = held.join(brackets, "__key").select("__key", F.explode(F.filter(F.array(*[entry(i, c) for i, c in enumerate(columns)]), lambda e: e.isNotNull())).alias("e"))
    per_value = inside.groupBy("__key", F.col("e.column").alias("column"), F.col("e.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    totals = bucketed(per_value, ["__key", "column"], "value", {"through": "n"})
    placed = totals.join(brackets.select("__key", F.explode("__brackets").alias("b")).select("__key", "b.*"), ["__key", "column"])
    through = F.col("through") + F.col("below")
    at_rank = lambda r: F.max(F.when((through > F.col(r)) & (through - F.col("n") <= F.col(r)), F.col("value")))
    ranked = placed.groupBy("__key", "column").agg(at_rank("low").alias("v"), at_rank("high").alias("w"), F.first("at").alias("at"), F.first("low").alias("low"), F.first("high").alias("high"))
    between = (F.col("high") - F.col("at")) * F.col("v") + (F.col("at") - F.col("low")) * F.col("w")
    settled = ranked.select("__key", "column", F.when(F.col("v") == F.col("w"), F.col("v")).otherwise(between).alias("value"))
    return settled.groupBy("__key").agg(*[F.max(F.when(F.col("column") == i, F.col("value"))).alias(c) for i, c in enumerate(columns)])


def _value(c: str) -> Column:
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


def _ranks(q: float, n: int) -> tuple[int, int]:
    at = q * (n - 1)
    return math.floor(at), math.ceil(at)


def _interpolate(q: float, n: int, by_rank: dict[int, float]) -> float:
    low, high = _ranks(q, n)
    if low == high or by_rank[low] == by_rank[high]:
        return by_rank[low]
    at = q * (n - 1)
    return (high - at) * by_rank[low] + (at - low) * by_rank[high]


def _from_sorted(values: DataFrame, wanted: dict, counts: dict, direct_rows: int) -> dict:
    """Order statistics of a small table: every column sorted once, only the wanted elements returned."""
    if not wanted:
        return {}
    ranks = {c: sorted({k for pair in pairs for k in pair}) for c, pairs in wanted.items()}
    lists = values.agg(*[F.sort_array(F.collect_list(F.col(f"`{c}`"))).alias(c) for c in ranks])
    row = lists.select(*[F.array(*[F.element_at(F.col(f"`{c}`"), k + 1) for k in ks]).alias(c) for c, ks in ranks.items()]).first()
    return {c: dict(zip(ks, row[c])) for c, ks in ranks.items()}


def _from_brackets(values: DataFrame, wanted: dict, counts: dict, direct_rows: int) -> dict:
    """Order statistics of a large table.

    Per column and probability a bracket [low, high] holds both ranks around the
    quantile. All brackets are narrowed together, by one sketch pass and one
    counting pass per round; a last pass counts the values left inside.
    """
    infinity = float("inf")
    brackets = [
        {"column": c, "ranks": pair, "low": -infinity, "high": infinity, "below": 0, "inside": counts[c], "open": counts[c] > direct_rows}
        for c, pairs in wanted.items() for pair in dict.fromkeys(pairs)
    ]
    while True:
        active = [b for b in brackets if b["open"]]
        if not active:
            break
        within = [F.col(b["column"]).between(b["low"], b["high"]) for b in active]
        shares = [[(k - b["below"]) / b["inside"] + side for k, side in zip(b["ranks"], (-2 / SKETCH, 2 / SKETCH))] for b in active]
        sketch = values.agg(*[
            F.percentile_approx(F.when(w, F.col(b["column"])), [min(max(p, 0.0), 1.0) for p in share], SKETCH).alias(f"b{i}")
            for i, (b, w, share) in enumerate(zip(active, within, shares))
        ]).first()
        checked = values.agg(*[
            x for i, (b, w) in enumerate(zip(active, within)) for x in (
                F.count(F.when(w & (F.col(b["column"]) < sketch[f"b{i}"][0]), 1)).alias(f"below{i}"),
                F.count(F.when(w & F.col(b["column"]).between(*sketch[f"b{i}"]), 1)).alias(f"inside{i}"),
            )
        ]).first()
        for i, b in enumerate(active):
            start, size = b["below"] + checked[f"below{i}"], checked[f"inside{i}"]
            holds = start <= b["ranks"][0] and b["ranks"][1] < start + size
            narrower = holds and size < b["inside"]
            if narrower:
                b["low"], b["high"] = sketch[f"b{i}"]
                b["below"], b["inside"] = start, size
            b["open"] = narrower and size > direct_rows and b["low"] < b["high"]
    return _values_at(values, brackets)


def _values_at(values: DataFrame, brackets: list[dict]) -> dict:
    """Values at the wanted ranks: counts per bracket and distinct value, then running totals."""
    entries = F.array(*[
        F.when(F.col(b["column"]).between(b["low"], b["high"]), F.struct(F.lit(i).alias("bracket"), F.col(b["column"]).alias("value")))
        for i, b in enumerate(brackets)
    ])
    inside = values.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("e.*")
    per_value = inside.groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = bucketed(per_value, ["bracket"], "value", {"through": "n"})
    hit = F.lit(False)
    for i, b in enumerate(brackets):
        for k in set(b["ranks"]):
            rank = F.lit(k - b["below"])
            hit = hit | ((F.col("bracket") == i) & (F.col("through") > rank) & (F.col("through") - F.col("n") <= rank))
    found: dict = {b["column"]: {} for b in brackets}
    for r in totals.filter(hit).collect():  # at most two rows per bracket
        b = brackets[r["bracket"]]
        for k in b["ranks"]:
            if r["through"] - r["n"] <= k - b["below"] < r["through"]:
                found[b["column"]][k] = r["value"]
    return found
