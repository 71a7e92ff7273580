"""Queries: score fusion and threshold search."""

from __future__ import annotations

from pyspark.sql import functions as F

from telvane.functions import confusion as C
from telvane.functions import fusion
from telvane.operators import search as S
from telvane.operators.evaluate import alpha_sweep
from telvane.operators.harmonise import append_all
from telvane.operators.ranking import empirical_rank, ranking_metrics
from telvane.plans import sql as Q
from telvane.plans import views
from telvane.plans.catalog import query, rounded

STACKER = (1.5, 2.5, -2.0)


def _scores(spark, sf, split: str | None = None):
    sc = views.scores_events(spark, sf)
    return sc.filter(F.col("split") == split) if split else sc


def _one(name: str, expression: str):
    return Q.with_(Q.SCORES, body=f"SELECT row_id, round({expression}, 8) AS fused FROM sc")


def _fused(method: str, **kw):
    return lambda spark, sf: rounded(_scores(spark, sf).select("row_id", fusion.fuse(method=method, **kw).alias("fused")), 8)


query("f01_weighted_linear", _one("f01", Q.fused()))(_fused("weighted_linear"))
query("f02_maximum", _one("f02", "greatest(s_if, p_rf)"))(_fused("max"))
query("f03_product", _one("f03", "s_if * p_rf"))(_fused("product"))
query("f04_stacking", _one("f04", "1e0 / (1e0 + exp(-(1.5e0 * s_if + 2.5e0 * p_rf - 2e0)))"))(_fused("stacking", stacker=STACKER))

_VAL = "vl AS (SELECT * FROM sc WHERE split = 'val')"
_AUCS = ["va AS (SELECT label, s_if AS score FROM vl)", Q.ranking("va", out="ra"), "vb AS (SELECT label, p_rf AS score FROM vl)", Q.ranking("vb", out="rb")]


def reliability(spark, sf) -> tuple[float, float]:
    """Validation AUC of either score."""
    long = S.stack_methods(_scores(spark, sf, "val"), {"s_if": F.col("s_if"), "p_rf": F.col("p_rf")}, ["label"])
    got = {row["method"]: row["roc_auc"] for row in ranking_metrics(long, ["method"], digits=None).collect()}
    return got["s_if"], got["p_rf"]


@query("f05_reliability_weighted", Q.with_(Q.SCORES, _VAL, *_AUCS, body="""
SELECT row_id, round((ra.auc * s_if + rb.auc * p_rf) / greatest(ra.auc + rb.auc, 1e-8), 8) AS fused FROM sc, ra, rb"""))
def _(spark, sf):
    weights = reliability(spark, sf)
    return rounded(_scores(spark, sf).select("row_id", fusion.fuse(method="bayesian_reliability", reliability=weights).alias("fused")), 8)


def ranked(df, columns=("s_if", "p_rf")):
    """Empirical rank of both scores against the validation rows."""
    for c in columns:
        df = empirical_rank(df, c, F.col("split") == "val", f"rank_{c}")
    return df


_RANKS = "(SELECT count(*) FROM vl WHERE vl.{c} <= sc.{c}) / CAST((SELECT count(*) FROM vl) AS DOUBLE)"


@query("f06_rank_based", Q.with_(Q.SCORES, _VAL, body=f"""SELECT row_id, round(0.45e0 * {_RANKS.format(c='s_if')} + (1e0 - 0.45e0) * {_RANKS.format(c='p_rf')}, 8) AS fused FROM sc"""))
def _(spark, sf):
    out = ranked(_scores(spark, sf))
    return rounded(out.select("row_id", fusion.fuse(method="rank_based", ranks=("rank_s_if", "rank_p_rf")).alias("fused")), 8)


_ALPHAS = "al AS (SELECT i, i / 20e0 AS alpha FROM range(0, 21) t(i))"
_ALPHA_COUNTS = f"ac AS (SELECT i, alpha, {Q.counts(Q.fused('alpha') + ' >= 0.5e0')} FROM vl, al GROUP BY i, alpha)"


@query("f07_alpha_search", Q.with_(Q.SCORES, _VAL, _ALPHAS, _ALPHA_COUNTS, body=f"""
SELECT alpha, round({Q.F1}, 4) AS f1 FROM ac ORDER BY {Q.F1} DESC, i LIMIT 1"""))
def _(spark, sf):
    return S.best_alpha(_scores(spark, sf, "val"))


@query("f07_alpha_table", Q.with_(Q.SCORES, _VAL, _ALPHAS, _ALPHA_COUNTS, body="SELECT alpha, tp, fp, tn, fn FROM ac"))
def _(spark, sf):
    return S.alpha_counts(_scores(spark, sf, "val")).select("alpha", *C.COUNTS)


_METHODS = f"""lg AS (SELECT 0 AS i, 'weighted_linear' AS method, label, {Q.fused()} AS score FROM vl
UNION ALL SELECT 1, 'max', label, greatest(s_if, p_rf) FROM vl UNION ALL SELECT 2, 'product', label, s_if * p_rf FROM vl
UNION ALL SELECT 3, 'stacking', label, 1e0 / (1e0 + exp(-(1.5e0 * s_if + 2.5e0 * p_rf - 2e0))) FROM vl)"""


@query("f08_compare_methods", Q.with_(Q.SCORES, _VAL, _METHODS, f"c AS (SELECT i, method, {Q.counts('score >= 0.5e0')} FROM lg GROUP BY i, method)",
       Q.ranking("lg", "method"), body=f"""SELECT c.method, round({Q.F1}, 4) AS f1, round(auc, 4) AS roc_auc, round({Q.FPR}, 4) AS fpr,
  row_number() OVER (ORDER BY round({Q.F1}, 4) DESC, i) = 1 AS best FROM c JOIN rk ON c.method = rk.method"""))
def _(spark, sf):
    return S.compare_methods(_scores(spark, sf, "val"), 0.45, STACKER)


def grid(steps: int, top: int, source: str = "vl", score: str = "score", keys: str = "", out: str = "gc") -> str:
    """Brute-force counts at every threshold i/steps."""
    k = f"{keys}, " if keys else ""
    return f"""{out}_t AS (SELECT i, i / {steps}e0 AS threshold FROM range(1, {top + 1}) t(i)),
{out} AS (SELECT {k}i, threshold, {Q.counts(f'{score} >= threshold')} FROM {source}, {out}_t GROUP BY {k}i, threshold)"""


SMALL_FPR = f"({Q.F1} - 0.05e0 * {Q.FPR})"
RECALL_995 = f"(CASE WHEN {Q.RECALL} >= 0.995e0 THEN -({Q.FPR}) ELSE {Q.RECALL} - 1e0 END)"
F1_FPR = f"({Q.F1} - 0.3e0 * {Q.FPR})"
_FV = f"fv AS (SELECT label, s_if, p_rf, {Q.fused()} AS score FROM vl)"


def _best(objective: str, g: str = "gc") -> str:
    return f"SELECT threshold, tp, fp, tn, fn, round({objective}, 6) AS objective FROM {g} ORDER BY {objective} DESC, i LIMIT 1"


def _best_of(objective: str, score: str):
    inner = _best(objective)
    return f"SELECT '{score}' AS goal, * FROM ({inner})"


def _fused_val(spark, sf):
    return _scores(spark, sf, "val").withColumn("score", fusion.fuse())


@query("f09_best_threshold", Q.with_(Q.SCORES, _VAL, _FV, grid(100, 99, "fv"), body=f"""
{_best_of(SMALL_FPR, 'f1_small_fpr')} UNION ALL {_best_of(RECALL_995, 'recall_995')}"""))
def _(spark, sf):
    val = _fused_val(spark, sf)
    return append_all([
        S.best_threshold(val, goal=g).select(F.lit(g).alias("goal"), "threshold", *C.COUNTS, F.round("objective", 6).alias("objective"))
        for g in ("f1_small_fpr", "recall_995")
    ])


@query("f09_threshold_counts", Q.with_(Q.SCORES, _VAL, _FV, grid(100, 99, "fv"), body="SELECT threshold, tp, fp, tn, fn FROM gc"))
def _(spark, sf):
    return S.threshold_counts(_fused_val(spark, sf)).select("threshold", *C.COUNTS)


def joint(alphas: str, source: str = "vl") -> str:
    """CTEs ending in ``jb``: per alpha the first best threshold and its F1."""
    return f"""ja AS ({alphas}), jf AS (SELECT a, alpha, label, {Q.fused('alpha')} AS score FROM {source}, ja),
{grid(100, 99, 'jf', 'score', 'a, alpha', 'jg')},
jb AS (SELECT *, {Q.F1} AS f1, row_number() OVER (PARTITION BY a ORDER BY {SMALL_FPR} DESC, i) AS rn FROM jg)"""


@query("f10_joint_search", Q.with_(Q.SCORES, _VAL, joint("SELECT i AS a, i / 20e0 AS alpha FROM range(2, 15) t(i)"), body="""
SELECT alpha, threshold, round(f1, 4) AS f1 FROM jb WHERE rn = 1 ORDER BY jb.f1 DESC, a LIMIT 1"""))
def _(spark, sf):
    return S.best_alpha_and_threshold(_scores(spark, sf, "val"))


@query("f11_anomaly_threshold", Q.with_(Q.SCORES, _VAL, grid(20, 19, "vl", "s_if"), body=_best(F1_FPR)))
def _(spark, sf):
    best = S.best_threshold(_scores(spark, sf, "val"), "s_if", grid=S.COARSE, goal="f1_fpr")
    return best.select("threshold", *C.COUNTS, F.round("objective", 6).alias("objective"))


@query("f12_classifier_threshold", Q.with_(Q.SCORES, _VAL, grid(20, 19, "vl", "p_rf"), body=_best(Q.F1)))
def _(spark, sf):
    best = S.best_threshold(_scores(spark, sf, "val"), "p_rf", grid=S.COARSE, goal="f1")
    return best.select("threshold", *C.COUNTS, F.round("objective", 6).alias("objective"))


@query("f13_top_thresholds", Q.with_(Q.SCORES, _VAL, grid(20, 19, "vl", "s_if"), f"""tr AS (SELECT i, threshold, round({Q.F1}, 4) AS f1, round({Q.FPR}, 4) AS fpr FROM gc)""", body="""
SELECT threshold, f1, fpr FROM (SELECT *, f1 - 0.3e0 * fpr AS o FROM tr ORDER BY o DESC, i LIMIT 5)"""))
def _(spark, sf):
    return S.top_thresholds(_scores(spark, sf, "val"), "s_if", goal="f1_fpr").select("threshold", "f1", "fpr")


_TEST = "ts_ AS (SELECT * FROM sc WHERE split = 'test')"
_RATES = f"round({Q.PRECISION}, 4) AS precision, round({Q.RECALL}, 4) AS recall, round({Q.F1}, 4) AS f1, round({Q.FPR}, 4) AS fpr"
_TAUS = "tu(tau) AS (VALUES " + ", ".join(f"({Q.d(t)})" for t in sorted([*S.TAUS_RAISED, 0.5])) + ")"


@query("f14_tau_sweep", Q.with_(Q.SCORES, _TEST, _TAUS, f"c AS (SELECT tau, {Q.counts(Q.fused() + ' >= tau')} FROM ts_, tu GROUP BY tau)",
       body=f"SELECT tau, tp, fp, tn, fn, {_RATES} FROM c"))
def _(spark, sf):
    return S.tau_sweep(_scores(spark, sf, "test").withColumn("score", fusion.fuse()), sorted([*S.TAUS_RAISED, 0.5]))


_SWEEP = "SELECT row_number() OVER () - 1 AS a, alpha FROM (VALUES " + ", ".join(f"({Q.d(a)})" for a in S.ALPHAS_SENSITIVITY) + ") t(alpha)"


@query("f14_alpha_sweep", Q.with_(Q.SCORES, _VAL, _TEST, joint(_SWEEP),
       f"tf AS (SELECT ja.a, ja.alpha, label, {Q.fused('ja.alpha')} AS score FROM ts_, ja)",
       f"tc AS (SELECT tf.alpha, jb.threshold, {Q.counts('score >= threshold')} FROM tf JOIN jb ON tf.a = jb.a AND jb.rn = 1 GROUP BY tf.alpha, jb.threshold)",
       Q.ranking("tf", "alpha"), body=f"""SELECT tc.alpha, round(threshold, 4) AS threshold, {_RATES}, round({Q.FNR}, 4) AS fnr, round(auc, 4) AS roc_auc,
  round(ap, 4) AS avg_precision, tp, fp, tn, fn FROM tc JOIN rk ON tc.alpha = rk.alpha"""))
def _(spark, sf):
    return alpha_sweep(_scores(spark, sf, "val"), _scores(spark, sf, "test"), S.ALPHAS_SENSITIVITY)
