"""Queries: metrics and experiment tables over scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from telvane.functions import confusion as C
from telvane.functions import fusion
from telvane.functions.context import adaptive_tau
from telvane.operators import evaluate as E
from telvane.operators import search as S
from telvane.operators.harmonise import append_all
from telvane.operators.ranking import ranking_metrics
from telvane.plans import sql as Q
from telvane.plans import views
from telvane.plans.catalog import query
from telvane.plans.queries_alerts import BETA_CTES, LOSS, adaptive_inputs, suite_tau
from telvane.plans.queries_fusion import _FV, _RANKS, _RATES, _TEST, _VAL, SMALL_FPR, STACKER, grid, ranked, reliability
from telvane.schema import SUITE

FULL = f"{_RATES}, round({Q.FNR}, 4) AS fnr, round(auc, 4) AS roc_auc, round(ap, 4) AS avg_precision, tp, fp, tn, fn"


def _scores(spark, sf, split=None):
    sc = views.scores_events(spark, sf)
    return sc.filter(F.col("split") == split) if split else sc


@query("e01_confusion_counts", Q.with_(Q.SCORES, body=f"SELECT split, {Q.counts('p_rf >= 0.5e0')} FROM sc GROUP BY split"))
def _(spark, sf):
    return _scores(spark, sf).groupBy("split").agg(*C.confusion_counts("label", F.col("p_rf") >= 0.5))


@query("e02_rates", Q.with_(Q.SCORES, f"c AS (SELECT device_id, {Q.counts('p_rf >= 0.9e0')} FROM sc GROUP BY device_id)", body=f"SELECT device_id, {_RATES}, round({Q.FNR}, 4) AS fnr FROM c"))
def _(spark, sf):
    counts = _scores(spark, sf).groupBy("device_id").agg(*C.confusion_counts("label", F.col("p_rf") >= 0.9))
    return counts.select("device_id", *[c.alias(n) for n, c in C.rates().items()])


_SLICED = "sl AS (SELECT split, device_id, label, p_rf AS score FROM sc UNION ALL SELECT 'attacks only', device_id, label, p_rf FROM sc WHERE label = 1)"


def _sliced(spark, sf):
    sc = _scores(spark, sf).select("split", "label", F.col("p_rf").alias("score"))
    return sc.unionByName(sc.filter("label = 1").withColumn("split", F.lit("attacks only")))


@query("e03_roc_auc", Q.with_(Q.SCORES, _SLICED, Q.ranking("sl", "split"), body="SELECT split, round(auc, 6) AS roc_auc FROM rk"))
def _(spark, sf):
    return ranking_metrics(_sliced(spark, sf), ["split"], digits=6).select("split", "roc_auc")


@query("e04_average_precision", Q.with_(Q.SCORES, _SLICED, Q.ranking("sl", "split"), body="SELECT split, round(ap, 6) AS avg_precision FROM rk"))
def _(spark, sf):
    return ranking_metrics(_sliced(spark, sf), ["split"], digits=6).select("split", "avg_precision")


_ROW_TAU = "rt AS (SELECT split, label, p_rf AS score, 0.3e0 + z / 20e0 AS tau FROM sc)"


@query("e05_row_thresholds", Q.with_(Q.SCORES, _ROW_TAU, f"c AS (SELECT split, round(avg(tau), 4) AS threshold, {Q.counts('score >= tau')} FROM rt GROUP BY split)",
       Q.ranking("rt", "split"), body=f"SELECT c.split, threshold, {FULL} FROM c JOIN rk ON c.split = rk.split"))
def _(spark, sf):
    sc = _scores(spark, sf).withColumn("tau", F.lit(0.3) + F.col("z") / F.lit(20.0))
    return E.metrics(sc, "tau", "p_rf", slices=["split"])


_PREDICTED = "CASE WHEN p_rf >= 0.66e0 THEN 'HighValue' WHEN p_rf >= 0.33e0 THEN 'LowValue' ELSE 'Normal' END"


def _predicted(spark, sf):
    p = F.col("p_rf")
    return _scores(spark, sf).withColumn("prediction", F.when(p >= 0.66, "HighValue").when(p >= 0.33, "LowValue").otherwise("Normal"))


@query("e06_class_report", Q.with_(Q.SCORES, f"pp AS (SELECT attack_cat AS y, {_PREDICTED} AS p FROM sc)", body="""
SELECT c.y AS class, round(CAST(hit AS DOUBLE) / pred, 4) AS precision, round(CAST(hit AS DOUBLE) / support, 4) AS recall,
  round(2e0 * hit / (pred + support), 4) AS f1, support FROM
  (SELECT y, count(*) AS support, sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS hit FROM pp GROUP BY y) c
  JOIN (SELECT p, count(*) AS pred FROM pp GROUP BY p) d ON c.y = d.p"""))
def _(spark, sf):
    return E.class_report(_predicted(spark, sf), "attack_cat")


_ONE = Q.with_(Q.SCORES, f"c AS (SELECT {Q.counts('p_rf >= 0.5e0')} FROM sc)", "s AS (SELECT label, p_rf AS score FROM sc)", Q.ranking("s"),
               f"m AS (SELECT {FULL} FROM c, rk)", body="")


@query("e07_target_check", _ONE + "UNION ALL ".join(
    f"SELECT '{m}' AS metric, {E.SAME_AS.get(m, m)} AS value, {Q.d(t)} AS target, {E.SAME_AS.get(m, m)} {'<=' if m == 'fpr' else '>='} {Q.d(t)} AS met FROM m "
    for m, t in E.TARGETS.items()))
def _(spark, sf):
    return E.check_targets(E.metrics(_scores(spark, sf), 0.5, "p_rf"))


@query("e08_score_statistics", Q.with_(Q.SCORES, body="""SELECT split, round(min(s_if), 6) AS min, round(max(s_if), 6) AS max, round(avg(s_if), 6) AS mean,
  round(stddev_pop(s_if), 6) AS std FROM sc GROUP BY split"""))
def _(spark, sf):
    return E.score_statistics(_scores(spark, sf), "s_if", ["split"], 6)


_VARIANTS = f"""lv AS (SELECT split, label, 'RF_only' AS variant, p_rf AS score FROM sc UNION ALL SELECT split, label, 'IF_only', s_if FROM sc
UNION ALL SELECT split, label, 'IF_RF_fused', {Q.fused()} FROM sc), lvv AS (SELECT * FROM lv WHERE split = 'val'), lvt AS (SELECT * FROM lv WHERE split = 'test')"""


def variant_ctes(source: str = "lvv", keys: str = "variant") -> str:
    return f"{grid(100, 99, source, 'score', keys, 'vg')}, vb AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {SMALL_FPR} DESC, i) AS rn FROM vg)"


_TESTED = f"""tc AS (SELECT lvt.variant, threshold, {Q.counts('score >= threshold')} FROM lvt JOIN vb ON lvt.variant = vb.variant AND rn = 1 GROUP BY lvt.variant, threshold)"""


def tested_variants(df, scores, name="variant"):
    """Per variant: threshold from the validation rows, metrics on the test rows."""
    long = S.stack_methods(df, scores, ["split", "label"], name)
    return E.metrics_at_best(long, name)


@query("e09_component_ablation", Q.with_(Q.SCORES, _VARIANTS, variant_ctes(), _TESTED, Q.ranking("lvt", "variant"),
       body=f"SELECT tc.variant, round(threshold, 4) AS threshold, {FULL} FROM tc JOIN rk ON tc.variant = rk.variant"))
def _(spark, sf):
    return tested_variants(_scores(spark, sf), {"RF_only": F.col("p_rf"), "IF_only": F.col("s_if"), "IF_RF_fused": fusion.fuse()})


def _contribution(name: str, cond: str) -> str:
    return (f"SELECT '{name}' AS contribution, n AS count, round(CAST(n AS DOUBLE) / greatest(flagged, 1), 4) AS percent_of_fused_alerts, "
            f"round(CASE WHEN n = 0 THEN 0e0 ELSE CAST(atk AS DOUBLE) / n END, 4) AS attack_rate FROM (SELECT CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS flagged, "
            f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN {cond} THEN label ELSE 0 END) AS BIGINT) AS atk FROM fg)")


@query("e10_detection_contribution", Q.with_(Q.SCORES, f"fg AS (SELECT label, s_if >= 0.3e0 AS a, p_rf >= 0.6e0 AS r, {Q.fused()} >= 0.4e0 AS f FROM sc WHERE split = 'test')",
       body=" UNION ALL ".join([_contribution("IF_only_detection", "a AND NOT r AND f"), _contribution("RF_only_detection", "r AND NOT a AND f"),
                                _contribution("consensus_detection", "r AND a AND f")])))
def _(spark, sf):
    return E.detection_contribution(_scores(spark, sf, "test").withColumn("fused", fusion.fuse()), 0.3, 0.6, 0.4)


_DIST = lambda g, c: (f"SELECT '{g}' AS \"group\", count(*) AS n, round(avg(s_if), 4) AS if_score_mean, round(quantile_cont(s_if, 0.5), 4) AS if_score_p50, "  # noqa: E731
                      f"round(quantile_cont(s_if, 0.95), 4) AS if_score_p95 FROM sc, rc WHERE split = 'test' AND {c}")


@query("e11_score_distribution", Q.with_(Q.SCORES, "cc AS (SELECT attack_cat, count(*) AS n FROM sc WHERE split = 'test' AND label = 1 GROUP BY attack_cat)",
       "cq AS (SELECT quantile_cont(n, 0.35) AS q FROM cc)", "rc AS (SELECT list(attack_cat) AS rare FROM cc, cq WHERE n <= q)",
       body=" UNION ALL ".join([_DIST("benign", "label = 0"), _DIST("known_attack", "label = 1"), _DIST("rare_attack", "list_contains(rare, attack_cat)")])))
def _(spark, sf):
    return E.score_distribution(_scores(spark, sf, "test"))


_SUPPRESSED = """sp AS (SELECT split, label, p_rf, CASE WHEN s_if < 0.7e0 AND maha < 2e0 THEN 0e0 ELSE s_if END AS s_if,
  s_if < 0.7e0 AND maha < 2e0 AS suppressed FROM sc)"""


@query("e13_suppression_effect", Q.with_(Q.SCORES, _SUPPRESSED, body="""SELECT CAST(sum(CASE WHEN suppressed THEN 1 ELSE 0 END) AS BIGINT) AS suppressed_rows,
  round(CAST(sum(CASE WHEN suppressed THEN label ELSE 0 END) AS DOUBLE) / sum(CASE WHEN suppressed THEN 1 ELSE 0 END), 4) AS suppressed_attack_rate FROM sp WHERE split = 'test'"""))
def _(spark, sf):
    return E.suppression_effect(E.suppress(_scores(spark, sf, "test")))


@query("e13_profile_suppression", Q.with_(Q.SCORES, _SUPPRESSED, f"""lv AS (SELECT split, label, 'suppressed' AS variant, {Q.fused()} AS score FROM sp),
lvv AS (SELECT * FROM lv WHERE split = 'val'), lvt AS (SELECT * FROM lv WHERE split = 'test')""", variant_ctes(), _TESTED, Q.ranking("lvt", "variant"),
       body=f"SELECT tc.variant, round(threshold, 4) AS threshold, {FULL} FROM tc JOIN rk ON tc.variant = rk.variant"))
def _(spark, sf):
    return tested_variants(E.suppress(_scores(spark, sf)), {"suppressed": fusion.fuse()})


@query("e14_combined_mitigation", Q.with_(Q.SCORES, _SUPPRESSED, f"""lv AS (SELECT split, label, 'combined' AS variant, {Q.fused(0.35)} AS score FROM sp),
lvv AS (SELECT * FROM lv WHERE split = 'val'), lvt AS (SELECT * FROM lv WHERE split = 'test')""", variant_ctes(),
       f"""tc AS (SELECT lvt.variant, greatest(0.23e0, threshold) AS threshold, {Q.counts('score >= greatest(0.23e0, threshold)')} FROM lvt JOIN vb ON lvt.variant = vb.variant AND rn = 1 GROUP BY 1, 2)""",
       Q.ranking("lvt", "variant"), body=f"SELECT tc.variant, round(threshold, 4) AS threshold, {FULL} FROM tc JOIN rk ON tc.variant = rk.variant"))
def _(spark, sf):
    long = S.stack_methods(E.suppress(_scores(spark, sf)), {"combined": fusion.fuse(alpha=0.35)}, ["split", "label"], "variant")
    return E.metrics_at_best(long, "variant", at_least=0.23)


_BETA_BEST = f"bb AS (SELECT b1, b2, b3 FROM bc ORDER BY {LOSS}, i LIMIT 1)"
_ADAPTIVE = f"adt AS (SELECT cv.*, {suite_tau('b1', 'b2', 'b3')} AS tau FROM cv, bb WHERE split = 'test')"
_ADAPTIVE_CTES = [*BETA_CTES, _BETA_BEST, _ADAPTIVE]


def adaptive_test(spark, sf):
    """Test rows with the searched adaptive threshold, and the static one."""
    sc, tau0 = adaptive_inputs(spark, sf)
    best = S.beta_search(sc.filter("split = 'val'"), tau0).filter("is_best").first()
    betas = (best["beta1"], best["beta2"], best["beta3"])
    return sc.filter("split = 'test'").withColumn("tau", adaptive_tau("load", "risk", "hour", SUITE, tau0, betas)), tau0


@query("e15_static_vs_adaptive", Q.with_(*_ADAPTIVE_CTES, "at2 AS (SELECT 'adaptive' AS thresholding, label, score, tau FROM adt UNION ALL SELECT 'static', label, score, tau0 FROM adt)",
       f"c AS (SELECT thresholding, round(avg(tau), 4) AS threshold, {Q.counts('score >= tau')} FROM at2 GROUP BY thresholding)", Q.ranking("at2", "thresholding"),
       body=f"SELECT c.thresholding, threshold, {FULL} FROM c JOIN rk ON c.thresholding = rk.thresholding"))
def _(spark, sf):
    test, tau0 = adaptive_test(spark, sf)
    both = append_all([test.select(F.lit(n).alias("thresholding"), "label", "score", t.alias("tau")) for n, t in (("adaptive", F.col("tau")), ("static", F.lit(tau0)))])
    return E.metrics(both, "tau", slices=["thresholding"])


def _by(key: str, expression: str, having: str = "") -> str:
    return Q.with_(*_ADAPTIVE_CTES, f"ab AS (SELECT {expression} AS {key}, label, score, tau FROM adt)",
                   f"c AS (SELECT {key}, round(avg(tau), 4) AS threshold, count(*) AS n, {Q.counts('score >= tau')} FROM ab GROUP BY {key})", Q.ranking("ab", key),
                   body=f"SELECT c.{key}, threshold, n, {FULL} FROM c JOIN rk ON c.{key} = rk.{key} {having}")


@query("e16_by_time_window", _by("time_window", "format('{:02d}-{:02d}', hour // 6 * 6, hour // 6 * 6 + 6)", "WHERE tp + fn > 0"))
def _(spark, sf):
    return E.metrics_by_time_window(adaptive_test(spark, sf)[0], "tau")


@query("e17_by_device_type", _by("device_type", "device_type"))
def _(spark, sf):
    return E.metrics_by_device_type(adaptive_test(spark, sf)[0], "tau")


_AUC_CTES = ["va AS (SELECT label, s_if AS score FROM vl)", Q.ranking("va", out="ra"), "vz AS (SELECT label, p_rf AS score FROM vl)", Q.ranking("vz", out="rb")]
_SIX = f"""lv AS (SELECT split, label, 'weighted_linear' AS variant, {Q.fused()} AS score FROM sc UNION ALL SELECT split, label, 'max', greatest(s_if, p_rf) FROM sc
UNION ALL SELECT split, label, 'product', s_if * p_rf FROM sc
UNION ALL SELECT split, label, 'stacking', 1e0 / (1e0 + exp(-(1.5e0 * s_if + 2.5e0 * p_rf - 2e0))) FROM sc
UNION ALL SELECT split, label, 'bayesian_reliability', (ra.auc * s_if + rb.auc * p_rf) / greatest(ra.auc + rb.auc, 1e-8) FROM sc, ra, rb
UNION ALL SELECT split, label, 'rank_based', 0.45e0 * {_RANKS.format(c='s_if')} + (1e0 - 0.45e0) * {_RANKS.format(c='p_rf')} FROM sc),
lvv AS (SELECT * FROM lv WHERE split = 'val'), lvt AS (SELECT * FROM lv WHERE split = 'test')"""


@query("e18_fusion_methods", Q.with_(Q.SCORES, _VAL, *_AUC_CTES, _SIX, variant_ctes(), _TESTED, Q.ranking("lvt", "variant"),
       body=f"SELECT tc.variant AS fusion_method, round(threshold, 4) AS threshold, {FULL} FROM tc JOIN rk ON tc.variant = rk.variant"))
def _(spark, sf):
    weights = reliability(spark, sf)
    df = ranked(_scores(spark, sf).filter("split <> 'train'"))
    scores = {m: fusion.fuse(method=m, stacker=STACKER, reliability=weights, ranks=("rank_s_if", "rank_p_rf")) for m in fusion.METHODS}
    return tested_variants(df, scores, "fusion_method")


@query("e20_warm_up_impact", Q.with_(Q.SCORES, f"""wr AS (SELECT label, {Q.fused()} >= 0.4e0 AS flag, row_number() OVER (PARTITION BY device_id ORDER BY ts, row_id) AS rn FROM sc)""",
       f"c AS (SELECT CASE WHEN rn <= 50 THEN 'warm_up_first_50' ELSE 'after_warm_up_51_plus' END AS segment, count(*) AS n, {Q.counts('flag')} FROM wr GROUP BY 1)",
       body=f"SELECT segment, n, round({Q.FPR}, 4) AS fp_rate, round({Q.FNR}, 4) AS fn_rate FROM c"))
def _(spark, sf):
    return E.warm_up_impact(_scores(spark, sf), fusion.fuse() >= 0.4)


@query("e23_top_rows", Q.with_(Q.SCORES, f"c AS (SELECT device_id, {Q.counts('p_rf >= 0.5e0')} FROM sc GROUP BY device_id)", body=f"""
SELECT device_id, round({Q.F1}, 4) AS f1, tp, fp FROM c ORDER BY {Q.F1} DESC, device_id LIMIT 30"""))
def _(spark, sf):
    counts = _scores(spark, sf).groupBy("device_id").agg(*C.confusion_counts("label", F.col("p_rf") >= 0.5))
    table = counts.select("device_id", C.f1().alias("exact"), "tp", "fp", F.lit(None).cast("double").alias("note"))
    top = E.top_rows(table, "exact", 30, ["device_id"])
    return top.select("device_id", F.round("exact", 4).alias("f1"), "tp", "fp")


