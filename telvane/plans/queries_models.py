"""Queries: rebalancing, models, and experiments that train models."""

from __future__ import annotations

from pyspark.sql import functions as F

from telvane.functions.labels import binary_from_class
from telvane.operators import evaluate as E
from telvane.operators import forest, neighbours, ocsvm, smote
from telvane.operators.scale import MinMaxClip, RobustScale
from telvane.plans import flows
from telvane.plans import sql as Q
from telvane.plans import views
from telvane.plans.catalog import query, rounded
from telvane.plans.queries_evaluate import _PREDICTED, _predicted
from telvane.session import scratch_path, settle

_LINE = views.LINE_FEATURES
PLAN = flows.TrainingPlan()
_NEAR = ["byte_rate", "burst_length", "session_duration"]


@query("c12_minority_neighbours", Q.with_(Q.FLOW, "mi AS (SELECT row_id, byte_rate AS a, burst_length AS b, session_duration AS c FROM fl WHERE label = 1)", """
ds AS (SELECT x.row_id, y.row_id AS other, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c)) AS distance
  FROM mi x JOIN mi y ON x.row_id <> y.row_id),
rn AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, other) AS rank FROM ds)""",
       body="SELECT row_id, CAST(rank AS INTEGER) AS rank, other, round(distance, 6) AS distance FROM rn WHERE rank <= 5"))
def _(spark, sf):
    few = views.flow_events(spark, sf).filter("label = 1").withColumn("vec", F.array(*_NEAR))
    near = neighbours.nearest(few, 5)
    return rounded(near.select("row_id", F.posexplode("neighbours")).select(
        "row_id", (F.col("pos") + 1).alias("rank"), F.col("col.row_id").alias("other"), F.col("col.distance").alias("distance")))


@query("c12_smote_parity", Q.with_(Q.FLOW, body="""SELECT l.label, l.synthetic, count(*) AS n FROM
  (SELECT label, false AS synthetic FROM fl UNION ALL
   SELECT 1, true FROM range((SELECT CAST(sum(1 - label) - sum(label) AS BIGINT) FROM fl)) t(i)) l GROUP BY 1, 2"""))
def _(spark, sf):
    out = smote.balance(views.flow_events(spark, sf), _NEAR)
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


def _line_train(spark, sf):
    li = views.flow_lineitem(spark, sf)
    return settle(RobustScale.fit(li, _LINE).transform(li).select("row_id", "label", "attack_cat", "device_id", *_LINE), "line")


@query("m01_one_class_svm")
def _(spark, sf):
    """Objective after every pass; it starts at nu and never rises."""
    train = _line_train(spark, sf)
    nu = 0.1
    m = ocsvm.fit(ocsvm.normal_training_rows(train, _LINE), _LINE, nu, PLAN.passes)
    return spark.createDataFrame([(i, float(v), nu) for i, v in enumerate(m.history)], "pass int, objective double, nu double")


@query("m02_scaled_anomaly", Q.with_(Q.LINE, "mm AS (SELECT min(quantity - extendedprice / 1000) AS lo, max(quantity - extendedprice / 1000) AS hi FROM li WHERE label = 0)",
       body="SELECT row_id, round(least(1e0, greatest(0e0, (quantity - extendedprice / 1000 - lo) / (hi - lo))), 6) AS s_if FROM li, mm"))
def _(spark, sf):
    raw = views.flow_lineitem(spark, sf).withColumn("raw", F.col("quantity") - F.col("extendedprice") / 1000)
    scaling = MinMaxClip.fit(raw.filter("label = 0"), "raw")
    return rounded(raw.select("row_id", scaling.expression(F.col("raw")).alias("s_if")))


@query("m03_nu_search")
def _(spark, sf):
    train = _line_train(spark, sf)
    best, rows = ocsvm.tune_nu(ocsvm.normal_training_rows(train, _LINE), train, _LINE, passes=PLAN.passes)
    return spark.createDataFrame([(*map(float, r), r[0] == best) for r in rows], "nu double, roc_auc double, avg_precision double, combined double, best boolean")


@query("m04_random_forest")
def _(spark, sf):
    train = _line_train(spark, sf)
    fitted = forest.Forest(forest.fit_plain(train, _LINE, PLAN.trees, PLAN.depth), _LINE)
    return fitted.score(train).select("row_id", "label", "p_rf")


def _prepared(spark, sf):
    return flows.prepare(views.flow_events(spark, sf))


@query("m05_feature_selection")
def _(spark, sf):
    prepared = _prepared(spark, sf)
    fitted = forest.fit(prepared.part("train"), prepared.features, PLAN.trees, PLAN.depth, calibrate=False)
    return spark.createDataFrame(fitted.importances(), "feature string, importance double")


@query("m06_calibrated_forest")
def _(spark, sf):
    train = _line_train(spark, sf)
    fitted = forest.fit(train, _LINE, PLAN.trees, PLAN.depth, select=False)
    return fitted.score(train).select("row_id", "label", "p_rf")


@query("m07_cross_validation")
def _(spark, sf):
    scores = forest.cross_validate(_line_train(spark, sf), _LINE, PLAN.trees, PLAN.depth)
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(scores)], "fold int, weighted_f1 double")
    return table.agg(F.count(F.lit(1)).alias("folds"), F.avg("weighted_f1").alias("mean_f1"), F.stddev_pop("weighted_f1").alias("std_f1"))


@query("m07_weighted_f1", Q.with_(Q.SCORES, f"pp AS (SELECT split, attack_cat AS y, {_PREDICTED} AS p FROM sc)", """
s AS (SELECT split, y, count(*) AS support, sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS hit FROM pp GROUP BY split, y),
q AS (SELECT split, p, count(*) AS pred FROM pp GROUP BY split, p)""", body="""
SELECT s.split, round(sum(support * 2e0 * hit / (support + coalesce(pred, 0))) / sum(support), 6) AS weighted_f1
FROM s LEFT JOIN q ON s.split = q.split AND s.y = q.p GROUP BY s.split"""))
def _(spark, sf):
    return rounded(E.weighted_f1(_predicted(spark, sf), "attack_cat", slices=["split"]))


@query("m08_attack_probability", Q.with_(Q.SCORES, body="SELECT row_id, round(1e0 - (1e0 - p_rf) * 0.5e0, 6) AS from_names, round(1e0 - p_rf, 6) AS from_first FROM sc"))
def _(spark, sf):
    """Class order decides which probability is 'normal': by spelling, else the first class."""
    p = F.col("p_rf")
    named = forest.attack_probability(F.array(p, (F.lit(1.0) - p) * F.lit(0.5)), ["DDoS", "BENIGN"])
    first = forest.attack_probability(F.array(p, F.lit(1.0) - p), ["DDoS", "PortScan"])
    return rounded(views.scores_events(spark, sf).select("row_id", named.alias("from_names"), first.alias("from_first")))


@query("m09_full_prediction")
def _(spark, sf):
    train = _line_train(spark, sf)
    fitted = forest.Forest(forest.fit_plain(train, _LINE, PLAN.trees, PLAN.depth), _LINE)
    return fitted.predict(train, 0.4).select("row_id", "p_rf", "flagged", "prediction", "probabilities")


@query("m10_binary_labels", """SELECT l_linenumber, l_orderkey, l_partkey, l_suppkey, l_shipdate, CASE WHEN l_linenumber - 1 <> 0 THEN 1 ELSE 0 END AS y_number,
  CASE WHEN l_linenumber IN (1, 2) THEN 0 ELSE 1 END AS y_text FROM lineitem""")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem")
    names = F.element_at(F.array(*[F.lit(n) for n in ("Benign", "NORMAL", "DoS", "legit", "benign ", "1", "U2R")]), F.col("l_linenumber"))
    return li.select("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate",
                     binary_from_class(F.col("l_linenumber") - 1, True).alias("y_number"), binary_from_class(names, False).alias("y_text"))


@query("m11_top_importances")
def _(spark, sf):
    prepared = _prepared(spark, sf)
    train = prepared.part("train")
    return forest.Forest(forest.fit_plain(train, prepared.features, PLAN.trees, PLAN.depth), prepared.features).top_importances(train)


def _newton(steps: int) -> list[str]:
    """SQL: Newton steps (a, b, c) of the balanced ridge logistic regression over vw (x1, x2, y, w), solved by Cramer's rule."""
    minor = lambda p, q, r, s: f"({p} * {s} - {q} * {r})"
    ctes = ["it0 AS (SELECT 0e0 AS a, 0e0 AS b, 0e0 AS c)"]
    second = ", ".join(f"sum(w * p * (1e0 - p) * {x}){ridge} AS h{n}" for n, x, ridge in (
        ("11", "x1 * x1", " + 1e0"), ("12", "x1 * x2", ""), ("13", "x1", ""), ("22", "x2 * x2", " + 1e0"), ("23", "x2", ""), ("33", "1e0", "")))
    det = f"(h11 * {minor('h22', 'h23', 'h23', 'h33')} - h12 * {minor('h12', 'h23', 'h13', 'h33')} + h13 * {minor('h12', 'h22', 'h13', 'h23')})"
    da = f"(g1 * {minor('h22', 'h23', 'h23', 'h33')} - h12 * {minor('g2', 'h23', 'g3', 'h33')} + h13 * {minor('g2', 'h22', 'g3', 'h23')})"
    db = f"(h11 * {minor('g2', 'h23', 'g3', 'h33')} - g1 * {minor('h12', 'h23', 'h13', 'h33')} + h13 * {minor('h12', 'g2', 'h13', 'g3')})"
    dc = f"(h11 * {minor('h22', 'g2', 'h23', 'g3')} - h12 * {minor('h12', 'g2', 'h13', 'g3')} + g1 * {minor('h12', 'h22', 'h13', 'h23')})"
    for k in range(1, steps + 1):
        ctes.append(f"""sg{k} AS (SELECT a, b, c, sum(w * (p - y) * x1) + a AS g1, sum(w * (p - y) * x2) + b AS g2, sum(w * (p - y)) AS g3, {second}
  FROM (SELECT *, 1e0 / (1e0 + exp(-(a * x1 + b * x2 + c))) AS p FROM vw, it{k - 1}) GROUP BY a, b, c)""")
        ctes.append(f"it{k} AS (SELECT a - {da} / {det} AS a, b - {db} / {det} AS b, c - {dc} / {det} AS c FROM sg{k})")
    return ctes


@query("m12_stacking_weights", Q.with_(Q.SCORES, """vw AS (SELECT s_if AS x1, p_rf AS x2, label AS y,
  count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY label)) AS w FROM sc WHERE split = 'val')""", *_newton(12),
       body="SELECT round(a, 4) AS w_if, round(b, 4) AS w_rf, round(c, 4) AS intercept FROM it12"))
def _(spark, sf):
    """The optimum, which the oracle reaches by Newton's method."""
    val = views.scores_events(spark, sf).filter("split = 'val'")
    return rounded(spark.createDataFrame([forest.fit_stacker(val)], "w_if double, w_rf double, intercept double"), 4)


@query("m13_score_table")
def _(spark, sf):
    return flows.train_detector(_prepared(spark, sf), PLAN)[1]


@query("s12_saved_detector")
def _(spark, sf):
    """Scores from a detector that was written and read back."""
    prepared = _prepared(spark, sf)
    detector, _ = flows.train_detector(prepared, PLAN)
    path = scratch_path(spark, "bundle")
    detector.save(path)
    return flows.Detector.load(spark, path).score(prepared.part("test"))


@query("e12_zero_day")
def _(spark, sf):
    return flows.zero_day(_prepared(spark, sf), PLAN)


@query("e19_profiling_ablation")
def _(spark, sf):
    return flows.profiling_ablation(_prepared(spark, sf), PLAN)


@query("e21_cross_dataset")
def _(spark, sf):
    """Train on event flow rows, evaluate on flow rows made from telemetry."""
    from telvane.operators.signals import harmonise_telemetry

    detector, _ = flows.train_detector(_prepared(spark, sf), PLAN)
    return flows.cross_dataset(detector, harmonise_telemetry(views.telemetry_events(spark, sf)))


@query("b14_sensitivity_metrics")
def _(spark, sf):
    prepared = _prepared(spark, sf)
    detector, _ = flows.train_detector(prepared, PLAN)
    return flows.profile_sensitivity(prepared, detector)


@query("p01_main_pipeline")
def _(spark, sf):
    """Test metrics of the whole flow: selected and calibrated forest, tuned weight and thresholds, best fusion method."""
    return flows.main_pipeline(_prepared(spark, sf)).metrics


_BINARY = ["many", "dear", "discounted", "taxed", "early"]


def _binary_lines(spark, sf):
    """Five yes/no features, so a single tree of unlimited depth reaches every combination."""
    li = views.flow_lineitem(spark, sf)
    flags = [F.col("quantity") > 25, F.col("extendedprice") > 40000, F.col("discount") > 0.05, F.col("tax") > 0.04, F.col("ts") < F.lit("1995-01-01").cast("timestamp_ntz")]
    return li.select("row_id", "label", *[f.cast("double").alias(n) for n, f in zip(_BINARY, flags)])


_GROUP_MEANS = """g AS (SELECT row_id, label, quantity > 25 AS a, extendedprice > 40000 AS b, discount > 0.05 AS c, tax > 0.04 AS d, ts < TIMESTAMP '1995-01-01' AS e FROM li),
n AS (SELECT count(*) / (2e0 * sum(1 - label)) AS w0, count(*) / (2e0 * sum(label)) AS w1 FROM g),
m AS (SELECT a, b, c, d, e, sum(label) AS pos, sum(1 - label) AS neg FROM g GROUP BY ALL),
p AS (SELECT row_id, label, pos * w1 / (pos * w1 + neg * w0) AS p_rf FROM g JOIN m USING (a, b, c, d, e), n)"""


def _one_tree(spark, sf):
    lines = settle(_binary_lines(spark, sf), "binary")
    return lines, forest.Forest(forest.fit_models(lines, _BINARY, {0: F.lit(True)}, forest.T.Growth(1, tried=len(_BINARY), bootstrap=False))[0], _BINARY)


@query("m04_tree_group_means", Q.with_(Q.LINE, _GROUP_MEANS, body="SELECT row_id, label, round(p_rf, 6) AS p_rf FROM p"))
def _(spark, sf):
    """One tree without a bag, all features tried at every node: balanced means of the 32 groups."""
    lines, fitted = _one_tree(spark, sf)
    return rounded(fitted.score(lines).select("row_id", "label", "p_rf"))


@query("m09_tree_prediction", Q.with_(Q.LINE, _GROUP_MEANS, body="""SELECT row_id, round(p_rf, 6) AS p_rf, p_rf >= 0.4 AS flagged,
  CASE WHEN p_rf > 0.5 THEN 1 ELSE 0 END AS prediction, round(1e0 - p_rf, 6) AS p_normal FROM p"""))
def _(spark, sf):
    lines, fitted = _one_tree(spark, sf)
    out = fitted.predict(lines, 0.4)
    return rounded(out.select("row_id", "p_rf", "flagged", "prediction", F.get("probabilities", 0).alias("p_normal")))
