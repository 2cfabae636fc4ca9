"""Metrics of prediction tables, result tables, candidates and trials."""

from pyspark.sql import functions as F

from tablewright.operators import metrics as M
from tablewright.plans.base import (
    LINE_KEY, SQL_CLASS_PREDICTIONS, SQL_FOLD_SCORES, SQL_VALUE_PREDICTIONS, class_predictions, fold_scores, query,
    sql_hash, table, value_predictions,
)

PER_CLASS = f"""
WITH src AS ({SQL_CLASS_PREDICTIONS}), cls AS (SELECT DISTINCT label AS c FROM src UNION SELECT DISTINCT prediction FROM src),
per AS (SELECT c AS class, count(*) FILTER (label = c AND prediction = c) AS hits, count(*) FILTER (label = c) AS support,
               count(*) FILTER (prediction = c) AS predicted FROM src, cls GROUP BY c),
sc AS (SELECT class, support, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
              coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1, hits FROM per)"""


@query("accuracy_f1_balanced", PER_CLASS + """
SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy,
       round(avg(f1), 6) AS f1_macro FROM sc""")
def accuracy_f1_balanced(spark, folder):
    return M.class_metrics(class_predictions(spark, folder))


@query("confusion", f"""
WITH src AS ({SQL_CLASS_PREDICTIONS}), cls AS (SELECT DISTINCT label AS c FROM src UNION SELECT DISTINCT prediction FROM src)
SELECT a.c AS label, b.c AS prediction, count(src.label) AS n FROM cls a CROSS JOIN cls b
LEFT JOIN src ON src.label = a.c AND src.prediction = b.c GROUP BY ALL""")
def confusion(spark, folder):
    return M.confusion(class_predictions(spark, folder)).select("label", "prediction", "n")


@query("confusion_share", f"""
SELECT label, prediction, round(n / sum(n) OVER (PARTITION BY label), 4) AS share FROM (
  SELECT label, prediction, count(*) AS n FROM ({SQL_CLASS_PREDICTIONS}) GROUP BY ALL)""")
def confusion_share(spark, folder):
    return M.confusion(class_predictions(spark, folder)).select("label", "prediction", "share")


@query("class_report", PER_CLASS + """
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support AS rows FROM sc
UNION ALL SELECT 'Macro average', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support)::BIGINT FROM sc
UNION ALL SELECT 'Weighted average', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), sum(support)::BIGINT FROM sc""")
def class_report(spark, folder):
    return M.class_report(class_predictions(spark, folder))


STEPS = f"""
WITH src AS ({SQL_CLASS_PREDICTIONS}),
g AS (SELECT score, count(*) FILTER (label = 'O') AS pos, count(*) FILTER (label <> 'O') AS neg FROM src GROUP BY 1),
st AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
       FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def steps(spark, folder):
    preds = class_predictions(spark, folder)
    return M.score_steps(preds, F.col("label") == "O", F.col("score"), F.lit("O"))


@query("roc_auc", STEPS + " SELECT 'O' AS class, round(sum((tp - pos / 2) * neg) / max(p * n), 6) AS roc_auc FROM st")
def roc_auc(spark, folder):
    return M.roc_auc(steps(spark, folder))


@query("average_precision", STEPS + " SELECT 'O' AS class, round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision FROM st")
def average_precision(spark, folder):
    return M.average_precision(steps(spark, folder))


@query("roc_points", STEPS + " SELECT 'O' AS class, score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM st")
def roc_points(spark, folder):
    return M.roc_points(steps(spark, folder))


@query("pr_points", STEPS + """ SELECT 'O' AS class, score AS threshold, round(tp / p, 6) AS recall,
round(tp / (tp + fp), 6) AS precision, round(p / (p + n), 6) AS no_model FROM st""")
def pr_points(spark, folder):
    return M.pr_points(steps(spark, folder))


# Three classes: the score of a class is larger for one of the three order states.
@query("roc_auc_per_class", """
WITH src AS (SELECT o_orderstatus AS label, [o_totalprice % 100, o_totalprice % 10, o_totalprice % 1000] AS s FROM orders),
long AS (SELECT label = c AS pos, s[i] AS score, c AS class FROM src, (VALUES ('F', 1), ('O', 2), ('P', 3)) v(c, i)),
g AS (SELECT class, score, count(*) FILTER (pos) AS pos, count(*) FILTER (NOT pos) AS neg FROM long GROUP BY ALL),
st AS (SELECT class, pos, neg, sum(pos) OVER w AS tp, sum(pos) OVER c AS p, sum(neg) OVER c AS n FROM g
       WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING), c AS (PARTITION BY class))
SELECT class, round(sum((tp - pos / 2) * neg) / max(p * n), 6) AS roc_auc FROM st GROUP BY class""")
def roc_auc_per_class(spark, folder):
    price = F.col("o_totalprice")
    preds = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("label"), F.array(price % 100, price % 10, price % 1000).alias("scores"))
    long = M.one_vs_rest(preds, "label", "scores", ["F", "O", "P"])
    return M.roc_auc(M.score_steps(long, F.col("is_class"), F.col("class_score"), F.col("class")))


@query("actual_vs_predicted", f"""
WITH src AS ({SQL_CLASS_PREDICTIONS})
SELECT class, sum(a)::BIGINT AS actual, sum(p)::BIGINT AS predicted FROM (
  SELECT label AS class, 1 AS a, 0 AS p FROM src UNION ALL SELECT prediction, 0, 1 FROM src)
GROUP BY class ORDER BY actual DESC, class LIMIT 15""")
def actual_vs_predicted(spark, folder):
    return M.actual_vs_predicted(class_predictions(spark, folder))


@query("regression_metrics", f"""
SELECT round(r, 6) AS r2, round(e, 6) AS rmse, round(m, 6) AS mae FROM (
  SELECT 1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)) AS r, sqrt(avg((label - prediction) ** 2)) AS e,
         avg(abs(label - prediction)) AS m FROM ({SQL_VALUE_PREDICTIONS}))""")
def regression_metrics(spark, folder):
    return M.regression_metrics(value_predictions(spark, folder))


@query("heldout_table", f"""
WITH s AS (SELECT label AS y, prediction AS p, abs(label - prediction) AS e FROM ({SQL_VALUE_PREDICTIONS}))
SELECT 'r2' AS metric, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS value FROM s
UNION ALL SELECT 'rmse', round(sqrt(avg(e * e)), 6) FROM s UNION ALL SELECT 'mae', round(avg(e), 6) FROM s
UNION ALL SELECT 'median_absolute_error', round(quantile_cont(e, 0.5), 6) FROM s
UNION ALL SELECT 'largest_error', round(max(e), 6) FROM s
UNION ALL SELECT 'within_10_percent', round(avg((e <= 0.1::DOUBLE * abs(y))::INT), 6) FROM s
UNION ALL SELECT 'rows', count(*)::DOUBLE FROM s""")
def heldout_table(spark, folder):
    return M.held_out_table(value_predictions(spark, folder))


@query("residual_points", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, label AS actual, prediction AS predicted, label - prediction AS residual
FROM ({SQL_VALUE_PREDICTIONS}) ORDER BY {sql_hash(0, LINE_KEY)}, {', '.join(LINE_KEY)} LIMIT 5000""")
def residual_points(spark, folder):
    return M.residuals(value_predictions(spark, folder), LINE_KEY)


@query("axis_range", f"""
SELECT least(min(label), min(prediction)) AS low, greatest(max(label), max(prediction)) AS high FROM ({SQL_VALUE_PREDICTIONS})""")
def axis_range(spark, folder):
    return M.axis_range(value_predictions(spark, folder))


@query("error_histogram", f"""
WITH s AS (SELECT label - prediction AS e FROM ({SQL_VALUE_PREDICTIONS})), r AS (SELECT min(e) AS lo, max(e) - min(e) AS w FROM s)
SELECT bin, round(any_value(lo) + bin * any_value(w) / 40, 6) AS low, count(*) AS n FROM (
  SELECT least(floor((e - lo) / w * 40), 39)::BIGINT AS bin, lo, w FROM s, r) GROUP BY bin""")
def error_histogram(spark, folder):
    return M.error_histogram(value_predictions(spark, folder))


# -- candidates and trials --------------------------------------------------------------

CANDIDATES = f"""
SELECT 'supplier ' || trial AS name, round(avg(score), 4) AS cv_mean, round(stddev_pop(score), 4) AS cv_std,
       round(stddev_pop(score) / sqrt(count(*)), 6) AS cv_noise FROM ({SQL_FOLD_SCORES}) GROUP BY trial"""


def candidates(spark, folder):
    scores = fold_scores(spark, folder).withColumn("name", F.concat(F.lit("supplier "), F.col("trial").cast("string")))
    return M.cv_summary(scores)


@query("cv_noise", CANDIDATES)
def cv_noise(spark, folder):
    return candidates(spark, folder)


@query("champion", f"SELECT * FROM ({CANDIDATES}) ORDER BY cv_mean DESC, name LIMIT 1")
def champion(spark, folder):
    return M.champion(candidates(spark, folder))


def _with_status(spark, folder):
    failed = F.col("cv_noise") > 0.0035
    return candidates(spark, folder).withColumn("status", F.when(failed, "failed").otherwise("ok")).withColumn(
        "reason", F.when(failed, "unstable"))


@query("leaderboard", f"SELECT name, cv_mean, cv_std FROM ({CANDIDATES}) WHERE NOT cv_noise > 0.0035::DOUBLE ORDER BY cv_mean DESC, name LIMIT 15")
def leaderboard(spark, folder):
    return M.leaderboard(_with_status(spark, folder), "accuracy", M.MAX_BARS).select("name", "cv_mean", "cv_std")


@query("excluded_candidates", f"SELECT name, 'failed' AS status, 'unstable' AS reason FROM ({CANDIDATES}) WHERE cv_noise > 0.0035::DOUBLE")
def excluded_candidates(spark, folder):
    return M.excluded(_with_status(spark, folder))


@query("leaderboard_lower_is_better", f"SELECT name, cv_mean FROM ({CANDIDATES}) ORDER BY cv_mean, name LIMIT 15")
def leaderboard_lower_is_better(spark, folder):
    return M.leaderboard(candidates(spark, folder), "rmse", M.MAX_BARS).select("name", "cv_mean")


@query("beats_baseline", f"SELECT name, cv_mean > 0.28::DOUBLE + 0.01::DOUBLE AS beats, round(0.6 - cv_mean, 4) AS overfit_gap FROM ({CANDIDATES})")
def beats_baseline(spark, folder):
    return candidates(spark, folder).select(
        "name", M.beats_baseline(F.col("cv_mean"), F.lit(0.28)).alias("beats"),
        M.overfit_gap(F.lit(0.6), F.col("cv_mean")).alias("overfit_gap"))


TRIALS = f"SELECT trial, round(avg(score), 6) AS score FROM ({SQL_FOLD_SCORES}) GROUP BY trial"


def trials(spark, folder):
    return fold_scores(spark, folder).groupBy("trial").agg(F.round(F.avg("score"), 6).alias("score"))


@query("tuning_progress", f"SELECT trial, score, max(score) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING) AS best FROM ({TRIALS})")
def tuning_progress(spark, folder):
    return M.tuning_progress(trials(spark, folder))


@query("tuning_summary", f"""
SELECT first, best, round(best - first, 6) AS delta, best - first > 0.0001 AS improved, searched FROM (
  SELECT arg_min(score, trial) AS first, max(score) AS best, count(*) FILTER (trial > 0) AS searched FROM ({TRIALS}))""")
def tuning_summary(spark, folder):
    return M.tuning_summary(trials(spark, folder))
