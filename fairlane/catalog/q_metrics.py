"""Classification metric queries over the long ``predictions`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.operators import metrics as met
from fairlane.sources.tables import applications, predictions

COUNTS_SQL = """
_c AS (SELECT model, score, CAST(sum(CAST(y_true AS BIGINT)) AS BIGINT) AS pos,
              count_if(y_true = 0) AS neg
       FROM predictions WHERE score IS NOT NULL AND y_true IS NOT NULL GROUP BY model, score),
_desc AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tps, CAST(sum(neg) OVER w AS BIGINT) AS fps,
                 sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N
          FROM _c WINDOW w AS (PARTITION BY model ORDER BY score DESC
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

CONF_SQL = """
_cm AS (SELECT model, count_if(y_true = 0 AND pred = 0) AS tn, count_if(y_true = 0 AND pred = 1) AS fp,
               count_if(y_true = 1 AND pred = 0) AS fn, count_if(y_true = 1 AND pred = 1) AS tp
        FROM predictions WHERE y_true IS NOT NULL AND pred IS NOT NULL GROUP BY model),
_m AS (SELECT model, tn, fp, fn, tp, tp + fp + fn + tn AS n,
              coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0e0) AS accuracy,
              coalesce(tp / nullif(tp + fp, 0), 0e0) AS precision,
              coalesce(tp / nullif(tp + fn, 0), 0e0) AS recall,
              coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0) AS f1
       FROM _cm)"""

AUC_SQL = """
_asc AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM _c),
_auc AS (SELECT model, sum(pos * (cum_neg - neg + neg / 2e0)) / (sum(pos) * sum(neg)) AS auc,
                CAST(sum(pos) AS BIGINT) AS p, CAST(sum(neg) AS BIGINT) AS n
         FROM _asc GROUP BY model)"""


@register("a21_confusion", dbl=["fpr", "fnr"], sql="""
SELECT model, tn, fp, fn, tp, coalesce(fp / nullif(fp + tn, 0), 0e0) AS fpr,
       coalesce(fn / nullif(fn + tp, 0), 0e0) AS fnr FROM _cm""", ctes=CONF_SQL)
def confusion(spark, d):
    return met.confusion(predictions(spark, d), by="model")


@register("a23_classification_metrics", dbl=["accuracy", "precision", "recall", "f1"],
          sql="SELECT * FROM _m", ctes=CONF_SQL)
def classification(spark, d):
    return met.classification_metrics(predictions(spark, d))


@register("a23_per_class_report", dbl=["precision", "recall", "f1"], sql="""
SELECT model, 0 AS cls, coalesce(tn / nullif(tn + fn, 0), 0e0) AS precision,
       coalesce(tn / nullif(tn + fp, 0), 0e0) AS recall,
       coalesce(2e0 * tn / nullif(2 * tn + fn + fp, 0), 0e0) AS f1, tn + fp AS support FROM _cm
UNION ALL
SELECT model, 1, coalesce(tp / nullif(tp + fp, 0), 0e0), coalesce(tp / nullif(tp + fn, 0), 0e0),
       coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0), tp + fn FROM _cm""", ctes=CONF_SQL)
def per_class(spark, d):
    return met.per_class_report(predictions(spark, d))


@register("a22_roc_auc", dbl=["auc"], sql="SELECT * FROM _auc", ctes=COUNTS_SQL + "," + AUC_SQL)
def roc_auc(spark, d):
    return met.roc_auc(predictions(spark, d))


@register("a22_roc_auc_by_group", dbl=["auc"], sql="""
WITH c AS (SELECT model, nullif(grp_b, 'ASIA') AS grp_b, score, CAST(sum(y_true) AS BIGINT) AS pos, count_if(y_true = 0) AS neg
           FROM predictions WHERE score IS NOT NULL AND y_true IS NOT NULL GROUP BY model, nullif(grp_b, 'ASIA'), score),
a AS (SELECT *, sum(neg) OVER (PARTITION BY model, grp_b ORDER BY score
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM c)
SELECT model, grp_b, sum(pos * (cum_neg - neg + neg / 2e0)) / (sum(pos) * sum(neg)) AS auc,
       CAST(sum(pos) AS BIGINT) AS p, CAST(sum(neg) AS BIGINT) AS n
FROM a GROUP BY model, grp_b""")
def roc_auc_by_group(spark, d):
    p = predictions(spark, d).withColumn("grp_b", F.when(F.col("grp_b") != "ASIA", F.col("grp_b")))     # a null group too
    return met.roc_auc(p, by=["model", "grp_b"])


@register("a22_roc_curve", dbl=["threshold", "fpr", "tpr"], sql="""
SELECT model, score AS threshold, fps / N AS fpr, tps / P AS tpr, tps, fps FROM _desc""", ctes=COUNTS_SQL)
def roc_curve(spark, d):
    return met.roc_curve(predictions(spark, d))


@register("a22_pr_curve", dbl=["threshold", "precision", "recall"], sql="""
SELECT model, score AS threshold, tps / (tps + fps) AS precision, tps / P AS recall FROM _desc""",
          ctes=COUNTS_SQL)
def pr_curve(spark, d):
    return met.pr_curve(predictions(spark, d))


@register("a22_average_precision", dbl=["average_precision"], sql="""
SELECT model, sum(pos * (tps / (tps + fps))) / max(P) AS average_precision FROM _desc GROUP BY model""",
          ctes=COUNTS_SQL)
def average_precision(spark, d):
    return met.average_precision(predictions(spark, d))


@register("a24_threshold_sweep", dbl=["threshold", "precision", "recall", "f1"], sql="""
WITH t AS (SELECT unnest([0.3e0, 0.35e0, 0.4e0, 0.45e0, 0.5e0, 0.55e0, 0.6e0, 0.65e0, 0.7e0, 0.75e0]) AS threshold),
c AS (SELECT model, threshold, count_if(score >= threshold AND y_true = 1) AS tp,
             count_if(score >= threshold AND y_true = 0) AS fp, count_if(score < threshold AND y_true = 1) AS fn,
             count_if(score < threshold AND y_true = 0) AS tn
      FROM predictions, t WHERE score IS NOT NULL AND y_true IS NOT NULL GROUP BY model, threshold),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0e0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0e0) AS recall,
             coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0) AS f1 FROM c)
SELECT model, threshold, precision, recall, f1, fp, fn, precision >= 0.8 AND recall >= 0.7 AS meets_criteria FROM m""")
def threshold_sweep(spark, d):
    return met.threshold_sweep(predictions(spark, d))


@register("a46_model_comparison", dbl=["auc", "accuracy", "precision", "recall", "f1"], sql="""
SELECT m.model, a.auc, m.accuracy, m.precision, m.recall, m.f1,
       a.auc >= 0.75 AS auc_pass, m.precision >= 0.8 AS precision_pass, m.recall >= 0.7 AS recall_pass,
       m.f1 >= 0.7 AS f1_pass, a.auc >= 0.75 AND m.precision >= 0.8 AND m.recall >= 0.7 AS all_pass
FROM _m m JOIN _auc a ON m.model = a.model""", ctes=COUNTS_SQL + "," + AUC_SQL + "," + CONF_SQL)
def model_comparison(spark, d):
    return met.model_comparison(predictions(spark, d))


@register("a36_error_cohort_profile", dbl=["mean_all", "mean_fp", "mean_fn", "fp_gap_pct", "fn_gap_pct"], sql="""
WITH j AS (SELECT p.model, p.y_true, p.pred, a.loan_amount, a.income, a.interest_rate
           FROM predictions p JOIN applications a ON p.application_id = a.application_id),
l AS (SELECT model, y_true, pred, 'loan_amount' AS feature, loan_amount AS v FROM j
      UNION ALL SELECT model, y_true, pred, 'income', income FROM j
      UNION ALL SELECT model, y_true, pred, 'interest_rate', interest_rate FROM j),
g AS (SELECT model, feature, avg(v) AS mean_all, avg(v) FILTER (WHERE y_true = 0 AND pred = 1) AS mean_fp,
             avg(v) FILTER (WHERE y_true = 1 AND pred = 0) AS mean_fn FROM l GROUP BY model, feature)
SELECT model, feature, mean_all, mean_fp, mean_fn,
       CASE WHEN mean_all <> 0 THEN (mean_fp - mean_all) / mean_all * 100e0 ELSE 0e0 END AS fp_gap_pct,
       CASE WHEN mean_all <> 0 THEN (mean_fn - mean_all) / mean_all * 100e0 ELSE 0e0 END AS fn_gap_pct FROM g""")
def error_cohort(spark, d):
    apps = applications(spark, d)
    feats = apps.select("application_id", "loan_amount", "income", "interest_rate")
    joined = predictions(spark, d, apps).join(feats, "application_id")
    return met.error_cohort_profile(joined, ["loan_amount", "income", "interest_rate"])
