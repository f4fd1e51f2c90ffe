"""Fairness audit and model-choice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.catalog.q_metrics import AUC_SQL, COUNTS_SQL
from fairlane.operators import fairness as fair
from fairlane.operators import metrics as met
from fairlane.sources.tables import applications, predictions

ATTRS = ["grp_a", "grp_b", "grp_c"]


def ft_sql(src: str = "predictions", p: str = "", pred: str = "pred") -> str:
    """CTEs ``{p}g`` (group counts), ``{p}am`` (per attribute), ``{p}perf`` and ``{p}ft``."""
    long = "\n  UNION ALL ".join(
        f"SELECT model, y_true, {pred} AS pred, '{a}' AS attribute, CAST({a} AS VARCHAR) AS grp FROM {src}"
        for a in ATTRS)
    return f"""
{p}long AS ({long}),
{p}g AS (SELECT model, attribute, grp, count(*) AS n, count_if(pred = 1) AS pos,
          count_if(y_true = 1 AND pred = 1) AS tp, count_if(y_true = 1 AND pred = 0) AS fn,
          count_if(y_true = 0 AND pred = 1) AS fp, count_if(y_true = 0 AND pred = 0) AS tn
   FROM {p}long WHERE grp IS NOT NULL GROUP BY model, attribute, grp),
{p}r AS (SELECT *, pos / n AS rate, coalesce(tp / nullif(tp + fn, 0), 0e0) AS tpr,
          coalesce(fp / nullif(fp + tn, 0), 0e0) AS fpr FROM {p}g),
{p}am AS (SELECT model, attribute, max(rate) - min(rate) AS dpd, max(tpr) - min(tpr) AS tpr_diff,
           max(fpr) - min(fpr) AS fpr_diff,
           greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eod,
           CASE WHEN max(rate) > 0 THEN min(rate) / max(rate) ELSE 0e0 END AS disparate_impact,
           count(*) AS n_groups, min(n) AS min_group_n
    FROM {p}r GROUP BY model, attribute),
{p}cm AS (SELECT model, count_if(y_true = 0 AND {pred} = 0) AS tn, count_if(y_true = 0 AND {pred} = 1) AS fp,
           count_if(y_true = 1 AND {pred} = 0) AS fn, count_if(y_true = 1 AND {pred} = 1) AS tp
    FROM {src} WHERE y_true IS NOT NULL AND {pred} IS NOT NULL GROUP BY model),
{p}perf AS (SELECT model, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0e0) AS accuracy,
             coalesce(tp / nullif(tp + fp, 0), 0e0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0e0) AS recall,
             coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0) AS f1,
             (tp + fp = 0) OR (tn + fn = 0) AS degenerate FROM {p}cm),
{p}ft AS (SELECT a.model, attribute, dpd, dpd < 0.05 AS dpd_pass, eod, eod < 0.05 AS eod_pass,
           disparate_impact, disparate_impact >= 0.8 AS di_pass, accuracy, precision, recall, f1, degenerate,
           n_groups, min_group_n
    FROM {p}am a LEFT JOIN {p}perf f ON a.model = f.model)"""


FT = ft_sql()
FT_DBL = ["dpd", "eod", "disparate_impact", "accuracy", "precision", "recall", "f1"]


def _ft(spark, d, threshold: float | None = None):
    p = predictions(spark, d)
    if threshold is not None:
        p = p.withColumn("pred", (F.col("score") >= threshold).cast("int"))
    return fair.fairness_table(p, ATTRS)


@register("a25_demographic_parity", dbl=["rate", "dpd"], ctes=FT, sql="""
SELECT model, attribute, grp, n, rate,
       max(rate) OVER (PARTITION BY model, attribute) - min(rate) OVER (PARTITION BY model, attribute) AS dpd
FROM r""")
def demographic_parity(spark, d):
    return fair.demographic_parity(predictions(spark, d), ATTRS)


@register("a26_equalized_odds", dbl=["tpr_diff", "fpr_diff", "eod"], ctes=FT,
          sql="SELECT model, attribute, tpr_diff, fpr_diff, eod FROM am")
def equalized_odds(spark, d):
    return fair.equalized_odds(predictions(spark, d), ATTRS)


@register("a27_disparate_impact_best_group", dbl=["disparate_impact"], ctes=FT,
          sql="SELECT model, attribute, disparate_impact, disparate_impact >= 0.8 AS passes_80 FROM am")
def disparate_impact(spark, d):
    return fair.disparate_impact(predictions(spark, d), ATTRS)


@register("a27_disparate_impact_reference", dbl=["disparate_impact"], ctes=FT, sql="""
WITH x AS (SELECT model, attribute, min(rate) AS mn,
                  coalesce(max(CASE WHEN attribute = 'grp_c' AND grp = 'Male' THEN rate END), max(rate)) AS ref
           FROM r GROUP BY model, attribute)
SELECT model, attribute, CASE WHEN ref > 0 THEN mn / ref ELSE 0e0 END AS disparate_impact,
       (CASE WHEN ref > 0 THEN mn / ref ELSE 0e0 END) >= 0.8 AS passes_80 FROM x""")
def disparate_impact_ref(spark, d):
    return fair.disparate_impact(predictions(spark, d), ATTRS, reference={"grp_c": "Male"})


@register("a28_fairness_table", dbl=FT_DBL, ctes=FT, sql="SELECT * FROM ft")
def fairness_table(spark, d):
    return _ft(spark, d)


@register("a29_best_per_attribute", dbl=["best_dpd", "best_eod", "best_di"], ctes=FT, sql="""
SELECT attribute,
  arg_min(model, (dpd, model)) AS best_dpd_model, min(dpd) AS best_dpd,
  arg_min(model, (eod, model)) AS best_eod_model, min(eod) AS best_eod,
  arg_min(model, (-disparate_impact, model)) AS best_di_model, max(disparate_impact) AS best_di
FROM ft GROUP BY attribute""")
def best_per_attribute(spark, d):
    return fair.best_per_attribute(_ft(spark, d))


@register("a30_pass_counts", ctes=FT, sql="""
SELECT attribute, count(*) AS n_models, count_if(dpd < 0.05) AS dpd_pass, count_if(eod < 0.05) AS eod_pass,
       count_if(disparate_impact >= 0.8) AS di_pass FROM ft GROUP BY attribute""")
def pass_counts(spark, d):
    return fair.pass_counts(_ft(spark, d))


FS_SQL = """
fs AS (SELECT model, avg(dpd) AS avg_dpd, avg(eod) AS avg_eod, avg(disparate_impact) AS avg_di,
              max(accuracy) AS accuracy, max(f1) AS f1 FROM ft GROUP BY model),
fs2 AS (SELECT model, avg_dpd, avg_eod, avg_di,
               (coalesce(greatest(0e0, 1e0 - avg_dpd / 0.05e0), 0e0) + coalesce(greatest(0e0, 1e0 - avg_eod / 0.05e0), 0e0)
                + coalesce(least(1e0, avg_di / 0.8e0), 0e0)) / 3e0 AS fairness_score, accuracy, f1 FROM fs)"""


@register("a31_fairness_score", dbl=["avg_dpd", "avg_eod", "avg_di", "fairness_score", "accuracy", "f1"],
          ctes=FT + "," + FS_SQL, sql="SELECT * FROM fs2")
def fairness_score(spark, d):
    return fair.fairness_score(_ft(spark, d))


COMP_SQL = """
cp AS (SELECT model, bool_and(dpd < 0.05) AND bool_and(eod < 0.05) AND bool_and(disparate_impact >= 0.8) AS fairness_pass,
              max(f1) >= 0.7 AND max(precision) >= 0.8 AND max(recall) >= 0.7 AS performance_pass
       FROM ft GROUP BY model)"""


@register("a32_compliance", ctes=FT + "," + COMP_SQL, sql="""
SELECT model, fairness_pass, performance_pass, fairness_pass AND performance_pass AS all_criteria_met FROM cp""")
def compliance(spark, d):
    return fair.compliance(_ft(spark, d))


@register("a33_recommend", dbl=["fairness_score", "f1", "combined_score"], ctes=FT + "," + FS_SQL + "," + COMP_SQL,
          sql="""
WITH j AS (SELECT s.model, fairness_pass, performance_pass, fairness_pass AND performance_pass AS all_criteria_met,
                  fairness_score, f1, (fairness_score + f1) / 2e0 AS combined_score
           FROM fs2 s JOIN cp c ON s.model = c.model)
SELECT *, row_number() OVER (ORDER BY all_criteria_met DESC, combined_score DESC, model) = 1 AS recommended FROM j""")
def recommend(spark, d):
    return fair.recommend(_ft(spark, d))


@register("a34_validate_models", dbl=["dpd_max", "eod_max", "di_min", "auc"],
          ctes=FT + "," + COUNTS_SQL + "," + AUC_SQL, sql="""
WITH v AS (SELECT model, max(dpd) AS dpd_max, bool_and(dpd < 0.05) AS dpd_pass, max(eod) AS eod_max,
                  bool_and(eod < 0.05) AS eod_pass, min(disparate_impact) AS di_min,
                  bool_and(disparate_impact >= 0.8) AS di_pass FROM ft GROUP BY model),
w AS (SELECT v.*, dpd_pass AND eod_pass AND di_pass AS all_criteria, a.auc FROM v LEFT JOIN _auc a ON v.model = a.model)
SELECT model, dpd_max, dpd_pass, eod_max, eod_pass, di_min, di_pass, all_criteria, auc,
       row_number() OVER (ORDER BY all_criteria DESC, CASE WHEN all_criteria THEN -auc ELSE dpd_max END, model) = 1
         AS recommended FROM w""")
def validate_models(spark, d):
    p = predictions(spark, d)
    return fair.validate_models(fair.fairness_table(p, ATTRS), met.roc_auc(p))


@register("j03_a35_compare_runs", dbl=["original_dpd", "fair_dpd", "dpd_improvement_pct", "original_eod",
                                       "fair_eod", "eod_improvement_pct", "original_di", "fair_di"],
          ctes=FT + "," + "preds2 AS (SELECT *, CAST(score >= 0.6e0 AS INTEGER) AS pred2 FROM predictions),"
          + ft_sql("preds2", "n_", "pred2"), sql="""
SELECT o.model, o.attribute, o.dpd AS original_dpd, n.dpd AS fair_dpd,
       CASE WHEN o.dpd <> 0 THEN (o.dpd - n.dpd) / o.dpd * 100e0 ELSE 0e0 END AS dpd_improvement_pct,
       o.eod AS original_eod, n.eod AS fair_eod,
       CASE WHEN o.eod <> 0 THEN (o.eod - n.eod) / o.eod * 100e0 ELSE 0e0 END AS eod_improvement_pct,
       o.disparate_impact AS original_di, n.disparate_impact AS fair_di
FROM ft o JOIN n_ft n ON o.model = n.model AND o.attribute = n.attribute""")
def compare_runs(spark, d):
    return fair.compare_runs(_ft(spark, d), _ft(spark, d, threshold=0.6))


@register("j05_pareto_front", dbl=["avg_dpd", "avg_eod", "avg_di", "fairness_score", "accuracy", "f1"],
          ctes=FT + "," + FS_SQL, sql="""
SELECT * FROM fs2 a WHERE NOT EXISTS (
  SELECT 1 FROM fs2 b WHERE b.model <> a.model AND b.fairness_score >= a.fairness_score AND b.f1 >= a.f1
    AND (b.fairness_score > a.fairness_score OR b.f1 > a.f1))""")
def pareto(spark, d):
    return fair.pareto_front(fair.fairness_score(_ft(spark, d)), ["fairness_score", "f1"])


@register("j05_pareto_front_rows", dbl=["income", "property_value", "score_random"], sql="""
WITH k AS (SELECT application_id, income, property_value, score_random FROM applications
           WHERE income IS NOT NULL AND property_value IS NOT NULL)
SELECT application_id, income, property_value, score_random FROM applications WHERE income IS NULL OR property_value IS NULL
UNION ALL
SELECT * FROM k a WHERE NOT EXISTS (
  SELECT 1 FROM k b WHERE b.income >= a.income AND b.property_value >= a.property_value AND b.score_random >= a.score_random
    AND (b.income > a.income OR b.property_value > a.property_value OR b.score_random > a.score_random))""")
def pareto_rows(spark, d):
    """The front of all applications in three columns; rows with a null in one stay."""
    a = applications(spark, d).select("application_id", "income", "property_value", "score_random")
    return fair.pareto_front(a, ["income", "property_value", "score_random"], "application_id")


@register("j08_join_scores", dbl=["fairness_score", "f1", "accuracy"], ctes=FT + "," + FS_SQL, sql="""
SELECT s.model, s.fairness_score, p.f1, p.accuracy FROM fs2 s JOIN perf p ON s.model = p.model""")
def join_scores(spark, d):
    p = predictions(spark, d)
    s = fair.fairness_score(fair.fairness_table(p, ATTRS)).select("model", "fairness_score")
    return s.join(met.classification_metrics(p).select("model", "f1", "accuracy"), "model")


@register("a37_parity_gap_detail", dbl=["best_dpd", "worst_dpd"], ctes=FT, sql="""
SELECT attribute, count_if(dpd > 0.05) AS n_over_gap, arg_min(model, (dpd, model)) AS best_model,
       min(dpd) AS best_dpd, arg_max(model, (dpd, model)) AS worst_model, max(dpd) AS worst_dpd
FROM ft GROUP BY attribute""")
def parity_gap(spark, d):
    return fair.parity_gap_detail(_ft(spark, d))


@register("a38_actual_vs_predicted", dbl=["actual_rate", "predicted_rate", "spread"], sql="""
WITH g AS (SELECT county_code, model, count(*) AS n, avg(y_true) AS actual_rate, avg(pred) AS predicted_rate
           FROM predictions p JOIN applications a USING (application_id)
           WHERE county_code IS NOT NULL GROUP BY county_code, model),
g2 AS (SELECT *, max(n) OVER (PARTITION BY county_code) AS group_n FROM g),
top AS (SELECT county_code FROM (SELECT DISTINCT county_code, group_n FROM g2)
        ORDER BY group_n DESC, county_code LIMIT 10)
SELECT county_code, model, group_n, actual_rate, predicted_rate,
       max(predicted_rate) OVER (PARTITION BY county_code) - min(predicted_rate) OVER (PARTITION BY county_code)
         AS spread
FROM g2 WHERE county_code IN (SELECT county_code FROM top)""")
def actual_vs_predicted(spark, d):
    from fairlane.sources.tables import applications
    apps = applications(spark, d)
    p = predictions(spark, d, apps).join(apps.select("application_id", "county_code"), "application_id")
    return fair.actual_vs_predicted(p, "county_code", top_k=10)
