"""Explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.catalog.q_fairness import FT_DBL, ft_sql
from fairlane.catalog.q_fit import SPLIT_SQL
from fairlane.catalog.q_models import FEATURES, model_table
from fairlane.operators import explain, fairness, models, tree_shapley, windows
from fairlane.sources.tables import applications, hash_bucket, predictions

COEFS = {"interest_rate": 0.5, "loan_amount": -0.00001, "has_coborrower": 1.0}

CONTRIB_SQL = """
mu AS (SELECT avg(interest_rate) AS m_ir, avg(loan_amount) AS m_la, avg(has_coborrower) AS m_co FROM applications),
lc AS (SELECT application_id, 'interest_rate' AS feature, interest_rate AS value,
              0.5e0 * (coalesce(interest_rate, m_ir) - m_ir) AS contribution FROM applications, mu
       UNION ALL SELECT application_id, 'loan_amount', loan_amount, -0.00001e0 * (coalesce(loan_amount, m_la) - m_la)
       FROM applications, mu
       UNION ALL SELECT application_id, 'has_coborrower', CAST(has_coborrower AS DOUBLE),
              1e0 * (coalesce(CAST(has_coborrower AS DOUBLE), m_co) - m_co) FROM applications, mu)"""


@register("m21_linear_contributions", dbl=["value", "contribution", "base"], ctes=CONTRIB_SQL, sql="""
SELECT lc.*, 0.5e0 * m_ir + -0.00001e0 * m_la + 1e0 * m_co AS base FROM lc, mu""")
def linear_contributions(spark, d):
    return explain.linear_contributions(applications(spark, d), COEFS)


@register("a39_mean_abs_importance", dbl=["importance"], ctes=CONTRIB_SQL, sql="""
SELECT feature, avg(abs(contribution)) AS importance,
       row_number() OVER (ORDER BY avg(abs(contribution)) DESC, feature) AS rank FROM lc GROUP BY feature""")
def mean_abs(spark, d):
    return explain.mean_abs_importance(explain.linear_contributions(applications(spark, d), COEFS))


@register("w05_top_factors", dbl=["value"], ctes=CONTRIB_SQL, sql="""
SELECT application_id, 'positive' AS kind, feature, contribution AS value, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY contribution DESC, feature) AS pos
  FROM lc WHERE contribution > 0) WHERE pos <= 2
UNION ALL
SELECT application_id, 'negative', feature, contribution, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY contribution ASC, feature DESC) AS pos
  FROM lc WHERE contribution < 0) WHERE pos <= 2""")
def top_factors(spark, d):
    a = applications(spark, d)
    means = explain.column_means(a, list(COEFS))
    t = a.select("application_id", explain.contribution_array(COEFS, means).alias("contributions"))
    t = windows.top_factors(t, "contributions", 2)
    pos = t.select("application_id", F.lit("positive").alias("kind"), F.posexplode("top_positive").alias("pos", "f"))
    neg = t.select("application_id", F.lit("negative").alias("kind"), F.posexplode("top_negative").alias("pos", "f"))
    return pos.unionByName(neg).select("application_id", "kind", F.col("f.feature").alias("feature"),
                                       F.col("f.value").alias("value"), (F.col("pos") + 1).alias("pos"))


@register("j04_m25_importance_agreement", dbl=["importance_a", "importance_b", "share_a", "share_b", "agreement"],
          ctes=CONTRIB_SQL, sql="""
WITH a AS (SELECT feature, avg(abs(contribution)) AS importance_a FROM lc GROUP BY feature),
b AS (SELECT 'interest_rate' AS feature, abs(corr(interest_rate, label_signal)) AS importance_b FROM applications
      UNION ALL SELECT 'loan_amount', abs(corr(loan_amount, label_signal)) FROM applications
      UNION ALL SELECT 'has_coborrower', abs(corr(CAST(has_coborrower AS DOUBLE), label_signal)) FROM applications),
j AS (SELECT a.feature, importance_a, importance_b, importance_a / sum(importance_a) OVER () AS share_a,
             importance_b / sum(importance_b) OVER () AS share_b FROM a JOIN b ON a.feature = b.feature)
SELECT *, corr(share_a, share_b) OVER () AS agreement FROM j""")
def importance_agreement(spark, d):
    a = applications(spark, d)
    imp_a = explain.mean_abs_importance(explain.linear_contributions(a, COEFS))
    row = a.agg(*[F.abs(F.corr(F.col(c).cast("double"), "label_signal")).alias(c) for c in COEFS]).first()
    imp_b = spark.createDataFrame([(c, float(row[c])) for c in COEFS], "feature string, importance double")
    return explain.combine_importances(imp_a, imp_b)


@register("m26_group_thresholds", dbl=["rate"], sql="""
WITH c AS (SELECT model, grp_b, quantile_cont(score, 0.5) AS cut FROM predictions WHERE grp_b IS NOT NULL
           GROUP BY model, grp_b),
p AS (SELECT p.model, p.grp_b, coalesce(CAST(p.score >= c.cut AS INTEGER), p.pred) AS pred
      FROM predictions p LEFT JOIN c ON p.model = c.model AND p.grp_b = c.grp_b)
SELECT model, grp_b, count(*) AS n, avg(pred) AS rate FROM p WHERE grp_b IS NOT NULL GROUP BY model, grp_b""")
def group_thresholds(spark, d):
    adj = explain.group_thresholds(predictions(spark, d), "grp_b", target_rate=0.5)
    return adj.where(F.col("grp_b").isNotNull()).groupBy("model", "grp_b").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("rate"))


@register("m26_group_thresholds_model_rate", dbl=FT_DBL, ctes="""
own AS (SELECT model, round(1e0 - avg(pred), 12) AS p FROM predictions WHERE grp_b IS NOT NULL GROUP BY model),
rk AS (SELECT model, grp_b, score, row_number() OVER (PARTITION BY model, grp_b ORDER BY score) - 1 AS k,
              count(*) OVER (PARTITION BY model, grp_b) AS n FROM predictions WHERE grp_b IS NOT NULL),
cut AS (SELECT rk.model, grp_b, max(score) FILTER (k = floor(p * (n - 1)))
               + (max(score) FILTER (k = ceil(p * (n - 1))) - max(score) FILTER (k = floor(p * (n - 1)))) * max(p * (n - 1) - floor(p * (n - 1))) AS cut
        FROM rk JOIN own ON own.model = rk.model GROUP BY 1, 2),
adj AS (SELECT p.model, p.y_true, p.grp_a, p.grp_b, p.grp_c, coalesce(CAST(p.score >= cut.cut AS INTEGER), p.pred) AS pred
        FROM predictions p LEFT JOIN cut ON cut.model = p.model AND cut.grp_b = p.grp_b),""" + ft_sql("adj"), sql="SELECT * FROM ft")
def group_thresholds_own_rate(spark, d):
    adj = explain.group_thresholds(predictions(spark, d), "grp_b")
    return fairness.fairness_table(adj, ["grp_a", "grp_b", "grp_c"])


@register("m21_sampled_contributions")
def sampled_contributions(spark, d):
    t = model_table(spark, d)
    m = models.train(t.where("split = 'train'"), FEATURES, "tree", maxDepth=5)
    # Background: a fixed-size hash sample of the training rows (the sampling step of the method).
    bg = (t.where("split = 'train'").orderBy(hash_bucket("bg", F.col("application_id"), 1 << 30), "application_id")
          .limit(50).select(*FEATURES))
    c = explain.sampled_contributions(m, t.select("application_id", *FEATURES), FEATURES, bg, n_samples=4)
    return explain.mean_abs_importance(c)


def _tree_contributions(spark, d):
    """Every row and feature, by the trees' own paths."""
    t = model_table(spark, d).select("application_id", "split", "label", *FEATURES)
    train = t.where("split = 'train'")
    for kind, params in (("tree", {}), ("gbt", {"maxIter": 20, "maxDepth": 5})):
        m = models.train(train, FEATURES, kind, **params)
        yield kind, tree_shapley.tree_contributions(m, t, FEATURES)


@register("m21_tree_contributions")
def tree_contributions(spark, d):
    parts = [c.withColumn("model", F.lit(kind)) for kind, c in _tree_contributions(spark, d)]
    return explain.mean_abs_importance(parts[0].unionByName(parts[1]), "model")


@register("m21_tree_contributions_add_up", ctes=SPLIT_SQL, sql="""
SELECT m.model, count(*) AS rows, 9 * count(*) AS cells, true AS adds_up FROM sa, (VALUES ('tree'), ('gbt')) m(model) GROUP BY m.model""")
def tree_contributions_add_up(spark, d):
    """Each row's contributions are its score less the base."""
    out = []
    for kind, c in _tree_contributions(spark, d):
        rows = c.groupBy("application_id").agg(F.count("contribution").alias("k"), (F.abs(F.sum("contribution") - F.max("score") + F.max("base")) < 1e-9).alias("ok"))
        out.append(rows.agg(F.lit(kind).alias("model"), F.count(F.lit(1)).alias("rows"), F.sum("k").alias("cells"), F.every("ok").alias("adds_up")))
    return out[0].unionByName(out[1])
