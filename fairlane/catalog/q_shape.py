"""Window, ordering, sampling and reshape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.catalog.q_fairness import ATTRS, FT
from fairlane.operators import fairness as fair
from fairlane.operators import joins, ordering, reshape, segment, windows
from fairlane.operators.metrics import classification_metrics
from fairlane.sources.tables import applications, hash_bucket_sql, load, predictions


@register("w01_fill_gaps", dbl=["income", "property_value"], sql="""
SELECT application_id, grp_a,
  coalesce(last_value(income IGNORE NULLS) OVER wf, first_value(income IGNORE NULLS) OVER wb) AS income,
  coalesce(last_value(property_value IGNORE NULLS) OVER wf, first_value(property_value IGNORE NULLS) OVER wb)
    AS property_value
FROM applications WHERE grp_a IS NOT NULL
WINDOW wf AS (PARTITION BY grp_a ORDER BY application_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       wb AS (PARTITION BY grp_a ORDER BY application_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def fill_gaps(spark, d):
    a = applications(spark, d).where(F.col("grp_a").isNotNull()).select(
        "application_id", "grp_a", "income", "property_value")
    # Keys above 1,000 rows are split into ordered ranges (exercises the hot-key path).
    return windows.fill_gaps(a, ["income", "property_value"], "application_id", "grp_a", rows_per_range=1000)


@register("w01_fill_gaps_null_key_by_time", dbl=["income"], sql="""
SELECT application_id, nullif(grp_b, 'ASIA') AS grp_b,
  coalesce(last_value(income IGNORE NULLS) OVER wf, first_value(income IGNORE NULLS) OVER wb) AS income
FROM (SELECT *, TIMESTAMP '2020-01-01 00:00:00' + to_seconds(application_id * 7) AS seen FROM applications)
WINDOW wf AS (PARTITION BY nullif(grp_b, 'ASIA') ORDER BY seen ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       wb AS (PARTITION BY nullif(grp_b, 'ASIA') ORDER BY seen ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def fill_gaps_null_key(spark, d):
    a = applications(spark, d).select(
        "application_id", F.when(F.col("grp_b") != "ASIA", F.col("grp_b")).alias("grp_b"), "income",
        F.expr("timestamp'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, application_id * 7)").alias("seen"))
    return windows.fill_gaps(a, ["income"], "seen", "grp_b", rows_per_range=1000).drop("seen")


@register("w02_rank_states", dbl=["rate"], sql="""
SELECT state_code, rate, row_number() OVER (ORDER BY rate DESC, state_code) AS rank
FROM (SELECT state_code, avg(target) AS rate FROM applications WHERE state_code IS NOT NULL GROUP BY state_code)""")
def rank_states(spark, d):
    r = segment.rate_by(applications(spark, d), "state_code").select("state_code", "rate")
    return windows.rank_importance(r, "rate", "state_code")


@register("w03_top_k_per_state", dbl=["loan_amount"], sql="""
SELECT state_code, application_id, loan_amount, rank FROM (
  SELECT state_code, application_id, loan_amount,
         row_number() OVER (PARTITION BY state_code ORDER BY loan_amount DESC, application_id) AS rank
  FROM applications) WHERE rank <= 3""")
def top_k(spark, d):
    a = applications(spark, d).select("state_code", "application_id", "loan_amount")
    return windows.top_k_per_key(a, "state_code", "loan_amount", 3, tie="application_id")


@register("w04_share_of_total", dbl=["share"], sql="""
SELECT grp_b, state_code, n, n / sum(n) OVER (PARTITION BY grp_b) AS share
FROM (SELECT grp_b, state_code, count(*) AS n FROM applications GROUP BY grp_b, state_code)""")
def share(spark, d):
    g = applications(spark, d).groupBy("grp_b", "state_code").agg(F.count(F.lit(1)).alias("n"))
    return windows.share_of_total(g, "n", "grp_b")


@register("t02_order_by_list", sql="""
SELECT application_id, risk_band FROM applications
ORDER BY CASE risk_band WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 ELSE 4 END,
         application_id""")
def order_by_list(spark, d):
    a = applications(spark, d).select("application_id", "risk_band")
    return ordering.order_by_list(a, "risk_band", ["5-LOW", "3-MEDIUM", "1-URGENT"], tie="application_id")


@register("t03_top_n", dbl=["loan_amount"], sql="""
SELECT application_id, loan_amount FROM applications ORDER BY loan_amount DESC, application_id LIMIT 10""")
def top_n(spark, d):
    return ordering.top_n(applications(spark, d).select("application_id", "loan_amount"), "loan_amount", 10,
                          tie="application_id")


@register("t04_sample_rows", sql=f"""
SELECT application_id FROM applications WHERE {hash_bucket_sql('sample', 'application_id', 1000000)} < 50000""")
def sample(spark, d):
    return ordering.sample_rows(applications(spark, d).select("application_id"), "application_id", 0.05)


@register("t05_head_tail", dbl=["o_totalprice"], sql="""
(SELECT o_orderkey, o_totalprice, 'head' AS part FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL (SELECT o_orderkey, o_totalprice, 'tail' FROM orders ORDER BY o_orderkey DESC LIMIT 5)""")
def head_tail(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return (ordering.head_tail(o, "o_orderkey", 5).withColumn("part", F.lit("head"))
            .unionByName(ordering.head_tail(o, "o_orderkey", 5, tail=True).withColumn("part", F.lit("tail"))))


@register("u01_u02_union_distinct", sql="""
SELECT DISTINCT grp_a, grp_b FROM (
  SELECT grp_a, grp_b FROM applications WHERE target = 1
  UNION ALL SELECT grp_a, grp_b FROM applications WHERE target = 0)""")
def union_distinct(spark, d):
    a = applications(spark, d)
    u = reshape.union_all(a.where("target = 1").select("grp_a", "grp_b"), a.where("target = 0").select("grp_a", "grp_b"))
    return reshape.distinct_rows(u)


@register("u03_common_top_states", sql="""
WITH r AS (SELECT model, state_code, row_number() OVER (PARTITION BY model ORDER BY avg(score) DESC, state_code) AS rank
           FROM predictions p JOIN applications a USING (application_id) GROUP BY model, state_code),
t AS (SELECT state_code, count(DISTINCT model) AS n_models FROM r WHERE rank <= 15 GROUP BY state_code)
SELECT state_code AS feature, n_models FROM t WHERE n_models = (SELECT count(DISTINCT model) FROM predictions)""")
def common_top(spark, d):
    apps = applications(spark, d)
    p = predictions(spark, d, apps).join(apps.select("application_id", "state_code"), "application_id")
    g = p.groupBy("model", "state_code").agg(F.avg("score").alias("v")).withColumnRenamed("state_code", "feature")
    ranked = windows.rank_importance(g, "v", "feature", by="model")
    return reshape.common_top_features(ranked, 15)


@register("u05_melt_metrics", dbl=["value"], sql="""
WITH m AS (SELECT model, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0e0) AS accuracy,
                  coalesce(tp / nullif(tp + fp, 0), 0e0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0e0) AS recall
           FROM (SELECT model, count_if(y_true = 0 AND pred = 0) AS tn, count_if(y_true = 0 AND pred = 1) AS fp,
                        count_if(y_true = 1 AND pred = 0) AS fn, count_if(y_true = 1 AND pred = 1) AS tp
                 FROM predictions GROUP BY model))
SELECT model, metric, value FROM m UNPIVOT (value FOR metric IN (accuracy, precision, recall))""")
def melt(spark, d):
    m = classification_metrics(predictions(spark, d)).select("model", "accuracy", "precision", "recall")
    return reshape.melt(m, "model", ["accuracy", "precision", "recall"])


@register("u06_pivot_dpd", dbl=["grp_a", "grp_b", "grp_c"], ctes=FT, sql="""
SELECT model, max(dpd) FILTER (WHERE attribute = 'grp_a') AS grp_a, max(dpd) FILTER (WHERE attribute = 'grp_b') AS grp_b,
       max(dpd) FILTER (WHERE attribute = 'grp_c') AS grp_c FROM ft GROUP BY model""")
def pivot(spark, d):
    ft = fair.fairness_table(predictions(spark, d), ATTRS)
    return reshape.pivot_wide(ft, "model", "attribute", ATTRS, "dpd")


@register("j06_attach_protected", dbl=["score"], sql="""
SELECT p.application_id, p.model, p.score, a.grp_a, a.grp_c FROM predictions p
JOIN applications a ON p.application_id = a.application_id""")
def attach_protected(spark, d):
    apps = applications(spark, d)
    p = predictions(spark, d, apps).select("application_id", "model", "score")
    return joins.attach_protected(p, apps.select("application_id", "grp_a", "grp_c"))


