"""Remaining source, column, ordering, batch-summary and oversampling queries
(S4, P2, P12, P15, T1, A45, M8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.catalog.q_fit import SPLIT_SQL
from fairlane.catalog.q_models import FEATURES, model_table
from fairlane.operators import balance, columns, models, ordering
from fairlane.session import checkpoint_dir
from fairlane.sources import io
from fairlane.sources.tables import applications, predictions


@register("s04_write_table_roundtrip", dbl=["loan_amount"], sql="""
SELECT application_id, loan_amount, grp_b FROM applications""")
def write_roundtrip(spark, d):
    # Stage hand-over through Parquet in the shared folder (partitioned by segment).
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/applications-{uuid.uuid4().hex}"
    a = applications(spark, d).select("application_id", "loan_amount", "grp_b")
    io.write_table(a, path, partition_by="grp_b")
    return io.read_table(spark, path).select("application_id", "loan_amount", "grp_b")


@register("p02_drop_duplicate_columns", dbl=["loan_amount"], sql="""
SELECT application_id, loan_amount, grp_a FROM applications""")
def drop_dup_cols(spark, d):
    a = applications(spark, d).select("application_id", "loan_amount", "grp_a", F.col("income").alias("x"))
    dup = a.toDF("application_id", "loan_amount", "grp_a", "loan_amount")
    return columns.drop_duplicate_columns(dup)


@register("p12_select_features", dbl=["loan_amount", "income", "property_value", "interest_rate",
                                      "total_loan_costs", "score_signal", "score_random"], sql="""
SELECT loan_amount, income, property_value, interest_rate, total_loan_costs, loan_term, state_code,
       county_code, risk_band, has_coborrower, decision_ts, score_signal, label_signal, score_random
FROM applications""")
def select_feats(spark, d):
    a = applications(spark, d).drop("grp_a", "grp_b")
    a = a.withColumnRenamed("grp_c", "applicant_sex")
    return columns.select_features(a)


@register("p12_select_features_terms", dbl=["loan_amount"], sql="""
SELECT loan_amount, has_coborrower, loan_term AS applicant_age, county_code AS county FROM applications""")
def select_feats_terms(spark, d):
    a = applications(spark, d)
    names = {"application_id": "application_id", "target": "target", "loan_amount": "loan_amount", "has_coborrower": "has_coborrower",
             "loan_term": "applicant_age", "county_code": "county", "grp_a": "minority_tract_flag", "grp_b": "is_hispanic",
             "grp_c": "aus_result", "income": "tract_minority_population_percent", "state_code": "census_tract",
             "risk_band": "action_taken_name", "property_value": "respondent_class"}
    return columns.select_features(a.select(*[F.col(c).alias(n) for c, n in names.items()]))


@register("p15_select_by_type", dbl=["loan_amount", "income", "property_value", "interest_rate",
                                     "total_loan_costs", "score_signal", "score_random"], sql="""
SELECT application_id, loan_amount, income, property_value, interest_rate, total_loan_costs, loan_term, target,
       has_coborrower, score_signal, label_signal, score_random FROM applications""")
def by_type(spark, d):
    return columns.select_by_type(applications(spark, d), "numeric")


@register("t01_order_by", dbl=["loan_amount"], sql="""
SELECT application_id, grp_b, loan_amount FROM applications ORDER BY grp_b DESC, loan_amount, application_id""")
def order_by(spark, d):
    a = applications(spark, d).select("application_id", "grp_b", "loan_amount")
    return ordering.order_by(a, ["grp_b", "loan_amount"], [False, True], tie="application_id")


@register("a45_batch_summary", dbl=["approval_pct", "high_risk_pct", "moderate_risk_pct", "low_risk_pct"], sql="""
SELECT model, count(*) AS total, count_if(pred = 1) AS approved, count_if(pred = 0) AS denied,
       count_if(score < 0.5) AS high_risk, count_if(pred = 1) / count(*) * 100e0 AS approval_pct,
       count_if(score < 0.5) / count(*) * 100e0 AS high_risk_pct,
       count_if(score >= 0.5 AND score < 0.8) / count(*) * 100e0 AS moderate_risk_pct,
       count_if(score >= 0.8) / count(*) * 100e0 AS low_risk_pct FROM predictions GROUP BY model""")
def batch_summary(spark, d):
    return models.batch_summary(predictions(spark, d))


@register("m08_smote_class_counts", ctes=SPLIT_SQL, sql="""
WITH c AS (SELECT CAST(label_signal AS DOUBLE) AS label, count(*) AS n FROM sa WHERE split = 'train' GROUP BY 1)
SELECT label, false AS synthetic, n AS rows FROM c
UNION ALL
SELECT arg_min(label, n), true, max(n) - min(n) FROM c HAVING max(n) > min(n)""")
def smote_counts(spark, d):
    """Rows per class before and by SMOTE over all nine features."""
    t = model_table(spark, d).where("split = 'train'").select("application_id", "label", *FEATURES)
    syn = balance.smote(t, FEATURES, "label")
    out = t.select("label", F.lit(False).alias("synthetic")).unionByName(syn.select("label", "synthetic"))
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("rows"))


@register("m08_nearest_neighbours", dbl=["dist"], sql="""
WITH m AS (SELECT application_id AS id, loan_amount AS a, interest_rate AS b, score_random AS c FROM applications
           WHERE grp_a = 'BUILDING' AND grp_c = 'Female' AND interest_rate IS NOT NULL),
s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc FROM m),
z AS (SELECT id, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c FROM m, s),
p AS (SELECT x.id, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c)) AS dist
      FROM z x JOIN z y ON x.id <> y.id)
SELECT id AS application_id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS rank FROM p
QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist) <= 5""")
def nearest_neighbours(spark, d):
    """Distances of the five nearest of each row of a group, in standardised space."""
    a = applications(spark, d).where("grp_a = 'BUILDING' AND grp_c = 'Female' AND interest_rate IS NOT NULL")
    nb = balance.neighbours(a.select("application_id", "loan_amount", "interest_rate", "score_random"),
                            ["loan_amount", "interest_rate", "score_random"], "application_id", cell_rows=200)
    return nb.select("application_id", "dist", F.col("rank").cast("long").alias("rank"))
