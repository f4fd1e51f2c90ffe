"""Feature queries (F1-F23, J1, J2, J9) over the ``applications`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.functions import features as fx
from fairlane.operators import joins
from fairlane.sources.tables import applications, hash_bucket, hash_bucket_sql, load, predictions

# Test lookup for the order-priority text standing in for a debt band.
PRIORITY_RISK = {"1-URGENT": "High Risk", "2-HIGH": "Elevated Risk", "3-MEDIUM": "Moderate Risk",
                 "5-LOW": "Low Risk"}
AGE_BANDS = list(fx.AGE_MIDPOINT)


def _case_map(col: str, m: dict, default: str | None = None) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"{float(v)}e0"
    whens = " ".join(f"WHEN {col} = '{k}' THEN {lit(v)}" for k, v in m.items())
    return f"CASE {whens} ELSE {lit(default) if default is not None else 'NULL'} END"


def _cut_sql(col: str, edges, labels, include_lowest=False) -> str:
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lo_op = ">=" if include_lowest and i == 0 else ">"
        hi_s = "'infinity'::DOUBLE" if hi == float("inf") else f"{float(hi)}e0"
        parts.append(f"WHEN {col} {lo_op} {float(lo)}e0 AND {col} <= {hi_s} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


def _capped(num: str, den: str, cap: float, scale: str = "1e0") -> str:
    r = f"({num}) / nullif({den}, 0) * {scale}"
    return (f"CASE WHEN ({den}) = 0 AND ({num}) > 0 THEN {cap}e0 WHEN {r} IS NULL THEN NULL "
            f"ELSE least({r}, {cap}e0) END")


LTI = _capped("loan_amount", "income", 10.0)
LTV = _capped("loan_amount", "property_value", 150.0, "100e0")
HER = _capped("loan_amount * interest_rate / 100e0 / 12e0", "income / 12e0", 1.0)
LCR = _capped("total_loan_costs", "loan_amount", 0.2)
LTV_TIER = ("CASE WHEN ltv IS NULL OR isnan(ltv) THEN 'Unknown' WHEN ltv <= 80e0 THEN 'Low Risk' "
            "WHEN ltv <= 90e0 THEN 'Moderate Risk' WHEN ltv <= 97e0 THEN 'Elevated Risk' ELSE 'High Risk' END")
FEAT_CTE = f"""
feat AS (SELECT *, {LTI} AS lti, {LTV} AS ltv, {HER} AS her, {LCR} AS lcr FROM applications)"""


@register("f01_ratio_features", dbl=["loan_to_income_ratio", "loan_to_value_ratio", "housing_expense_ratio",
                                     "loan_costs_ratio"], ctes=FEAT_CTE, sql="""
SELECT application_id, lti AS loan_to_income_ratio, ltv AS loan_to_value_ratio, her AS housing_expense_ratio,
       lcr AS loan_costs_ratio FROM feat""")
def ratio_features(spark, d):
    a = applications(spark, d).select("application_id", "loan_amount", "income", "property_value",
                                      "interest_rate", "total_loan_costs")
    return fx.ratio_features(a).select("application_id", "loan_to_income_ratio", "loan_to_value_ratio",
                                       "housing_expense_ratio", "loan_costs_ratio")


@register("f02_interaction_features", dbl=["dti_ltv_interaction", "income_coborrower_interaction",
                                           "loan_rate_interaction", "age_income_interaction"], ctes=FEAT_CTE, sql=f"""
SELECT application_id, lti * ltv / 100e0 AS dti_ltv_interaction,
       income * has_coborrower AS income_coborrower_interaction,
       loan_amount / 1000e0 * interest_rate AS loan_rate_interaction,
       CASE {" ".join(f"WHEN {hash_bucket_sql('g', 'application_id', 7)} = {i} THEN {float(v)}e0"
                      for i, v in enumerate(fx.AGE_MIDPOINT.values()))} END * (income / 1000e0) AS age_income_interaction
FROM feat""")
def interaction_features(spark, d):
    a = applications(spark, d).select("application_id", "loan_amount", "income", "property_value",
                                      "interest_rate", "has_coborrower")
    a = a.withColumn("applicant_age", F.element_at(F.array(*[F.lit(b) for b in AGE_BANDS]),
                                                   (hash_bucket("g", F.col("application_id"), 7) + 1).cast("int")))
    out = fx.interaction_features(fx.ratio_features(a))
    return out.select("application_id", "dti_ltv_interaction", "income_coborrower_interaction",
                      "loan_rate_interaction", "age_income_interaction")


@register("f03_f04_f07_risk_tiers", dbl=["combined_risk_score"], ctes=FEAT_CTE, sql=f"""
WITH t AS (SELECT application_id, {_case_map('risk_band', PRIORITY_RISK, 'Unknown')} AS dti_risk_flag,
                  {LTV_TIER} AS ltv_risk_flag FROM feat)
SELECT application_id, dti_risk_flag, ltv_risk_flag,
       ({_case_map('dti_risk_flag', fx.RISK_SCORE)} + {_case_map('ltv_risk_flag', fx.RISK_SCORE)}) / 2e0
         AS combined_risk_score FROM t""")
def risk_tiers(spark, d):
    a = fx.ratio_features(applications(spark, d))
    a = a.select("application_id", fx.debt_band_risk("risk_band", PRIORITY_RISK).alias("dti_risk_flag"),
                 fx.ltv_tier("loan_to_value_ratio").alias("ltv_risk_flag"))
    return a.withColumn("combined_risk_score", fx.combined_risk("dti_risk_flag", "ltv_risk_flag"))


@register("f05_bin_columns", sql=f"""
SELECT application_id, {_cut_sql('income', *fx.INCOME_BRACKETS)} AS income_bracket,
       {_cut_sql('loan_amount', *fx.LOAN_SIZES)} AS loan_size_category,
       {_cut_sql('income', *fx.INCOME_CLASSES, include_lowest=True)} AS income_class
FROM applications""")
def bin_columns(spark, d):
    a = applications(spark, d)
    return a.select("application_id", fx.bin_column("income", *fx.INCOME_BRACKETS).alias("income_bracket"),
                    fx.bin_column("loan_amount", *fx.LOAN_SIZES).alias("loan_size_category"),
                    fx.bin_column("income", *fx.INCOME_CLASSES, include_lowest=True).alias("income_class"))


@register("f06_quantile_bins", sql="""
WITH q AS (SELECT quantile_cont(interest_rate, 0.33) AS q33, quantile_cont(interest_rate, 0.67) AS q67
           FROM applications)
SELECT application_id, CASE WHEN interest_rate > 0 AND interest_rate <= q33 THEN 0
                            WHEN interest_rate > q33 AND interest_rate <= q67 THEN 1
                            WHEN interest_rate > q67 AND interest_rate <= 1000 THEN 2 END AS rate_tercile
FROM applications, q""")
def quantile_bins(spark, d):
    a = applications(spark, d)
    edges = fx.quantile_edges(a, "interest_rate", (0.33, 0.67), 0.0, 1000.0)
    return a.select("application_id", fx.bin_column("interest_rate", edges, ["low", "mid", "high"],
                                                    ordinal=True).alias("rate_tercile"))


@register("f08_f15_flags", sql=f"""
SELECT application_id,
       CASE WHEN co IS NULL THEN 1 ELSE CAST(co <> 'No co-applicant' AS INTEGER) END AS coborrower,
       {_case_map('grp_c', fx.APPLICATION_TYPE, 'Unknown')} AS application_type,
       CAST(coalesce(grp_b IN ('AFRICA', 'ASIA'), false) AS INTEGER) AS minority
FROM (SELECT *, CASE WHEN has_coborrower = 1 THEN 'Hispanic' WHEN loan_term = 180 THEN NULL
                     ELSE 'No co-applicant' END AS co FROM applications)""")
def flags(spark, d):
    a = applications(spark, d).withColumn(
        "co", F.when(F.col("has_coborrower") == 1, "Hispanic").when(F.col("loan_term") == 180, None)
        .otherwise("No co-applicant"))
    return a.select("application_id", fx.coborrower_flag("co").alias("coborrower"),
                    fx.application_type("grp_c").alias("application_type"),
                    fx.minority_flag("grp_b", ["AFRICA", "ASIA"]).alias("minority"))


@register("f09_age_midpoint", dbl=["age_mid"], sql=f"""
SELECT application_id, {_case_map('band', {k: float(v) for k, v in fx.AGE_MIDPOINT.items()})} AS age_mid
FROM (SELECT application_id, ['{"', '".join(AGE_BANDS)}'][{hash_bucket_sql('g', 'application_id', 7)} + 1] AS band
      FROM applications)""")
def age_midpoint(spark, d):
    a = applications(spark, d).select(
        "application_id", F.element_at(F.array(*[F.lit(b) for b in AGE_BANDS]),
                                       (hash_bucket("g", F.col("application_id"), 7) + 1).cast("int")).alias("band"))
    return a.select("application_id", fx.age_midpoint("band").alias("age_mid"))


@register("f10_f11_codes_units", dbl=["acctbal_cents"], sql="""
SELECT c_custkey, CASE WHEN length(CAST(c_nationkey AS VARCHAR)) < 3 THEN lpad(CAST(c_nationkey AS VARCHAR), 3, '0')
                       ELSE CAST(c_nationkey AS VARCHAR) END AS state_code,
       CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 5 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0')
            ELSE CAST(c_custkey AS VARCHAR) END AS county_code,
       c_acctbal * 100e0 AS acctbal_cents FROM customer""")
def codes_units(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", fx.pad_code("c_nationkey", 3).alias("state_code"),
                    fx.pad_code("c_custkey", 5).alias("county_code"),
                    fx.scale_units("c_acctbal", 100.0).alias("acctbal_cents"))


PAY_SQL = """CASE WHEN interest_rate / 1200e0 > 0
  THEN loan_amount * (interest_rate / 1200e0) * pow(1e0 + interest_rate / 1200e0, loan_term)
       / nullif(pow(1e0 + interest_rate / 1200e0, loan_term) - 1e0, 0)
  ELSE loan_amount / nullif(CAST(loan_term AS DOUBLE), 0) END"""


@register("f12_f20_payments_badges", dbl=["monthly_payment", "dti_pct"], ctes=FEAT_CTE, sql=f"""
WITH p AS (SELECT *, {PAY_SQL} AS pay FROM feat)
SELECT application_id, pay AS monthly_payment,
       CASE WHEN income > 0 THEN pay * 12e0 / nullif(income, 0) * 100e0 ELSE 0e0 END AS dti_pct,
       CASE WHEN ltv <= 80e0 THEN 'Good' WHEN ltv <= 95e0 THEN 'Fair' ELSE 'High' END AS ltv_badge,
       CASE WHEN lti <= 4e0 THEN 'Good' WHEN lti <= 6e0 THEN 'Fair' ELSE 'High' END AS lti_badge,
       CASE WHEN (CASE WHEN income > 0 THEN pay * 12e0 / nullif(income, 0) * 100e0 ELSE 0e0 END) <= 36e0 THEN 'Good'
            WHEN (CASE WHEN income > 0 THEN pay * 12e0 / nullif(income, 0) * 100e0 ELSE 0e0 END) <= 43e0 THEN 'Fair'
            ELSE 'High' END AS dti_badge
FROM p""")
def payments_badges(spark, d):
    a = fx.ratio_features(applications(spark, d))
    dti = fx.payment_share_of_income("loan_amount", "interest_rate", "loan_term", "income")
    return a.select("application_id",
                    fx.monthly_payment("loan_amount", "interest_rate", "loan_term").alias("monthly_payment"),
                    dti.alias("dti_pct"), fx.badge("loan_to_value_ratio", "ltv").alias("ltv_badge"),
                    fx.badge("loan_to_income_ratio", "lti").alias("lti_badge"), fx.badge(dti, "dti").alias("dti_badge"))


@register("f13_validate_records", sql="""
WITH r AS (SELECT application_id, list_filter([
    CASE WHEN loan_amount IS NULL THEN 'loan_amount:missing' END,
    CASE WHEN loan_amount <= 0 THEN 'loan_amount:<=0' END,
    CASE WHEN property_value IS NULL THEN 'property_value:missing' END,
    CASE WHEN property_value <= 0 THEN 'property_value:<=0' END,
    CASE WHEN income IS NULL THEN 'income:missing' END,
    CASE WHEN income < 0 THEN 'income:<0' END,
    CASE WHEN interest_rate IS NULL THEN 'interest_rate:missing' END,
    CASE WHEN interest_rate < 0 THEN 'interest_rate:<0' END,
    CASE WHEN interest_rate > 100 THEN 'interest_rate:>100' END,
    CASE WHEN loan_term <= 0 THEN 'loan_term:<=0' END,
    CASE WHEN loan_term > 600 THEN 'loan_term:>600' END,
    'applicant_age:missing'], lambda x: x IS NOT NULL) AS v FROM (
  SELECT application_id, loan_amount, property_value, income, interest_rate,
         CASE WHEN loan_term = 180 THEN 700 ELSE loan_term END AS loan_term FROM applications))
SELECT application_id, array_to_string(v, ';') AS violations, len(v) = 0 AS valid FROM r""")
def validate_records(spark, d):
    a = applications(spark, d).select(
        "application_id", "loan_amount", "property_value", "income", "interest_rate",
        F.when(F.col("loan_term") == 180, 700).otherwise(F.col("loan_term")).alias("loan_term"))
    rules = dict(fx.REQUEST_RULES)
    rules["applicant_age"] = (18.0, True, 100.0, True, True)
    v = fx.validate_records(a, rules)
    return v.select("application_id", F.array_join("violations", ";").alias("violations"), "valid")


@register("f14_serving_defaults", dbl=["income", "tract_population", "origination_charges"], sql="""
SELECT application_id, coalesce(income, 75000e0) AS income, 50000e0 AS tract_population,
       3000e0 AS origination_charges FROM applications""")
def serving_defaults(spark, d):
    a = applications(spark, d).select("application_id", "income")
    out = fx.serving_defaults(a, {"income": 75000.0, "tract_population": 50000.0,
                                  "origination_charges": fx.SERVING_DEFAULTS["origination_charges"]})
    return out


@register("f14_serving_defaults_all", sql="SELECT application_id, coalesce(CAST(loan_term AS DOUBLE), 360e0) AS loan_term, " + ", ".join(
    f"{v!r}e0 AS {c}" for c, v in fx.SERVING_DEFAULTS.items() if c != "loan_term") + " FROM applications")
def serving_defaults_all(spark, d):
    """All fifteen constants; the term is carried by the request."""
    return fx.serving_defaults(applications(spark, d).select("application_id", F.col("loan_term").cast("double").alias("loan_term")))


@register("f20_housing_band", dbl=["her"], ctes=FEAT_CTE, sql=f"""
WITH p AS (SELECT application_id, CASE WHEN income > 0 THEN {PAY_SQL} * 12e0 / nullif(income, 0) * 100e0 ELSE 0e0 END AS her FROM feat)
SELECT application_id, her, CASE WHEN her < 28 THEN 'Ideal' WHEN her <= 33 THEN 'Acceptable' WHEN her <= 36 THEN 'Elevated'
                                 WHEN her IS NOT NULL THEN 'High' END AS band FROM p""")
def housing_band(spark, d):
    her = fx.payment_share_of_income("loan_amount", "interest_rate", "loan_term", "income")
    return applications(spark, d).select("application_id", her.alias("her"), fx.housing_band(her).alias("band"))


@register("f16_decide", dbl=["score", "confidence"], sql="""
SELECT application_id, model, score, CASE WHEN score >= 0.5 THEN 'Approved' ELSE 'Denied' END AS decision,
       abs(score - 0.5e0) * 200e0 AS confidence,
       CASE WHEN score >= 0.8 THEN 'Low Risk' WHEN score >= 0.5 THEN 'Moderate Risk' ELSE 'High Risk' END AS risk_level,
       CASE WHEN score > 0.7 THEN 'APPROVED (High Confidence)' WHEN score > 0.5 THEN 'APPROVED (Moderate Confidence)'
            WHEN score > 0.3 THEN 'DENIED (Moderate Confidence)' ELSE 'DENIED (High Confidence)' END AS wording,
       CASE WHEN score * 100e0 >= 75 THEN 'Strong candidate for approval'
            WHEN score * 100e0 >= 50 THEN 'Review required - borderline case'
            WHEN score * 100e0 >= 25 THEN 'High risk - consider additional documentation'
            ELSE 'Likely denial - significant risk factors present' END AS advice,
       score >= 0.4 AND score <= 0.6 AS needs_review
FROM predictions""")
def decide(spark, d):
    p = predictions(spark, d)
    cols = fx.decide("score")
    return p.select("application_id", "model", "score", *[c.alias(k) for k, c in cols.items()])


@register("f17_key_factors", dbl=["impact"], ctes=FEAT_CTE, sql="""
SELECT application_id, 'loan_to_value_ratio' AS feature,
       CASE WHEN coalesce(ltv / 100e0 < 0.8, false) THEN 0.1 ELSE -0.1 END AS impact,
       CASE WHEN coalesce(ltv / 100e0 < 0.8, false) THEN 'positive' ELSE 'negative' END AS direction FROM feat
UNION ALL SELECT application_id, 'income', CASE WHEN coalesce(income > 80000, false) THEN 0.08 ELSE -0.05 END,
       CASE WHEN coalesce(income > 80000, false) THEN 'positive' ELSE 'negative' END FROM feat
UNION ALL SELECT application_id, 'loan_to_income_ratio', CASE WHEN coalesce(lti > 4, false) THEN -0.06 ELSE 0.04 END,
       CASE WHEN coalesce(lti > 4, false) THEN 'negative' ELSE 'positive' END FROM feat""")
def key_factors(spark, d):
    a = fx.ratio_features(applications(spark, d))
    a = a.select("application_id", fx.key_factors(F.col("loan_to_value_ratio") / 100.0).alias("kf"))
    return a.select("application_id", F.inline("kf"))


@register("f18_a49_reason_codes", ctes=FEAT_CTE, sql="""
WITH d AS (SELECT p.model, f.lti, f.ltv, f.income, f.interest_rate FROM predictions p
           JOIN feat f ON p.application_id = f.application_id WHERE p.pred = 0),
r AS (SELECT model, unnest(list_filter([CASE WHEN lti > 5 THEN 'DTI_HIGH' END,
        CASE WHEN ltv > 95 THEN 'LTV_HIGH' END, CASE WHEN income < 40000 THEN 'INCOME_LOW' END,
        CASE WHEN interest_rate > 8 THEN 'RATE_HIGH' END], lambda x: x IS NOT NULL)) AS reason FROM d)
SELECT model, reason, CASE reason WHEN 'DTI_HIGH' THEN 'Debt-to-income ratio too high' WHEN 'LTV_HIGH' THEN 'Loan-to-value ratio exceeds guidelines'
         WHEN 'INCOME_LOW' THEN 'Insufficient income for requested amount' ELSE 'Interest rate indicates elevated risk' END AS reason_text,
       count(*) AS n FROM r GROUP BY model, reason""")
def reason_codes(spark, d):
    apps = fx.ratio_features(applications(spark, d))
    p = predictions(spark, d, applications(spark, d)).select("application_id", "model", "pred")
    j = p.join(apps.select("application_id", "loan_to_income_ratio", "loan_to_value_ratio", "income",
                           "interest_rate"), "application_id")
    codes = j.select("model", fx.reason_codes("pred").alias("codes"))
    r = codes.select("model", F.explode(F.arrays_zip("codes", fx.reason_texts("codes").alias("texts"))).alias("r"))
    return r.groupBy("model", F.col("r.codes").alias("reason"), F.col("r.texts").alias("reason_text")).agg(F.count(F.lit(1)).alias("n"))


@register("f19_explanation_text", sql="""
SELECT application_id, model,
  printf('%s (%.0f%% probability, %.0f%% confidence) based on: %s',
         CASE WHEN score >= 0.5 THEN 'APPROVED' ELSE 'DENIED' END, round(score * 100e0, 0),
         round(abs(score - 0.5e0) * 200e0, 0),
         printf('score (%+.2f)', floor((score - 0.5e0) * 100e0) / 100e0)) AS text
FROM predictions""")
def explanation_text(spark, d):
    p = predictions(spark, d)
    val = F.floor((F.col("score") - 0.5) * 100.0) / 100.0
    fac = F.array(F.struct(F.lit("score").alias("feature"), val.alias("value")))
    empty = F.array().cast("array<struct<feature:string,value:double>>")
    p = p.withColumn("top_positive", F.when(F.col("score") >= 0.5, fac).otherwise(empty)) \
         .withColumn("top_negative", F.when(F.col("score") < 0.5, fac).otherwise(empty))
    return p.select("application_id", "model", fx.explanation_text("score").alias("text"))


@register("f21_f22_finite_text", dbl=["ratio"], sql="""
SELECT application_id, CASE WHEN grp_c = 'Female' THEN NULL ELSE loan_amount END AS ratio,
       lower(trim('  ' || grp_a || ' ')) AS seg
FROM applications""")
def finite_text(spark, d):
    a = applications(spark, d)
    raw = F.when(F.col("grp_c") == "Female", F.lit(float("inf"))).otherwise(F.col("loan_amount"))
    return a.select("application_id", fx.finite_or_null(raw).alias("ratio"),
                    fx.text_normal(F.concat(F.lit("  "), F.col("grp_a"), F.lit(" "))).alias("seg"))


@register("f23_apply_scorecard", dbl=["points", "probability"], sql="""
WITH s AS (SELECT application_id, -2e0 + 0.5e0 * coalesce(interest_rate, 0e0) + -0.00001e0 * coalesce(loan_amount, 0e0)
                  + 1e0 * coalesce(CAST(has_coborrower AS DOUBLE), 0e0) AS points FROM applications)
SELECT application_id, points, 1e0 / (1e0 + exp(-points * 0.5e0)) AS probability, CAST(points > 0 AS INTEGER) AS pred
FROM s""")
def scorecard(spark, d):
    a = applications(spark, d)
    cols = fx.apply_scorecard({"interest_rate": 0.5, "loan_amount": -0.00001, "has_coborrower": 1.0}, -2.0, 0.5)
    return a.select("application_id", *[c.alias(k) for k, c in cols.items()])


@register("j01_attach_group_stat", dbl=["state_rate"], sql="""
SELECT a.application_id, a.state_code, s.state_rate FROM applications a
LEFT JOIN (SELECT state_code, avg(target) AS state_rate FROM applications WHERE state_code IS NOT NULL
           GROUP BY state_code) s ON a.state_code = s.state_code""")
def attach_group_stat(spark, d):
    a = applications(spark, d)
    stats = joins.group_stat(a, "state_code", "target", "avg", "state_rate")
    return joins.attach_group_stat(a.select("application_id", "state_code"), "state_code", stats)


@register("j02_decode_lookup", sql=f"""
SELECT application_id, {_case_map('risk_band', fx.DTI_RISK_EDA | PRIORITY_RISK, 'Unknown')} AS tier FROM applications""")
def decode_lookup(spark, d):
    a = applications(spark, d)
    return a.select("application_id", joins.decode("risk_band", fx.DTI_RISK_EDA | PRIORITY_RISK, "Unknown").alias("tier"))


@register("j09_what_if_grid", dbl=["value", "monthly_payment"], sql=f"""
WITH g AS (SELECT a.application_id, a.loan_amount, a.loan_term, round(3e0 + i * 0.5e0, 10) AS value
           FROM applications a, range(0, 9) t(i))
SELECT application_id, value, {PAY_SQL.replace('interest_rate', 'value')} AS monthly_payment FROM g""")
def what_if(spark, d):
    base = applications(spark, d).select("application_id", "loan_amount", "loan_term")
    g = joins.what_if_grid(base, "interest_rate", 3.0, 7.0, 0.5)
    return g.select("application_id", "value",
                    fx.monthly_payment("loan_amount", "interest_rate", "loan_term").alias("monthly_payment"))


@register("f19_explanation_block", sql="""
WITH v AS (SELECT *, floor((score - 0.5e0) * 100e0) / 100e0 AS v FROM predictions)
SELECT application_id, model, concat_ws(chr(10),
  '📋 LOAN DECISION: ' || CASE WHEN score >= 0.5 THEN 'APPROVED' ELSE 'DENIED' END,
  printf('   Approval Probability: %.1f%%', round(score * 1000e0) / 10e0),
  printf('   Confidence Level: %.0f%%', round(abs(score - 0.5e0) * 200e0)), '',
  CASE WHEN score >= 0.5 THEN '✅ FACTORS SUPPORTING APPROVAL:' ELSE '⚠️ RISK FACTORS / CONCERNS:' END,
  printf(CASE WHEN score >= 0.5 THEN '   • Model Score (impact: +%.3f)' ELSE '   • Model Score (impact: -%.3f)' END, round(abs(v) * 1000e0) / 1000e0), '',
  '💡 RECOMMENDATION: ' || CASE WHEN score * 100e0 >= 75 THEN 'Strong candidate for approval'
    WHEN score * 100e0 >= 50 THEN 'Review required - borderline case'
    WHEN score * 100e0 >= 25 THEN 'High risk - consider additional documentation'
    ELSE 'Likely denial - significant risk factors present' END) AS text
FROM v""")
def explanation_block(spark, d):
    p = predictions(spark, d)
    fac = F.array(F.struct(F.lit("model_score").alias("feature"), (F.floor((F.col("score") - 0.5) * 100.0) / 100.0).alias("value")))
    empty = F.array().cast("array<struct<feature:string,value:double>>")
    p = p.withColumn("top_positive", F.when(F.col("score") >= 0.5, fac).otherwise(empty)) \
         .withColumn("top_negative", F.when(F.col("score") < 0.5, fac).otherwise(empty))
    return p.select("application_id", "model", fx.explanation_block("score").alias("text"))
