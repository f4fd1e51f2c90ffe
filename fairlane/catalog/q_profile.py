"""Sources, column operators and data-quality profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.operators import columns as colops
from fairlane.operators import profile as prof
from fairlane.sources import io
from fairlane.sources.tables import applications, load

# Column types of the applications view, as Spark names them.
APP_TYPES = [
    ("application_id", "bigint"), ("loan_amount", "double"), ("income", "double"),
    ("property_value", "double"), ("interest_rate", "double"), ("total_loan_costs", "double"),
    ("loan_term", "int"), ("action_taken", "string"), ("target", "int"), ("grp_a", "string"),
    ("grp_b", "string"), ("grp_c", "string"), ("state_code", "string"), ("county_code", "string"),
    ("risk_band", "string"), ("has_coborrower", "int"), ("decision_ts", "timestamp_ntz"),
    ("score_signal", "double"), ("label_signal", "int"), ("score_random", "double"),
]
APP_COLS = [c for c, _ in APP_TYPES]
NUMERIC = [c for c, t in APP_TYPES if t in ("bigint", "double", "int")]
TEXT = [c for c, t in APP_TYPES if t == "string"]


def _union(parts):
    return "\nUNION ALL ".join(parts)


# --- S: sources --------------------------------------------------------------

@register("s01_read_table_schema", dbl=["c_acctbal"], sql="""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def read_table(spark, d):
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return io.read_table(spark, f"{d}/customer.parquet", schema)


@register("s02_read_head", dbl=["o_totalprice"], sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100""")
def read_head(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return io.read_head(o, 100, "o_orderkey")


@register("s03_row_count", sql="SELECT count(*) AS rows FROM lineitem")
def row_count(spark, d):
    return io.row_count(load(spark, d, "lineitem"))


@register("s05_summary_json", sql="""
SELECT to_json(struct_pack(rows := count(*), approved := count_if(target = 1), denied := count_if(target = 0),
                           excluded := count_if(target IS NULL))) AS summary FROM applications""")
def summary_json(spark, d):
    b = prof.class_balance(applications(spark, d)).select("rows", "approved", "denied", "excluded")
    return io.summary_json(b)


@register("s06_latest_run_per_customer", dbl=["o_totalprice"], sql="""
SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS run_date FROM orders o
WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def latest_run(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return io.latest_run(o, "o_orderdate", key="o_custkey").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("run_date"))


@register("s06_latest_run_overall", dbl=["o_totalprice"], sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""")
def latest_run_overall(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return io.latest_run(o, "o_orderdate").drop("o_orderdate")


_S7_FILL = [c for c in APP_COLS if c not in ("application_id", "grp_b", "target")]


@register("s07_prepare_batch", dbl=[c for c, t in APP_TYPES if t == "double"], sql=f"""
SELECT application_id, {", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER wf, first_value({c} IGNORE NULLS) OVER wb) AS {c}"
    for c in _S7_FILL)}, grp_b, target
FROM applications
WINDOW wf AS (PARTITION BY grp_b ORDER BY application_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       wb AS (PARTITION BY grp_b ORDER BY application_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
QUALIFY target IS NOT NULL""")
def prepare_batch(spark, d):
    apps = applications(spark, d)
    messy = apps.toDF(*[f" {c.upper()} " for c in apps.columns])
    out = io.prepare_batch(messy, order_by="application_id", partition_by="grp_b")
    return out.select("application_id", *_S7_FILL, "grp_b", "target")


# --- P: columns and filters ---------------------------------------------------

@register("p01_standardize_columns", dbl=["loan_amount", "income"], sql="""
SELECT application_id, loan_amount, income, grp_a FROM applications""")
def standardize(spark, d):
    a = applications(spark, d).select("application_id", "loan_amount", "income", "grp_a")
    messy = a.toDF(" Application ID", "LOAN AMOUNT ", "Income", " grp_A ")
    return colops.standardize_columns(messy).withColumnRenamed("application_id", "application_id")


@register("p03_coerce_numeric", dbl=["county_code", "state_code"], sql="""
SELECT application_id, TRY_CAST(county_code AS DOUBLE) AS county_code, TRY_CAST(state_code AS DOUBLE) AS state_code
FROM applications""")
def coerce(spark, d):
    a = applications(spark, d).select("application_id", "county_code", "state_code")
    return colops.coerce_numeric(a, ["county_code", "state_code"])


@register("p04_numeric_like_columns", dbl=["parse_share"], sql=_union([
    f"SELECT '{c}' AS \"column\", avg(CAST(TRY_CAST(replace({c}, ',', '') AS DOUBLE) IS NOT NULL AS DOUBLE)) "
    f"AS parse_share, avg(CAST(TRY_CAST(replace({c}, ',', '') AS DOUBLE) IS NOT NULL AS DOUBLE)) >= 1.0 "
    f"AS numeric_like FROM applications WHERE {c} IS NOT NULL" for c in TEXT]))
def numeric_like(spark, d):
    return colops.numeric_like_columns(applications(spark, d))


@register("p05_derive_label", sql="""
SELECT application_id, CASE lower(action_taken)
  WHEN 'loan originated' THEN 1 WHEN 'application approved but not accepted' THEN 1
  WHEN 'purchased loan' THEN 1 WHEN 'application denied' THEN 0 END AS label FROM applications""")
def derive_label(spark, d):
    a = applications(spark, d).select("application_id", "action_taken")
    return colops.derive_label(a, "action_taken", "label").drop("action_taken")


@register("p06_keep_labelled", dbl=["loan_amount"], sql="""
SELECT application_id, loan_amount, target FROM applications WHERE target IS NOT NULL""")
def keep_labelled(spark, d):
    a = applications(spark, d).select("application_id", "loan_amount", "target")
    return colops.keep_labelled(a)


@register("p07_filter_equals", sql="""
SELECT application_id, grp_c, loan_term FROM applications WHERE grp_c = 'Female' AND loan_term = 360""")
def filter_equals(spark, d):
    a = applications(spark, d).select("application_id", "grp_c", "loan_term")
    return colops.filter_equals(a, {"grp_c": "Female", "loan_term": 360, "absent_column": 1})


@register("p08_filter_in_exclude", sql="""
SELECT application_id, grp_a, grp_b FROM applications
WHERE grp_a IN ('BUILDING', 'MACHINERY') AND grp_b IS NOT NULL AND grp_b NOT IN ('AFRICA')""")
def filter_in(spark, d):
    a = applications(spark, d).select("application_id", "grp_a", "grp_b")
    return colops.exclude_values(colops.filter_in(a, "grp_a", ["BUILDING", "MACHINERY"]), ["grp_b"], ["AFRICA"])


@register("p09_clip_outlier_rows", dbl=["loan_amount", "income", "property_value"], sql="""
SELECT application_id, loan_amount, income, property_value FROM applications
WHERE loan_amount > 0 AND loan_amount <= 3000000 AND income > 0 AND income <= 500000
  AND property_value > 0 AND property_value <= 5000000""")
def clip(spark, d):
    a = applications(spark, d).select("application_id", "loan_amount", "income", "property_value")
    return colops.clip_outlier_rows(a)


@register("p09_outlier_funnel", dbl=["retained_pct"], sql="""
WITH c AS (SELECT count(*) AS s0,
  count_if(loan_amount > 0 AND loan_amount <= 3000000) AS s1,
  count_if(loan_amount > 0 AND loan_amount <= 3000000 AND income > 0 AND income <= 500000) AS s2,
  count_if(loan_amount > 0 AND loan_amount <= 3000000 AND income > 0 AND income <= 500000
           AND property_value > 0 AND property_value <= 5000000) AS s3 FROM applications)
SELECT 1 AS step_no, 'loan_amount' AS step, s0 AS rows_before, s1 AS rows_after, s0 - s1 AS removed,
       s1 * 100e0 / s0 AS retained_pct FROM c
UNION ALL SELECT 2, 'income', s1, s2, s1 - s2, s2 * 100e0 / s1 FROM c
UNION ALL SELECT 3, 'property_value', s2, s3, s2 - s3, s3 * 100e0 / s2 FROM c""")
def outlier_funnel(spark, d):
    return colops.outlier_funnel(applications(spark, d))


@register("p10_drop_null_rows", sql="""
SELECT application_id FROM applications WHERE income IS NOT NULL AND property_value IS NOT NULL""")
def drop_null_rows(spark, d):
    a = applications(spark, d).select("application_id", "income", "property_value")
    return colops.drop_null_rows(a, ["income", "property_value", "absent"]).select("application_id")


@register("p11_sparse_column_plan", dbl=["null_share"], sql=_union([
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
    f"(count(*) - count({c})) / count(*) AS null_share, "
    f"(count(*) - count({c})) / count(*) > 0.3 AND '{c}' NOT IN ('income') AS dropped FROM applications"
    for c in APP_COLS]))
def sparse_plan(spark, d):
    return colops.sparse_column_plan(applications(spark, d), 0.3, keep=["income"])


@register("p13_wide_categories", sql=_union([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) > 50 AS dropped "
    f"FROM applications" for c in TEXT]))
def wide_categories(spark, d):
    return colops.wide_category_counts(applications(spark, d))


@register("p13_wide_category_plan", sql=_union([
    f"SELECT '{c}' AS \"column\", least(count(DISTINCT {c}), 51) AS n_distinct, count(DISTINCT {c}) > 50 AS dropped "
    f"FROM applications" for c in TEXT]))
def wide_category_plan(spark, d):
    return colops.wide_category_plan(applications(spark, d))


@register("p13_drop_wide_categories", sql="""
SELECT application_id, action_taken, grp_a, grp_b, grp_c, state_code, risk_band FROM applications""")
def drop_wide_categories(spark, d):
    """Of the text columns, only the county has more than 50 labels."""
    a = applications(spark, d).select("application_id", "action_taken", "grp_a", "grp_b", "grp_c", "state_code", "county_code", "risk_band")
    return colops.drop_wide_categories(a)


@register("p14_align_schema", dbl=["loan_amount"], sql="""
SELECT application_id, loan_amount, 0 AS has_fha_flag, grp_a FROM applications""")
def align(spark, d):
    a = applications(spark, d)
    return colops.align_schema(a, ["application_id", "loan_amount", "has_fha_flag", "grp_a"])


@register("p16_drop_columns", dbl=["loan_amount", "income"], sql="""
SELECT application_id, loan_amount, income FROM applications""")
def drop_columns(spark, d):
    a = applications(spark, d).select("application_id", "loan_amount", "income", "score_signal", "label_signal")
    return colops.drop_columns(a, ["score_signal", "label_signal", "not_there"])


@register("p17_funnel", dbl=["retained_pct"], sql="""
WITH c AS (SELECT count(*) AS s0, count_if(target IS NOT NULL) AS s1,
                  count_if(target IS NOT NULL AND income IS NOT NULL) AS s2,
                  count_if(target IS NOT NULL AND income IS NOT NULL AND loan_term = 360) AS s3 FROM applications)
SELECT 1 AS step_no, 'labelled' AS step, s0 AS rows_before, s1 AS rows_after, s0 - s1 AS removed,
       s1 * 100e0 / s0 AS retained_pct FROM c
UNION ALL SELECT 2, 'income known', s1, s2, s1 - s2, s2 * 100e0 / s1 FROM c
UNION ALL SELECT 3, 'thirty years', s2, s3, s2 - s3, s3 * 100e0 / s2 FROM c""")
def funnel(spark, d):
    return colops.funnel(applications(spark, d), [
        ("labelled", F.col("target").isNotNull()), ("income known", F.col("income").isNotNull()),
        ("thirty years", F.col("loan_term") == 360)])


@register("p18_plot_domain_filters", dbl=["loan_amount", "income"], sql="""
SELECT application_id, loan_amount, income FROM applications
WHERE income < 500000 AND loan_amount < (SELECT quantile_cont(loan_amount, 0.99) FROM applications)""")
def domain_filters(spark, d):
    a = applications(spark, d).select("application_id", "loan_amount", "income")
    return colops.plot_domain_filters(a)


# --- A: profiles ---------------------------------------------------------------

@register("a05_null_profile", dbl=["null_pct"], sql=_union([
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS null_count, "
    f"(count(*) - count({c})) / count(*) * 100e0 AS null_pct, count(DISTINCT {c}) AS n_distinct, "
    f"(count(*) - count({c})) / count(*) * 100e0 > 40e0 AS over_limit FROM applications" for c, t in APP_TYPES]))
def null_profile(spark, d):
    return prof.null_profile(applications(spark, d))


_KEY = ["income", "property_value", "interest_rate", "loan_term", "target"]


@register("a06_completeness", dbl=["complete_pct"], sql=_union([
    f"SELECT '{c}' AS \"column\", count({c}) AS complete, count(*) - count({c}) AS missing, "
    f"count({c}) / count(*) * 100e0 AS complete_pct FROM applications" for c in _KEY]))
def completeness(spark, d):
    return prof.completeness(applications(spark, d), _KEY + ["absent"])


@register("a07_cardinality_classes", sql=_union([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct, "
    f"CASE WHEN count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 50 THEN 'high' "
    f"WHEN count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 10 THEN 'medium' ELSE 'low' END "
    f"AS cardinality FROM applications" for c in TEXT + ["target"]]))
def cardinality(spark, d):
    return prof.cardinality_classes(applications(spark, d), TEXT + ["target"])


_DESC = ["loan_amount", "income", "property_value", "interest_rate"]


@register("a08_describe_numeric_by_target", dbl=["mean", "std", "min", "p25", "p50", "p75", "max"], sql=_union([
    f"SELECT target, '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM applications WHERE target IS NOT NULL GROUP BY target"
    for c in _DESC]))
def describe_numeric(spark, d):
    return prof.describe_numeric(applications(spark, d), _DESC, by="target")


_DTEXT = ["grp_a", "grp_b", "state_code", "risk_band", "county_code"]


@register("a08_describe_text", sql=_union([f"""
SELECT '{c}' AS "column", sum(f) AS count, count(*) AS "unique", min(v) FILTER (WHERE f = mf) AS top, max(mf) AS freq
FROM (SELECT {c} AS v, count(*) AS f, max(count(*)) OVER () AS mf FROM applications WHERE {c} IS NOT NULL GROUP BY {c})"""
    for c in _DTEXT]).replace("sum(f) AS count", "CAST(sum(f) AS BIGINT) AS count"))
def describe_text(spark, d):
    return prof.describe_text(applications(spark, d), _DTEXT)


_DUP = ["grp_a", "grp_b", "grp_c", "loan_term", "has_coborrower"]


@register("a09_duplicate_rows", dbl=["duplicate_pct"], sql=f"""
SELECT CAST(sum(k) AS BIGINT) AS rows, CAST(sum(k - 1) AS BIGINT) AS duplicates,
       sum(k - 1) / sum(k) * 100e0 AS duplicate_pct
FROM (SELECT count(*) AS k FROM applications GROUP BY {", ".join(_DUP)})""")
def duplicates(spark, d):
    return prof.duplicate_rows(applications(spark, d).select(*_DUP))


@register("a09_duplicate_rows_all_columns", dbl=["duplicate_pct"], sql="""
SELECT CAST(sum(k) AS BIGINT) AS rows, CAST(sum(k - 1) AS BIGINT) AS duplicates, sum(k - 1) / sum(k) * 100e0 AS duplicate_pct
FROM (SELECT count(*) AS k FROM applications GROUP BY applications)""")
def duplicates_all(spark, d):
    return prof.duplicate_rows(applications(spark, d))


@register("a13_range_check", dbl=["min", "max"], sql=_union([
    f"SELECT '{c}' AS \"column\", {lo}e0 AS min, {hi}e0 AS max, count_if({c} < {lo}) AS below_min, "
    f"count_if({c} > {hi}) AS above_max, count_if({c} < {lo}) > 0 OR count_if({c} > {hi}) > 0 AS at_fault "
    f"FROM applications" for c, (lo, hi) in
    {"income": (0, 100000), "loan_amount": (0, 100000000), "property_value": (0, 200000000),
     "interest_rate": (1, 20), "loan_term": (0, 480)}.items()]))
def range_check(spark, d):
    rules = dict(colops.RANGE_RULES)
    rules["income"] = (0.0, 100_000.0)
    rules["interest_rate"] = (1.0, 20.0)
    return prof.range_check(applications(spark, d), rules)


@register("a14_class_balance", dbl=["approved_pct", "denied_pct", "excluded_pct", "approval_rate_pct",
                                    "imbalance_ratio"], sql="""
WITH c AS (SELECT count(*) AS rows, count_if(target = 1) AS approved, count_if(target = 0) AS denied,
                  count_if(target IS NULL) AS excluded FROM applications)
SELECT rows, approved, denied, excluded, approved / rows * 100e0 AS approved_pct, denied / rows * 100e0 AS denied_pct,
       excluded / rows * 100e0 AS excluded_pct, approved * 100e0 / nullif(approved + denied, 0) AS approval_rate_pct,
       approved / nullif(denied, 0) AS imbalance_ratio,
       CASE WHEN denied = 0 THEN 'undefined' WHEN approved / denied > 2 THEN 'imbalanced'
            WHEN approved / denied < 0.5 THEN 'reverse imbalance' ELSE 'acceptable' END AS verdict FROM c""")
def class_balance(spark, d):
    return prof.class_balance(applications(spark, d))


@register("a15_quality_report", sql=f"""
SELECT (SELECT count(*) FROM applications) AS rows, {len(APP_COLS)} AS columns,
  (SELECT count(*) FROM ({_union([f"SELECT count(*) - count({c}) AS nc, count(*) AS n FROM applications" for c in APP_COLS])})
   WHERE nc / n * 100e0 > 40e0) AS sparse_columns,
  (SELECT CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM applications GROUP BY ALL_COLS)) AS duplicates,
  (SELECT count(*) FROM ({_union([f"SELECT count_if({c} < {lo} OR {c} > {hi}) AS bad FROM applications"
                                  for c, (lo, hi) in colops.RANGE_RULES.items()])}) WHERE bad > 0) AS faulty_columns
""".replace("ALL_COLS", ", ".join(APP_COLS)))
def quality_report(spark, d):
    return prof.quality_report(applications(spark, d))


@register("a40_constant_columns", sql=_union([
    f"SELECT '{c}' AS \"column\", min({c}) IS NULL OR min({c}) = max({c}) AS is_constant FROM applications"
    for c in APP_COLS]))
def constant_columns(spark, d):
    return prof.constant_columns(applications(spark, d))


@register("a42_nonfinite_profile", sql=_union([
    f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS nulls, count_if(isnan(CAST({c} AS DOUBLE))) AS nans, "
    f"count_if(isinf(CAST({c} AS DOUBLE))) AS infinites FROM applications" for c in NUMERIC]))
def nonfinite(spark, d):
    return prof.nonfinite_profile(applications(spark, d), NUMERIC)
