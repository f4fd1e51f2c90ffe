"""Segment analysis queries over the ``applications`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.operators import segment as seg
from fairlane.sources.tables import applications


@register("a01_rate_by_segment", dbl=["rate", "rate_pct"], sql="""
SELECT grp_a, count(target) AS n, CAST(sum(target) AS BIGINT) AS approved,
       count(target) - CAST(sum(target) AS BIGINT) AS denied,
       avg(target) AS rate, avg(target) * 100e0 AS rate_pct
FROM applications WHERE grp_a IS NOT NULL GROUP BY grp_a""")
def rate_by_segment(spark, d):
    return seg.rate_by(applications(spark, d), "grp_a")


@register("a01_rate_by_two_keys", dbl=["rate", "rate_pct"], sql="""
SELECT grp_b, grp_c, count(target) AS n, CAST(sum(target) AS BIGINT) AS approved,
       count(target) - CAST(sum(target) AS BIGINT) AS denied,
       avg(target) AS rate, avg(target) * 100e0 AS rate_pct
FROM applications WHERE grp_b IS NOT NULL AND grp_c IS NOT NULL GROUP BY grp_b, grp_c""")
def rate_by_two_keys(spark, d):
    return seg.rate_by(applications(spark, d), ["grp_b", "grp_c"])


@register("a03_min_group_county", dbl=["rate", "rate_pct"], sql="""
SELECT county_code, count(target) AS n, CAST(sum(target) AS BIGINT) AS approved,
       count(target) - CAST(sum(target) AS BIGINT) AS denied,
       avg(target) AS rate, avg(target) * 100e0 AS rate_pct
FROM applications WHERE county_code IS NOT NULL GROUP BY county_code HAVING count(target) >= 8""")
def min_group_county(spark, d):
    return seg.rate_by(applications(spark, d), "county_code", min_count=8)


@register("a02_flag_rate_gap_state", dbl=["rate_pct", "overall_pct", "diff_pct"], sql="""
WITH g AS (SELECT state_code, count(target) AS n, CAST(sum(target) AS BIGINT) AS approved
           FROM applications GROUP BY state_code),
     t AS (SELECT sum(n) AS tn, sum(approved) AS ta FROM g)
SELECT state_code, n, approved / n * 100e0 AS rate_pct, ta / tn * 100e0 AS overall_pct,
       approved / n * 100e0 - ta / tn * 100e0 AS diff_pct
FROM g, t WHERE state_code IS NOT NULL AND n > 0
  AND abs(approved / n * 100e0 - ta / tn * 100e0) > 3e0""")
def flag_rate_gap_state(spark, d):
    return seg.flag_rate_gap(applications(spark, d), "state_code", points=3.0)


@register("a04_segment_profile", dbl=["approval_rate", "median_income", "median_amount", "market_share_pct"],
          sql="""
SELECT grp_b, count(target) AS applications, CAST(sum(target) AS BIGINT) AS approved,
       avg(target) AS approval_rate, quantile_cont(income, 0.5) AS median_income,
       quantile_cont(loan_amount, 0.5) AS median_amount,
       count(target) / sum(count(target)) OVER () * 100e0 AS market_share_pct
FROM applications WHERE grp_b IS NOT NULL GROUP BY grp_b""")
def segment_profile(spark, d):
    return seg.segment_profile(applications(spark, d), "grp_b")


@register("a27_disparate_impact_overall", dbl=["rate", "overall_rate", "impact_ratio"], sql="""
WITH g AS (SELECT grp_a, count(target) AS n, sum(target) AS s FROM applications GROUP BY grp_a),
     t AS (SELECT sum(n) AS tn, sum(s) AS ts FROM g)
SELECT grp_a, n, s / n AS rate, ts / tn AS overall_rate,
       CASE WHEN ts / tn > 0 THEN (s / n) / (ts / tn) ELSE 0e0 END AS impact_ratio,
       (CASE WHEN ts / tn > 0 THEN (s / n) / (ts / tn) ELSE 0e0 END) >= 0.8 AS passes
FROM g, t WHERE grp_a IS NOT NULL""")
def disparate_impact_overall(spark, d):
    return seg.disparate_impact_overall(applications(spark, d), "grp_a")


@register("a10_value_counts_action", dbl=["share"], sql="""
SELECT action_taken, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
FROM applications WHERE action_taken IS NOT NULL GROUP BY action_taken""")
def value_counts_action(spark, d):
    return seg.value_counts(applications(spark, d), "action_taken")


@register("a10_value_counts_target_keep_null", dbl=["share"], sql="""
SELECT target, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
FROM applications GROUP BY target""")
def value_counts_target(spark, d):
    return seg.value_counts(applications(spark, d), "target", dropna=False)


@register("a11_median_income_by_target", dbl=["median", "gap"], sql="""
WITH g AS (SELECT target, quantile_cont(income, 0.5) AS median FROM applications
           WHERE target IS NOT NULL GROUP BY target)
SELECT target, median, max(median) OVER () - min(median) OVER () AS gap FROM g""")
def median_income_by_target(spark, d):
    return seg.median_by(applications(spark, d), "income", "target")


@register("a12_quantiles_amount", dbl=["p", "value"], sql="""
SELECT unnest([0.25e0, 0.33e0, 0.67e0, 0.75e0, 0.99e0]) AS p,
       unnest(quantile_cont(loan_amount, [0.25, 0.33, 0.67, 0.75, 0.99])) AS value
FROM applications""")
def quantiles_amount(spark, d):
    return seg.quantile_table(applications(spark, d), "loan_amount")


@register("a16_rate_grid", dbl=["rate_Female", "rate_Male"], sql="""
SELECT grp_a,
       avg(target) FILTER (WHERE grp_c = 'Female') AS rate_Female,
       CAST(count(target) FILTER (WHERE grp_c = 'Female') AS BIGINT) AS n_Female,
       avg(target) FILTER (WHERE grp_c = 'Male') AS rate_Male,
       CAST(count(target) FILTER (WHERE grp_c = 'Male') AS BIGINT) AS n_Male
FROM applications WHERE grp_a IS NOT NULL AND grp_c IS NOT NULL GROUP BY grp_a""")
def rate_grid(spark, d):
    return seg.rate_grid(applications(spark, d), "grp_a", "grp_c", ["Female", "Male"])


@register("a44_histogram_rate_by_target", dbl=["bin_lo", "bin_hi"], sql="""
WITH r AS (SELECT min(interest_rate) AS lo, max(interest_rate) AS hi FROM applications),
     b AS (SELECT target, CAST(coalesce(least(floor((interest_rate - lo) / ((hi - lo) / 40e0)), 39), 0) AS INTEGER) AS bin,
                  lo, hi
           FROM applications, r
           WHERE interest_rate IS NOT NULL AND interest_rate >= lo AND interest_rate <= hi AND target IS NOT NULL)
SELECT target, bin, lo + bin * ((hi - lo) / 40e0) AS bin_lo, lo + (bin + 1) * ((hi - lo) / 40e0) AS bin_hi,
       count(*) AS count
FROM b GROUP BY target, bin, lo, hi""")
def histogram_rate(spark, d):
    return seg.histogram(applications(spark, d), "interest_rate", 40, by="target")


@register("a47_intersectional_rates", dbl=["rate", "gap"], sql="""
WITH c AS (SELECT grp_b, grp_c, CAST(grouping(grp_b, grp_c) AS INTEGER) AS level,
                  count(target) AS n, avg(target) AS rate
           FROM applications WHERE grp_b IS NOT NULL AND grp_c IS NOT NULL
           GROUP BY CUBE (grp_b, grp_c))
SELECT grp_b, grp_c, level, n, rate, rate - max(CASE WHEN level = 3 THEN rate END) OVER () AS gap
FROM c WHERE n >= 20""")
def intersectional(spark, d):
    return seg.intersectional_rates(applications(spark, d), ["grp_b", "grp_c"], min_count=20)


@register("a48_proxy_correlation", dbl=["eta"], sql="""
WITH long AS (
  SELECT grp_a, 'loan_amount' AS feature, CAST(loan_amount AS DOUBLE) AS value FROM applications
  UNION ALL SELECT grp_a, 'income', CAST(income AS DOUBLE) FROM applications
  UNION ALL SELECT grp_a, 'interest_rate', CAST(interest_rate AS DOUBLE) FROM applications),
g AS (SELECT feature, grp_a, count(value) AS n, avg(value) AS m, var_pop(value) AS v
      FROM long WHERE grp_a IS NOT NULL AND value IS NOT NULL GROUP BY feature, grp_a),
g2 AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS mean FROM g),
o AS (SELECT feature, sum(n * (m - mean) ^ 2) AS ssb, sum(n * v) AS ssw FROM g2 GROUP BY feature)
SELECT feature, sqrt(ssb / (ssb + ssw)) AS eta, sqrt(ssb / (ssb + ssw)) > 0.5 AS alarm FROM o""")
def proxy_corr(spark, d):
    return seg.proxy_correlation(applications(spark, d), ["loan_amount", "income", "interest_rate"], "grp_a")
