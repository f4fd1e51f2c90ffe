"""Statistics, decorrelation and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.catalog.q_fit import SPLIT_SQL
from fairlane.operators import stats
from fairlane.operators import split as sp
from fairlane.sources.tables import applications

CORR_COLS = ["loan_amount", "property_value", "total_loan_costs", "income", "interest_rate", "score_signal"]
MI_COLS = ["loan_amount", "income", "interest_rate", "property_value"]
PS9 = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


@register("a17_chi_square", dbl=["chi2"], sql="""
WITH c AS (SELECT grp_b, target, count(*) AS o FROM applications WHERE grp_b IS NOT NULL AND target IS NOT NULL
           GROUP BY grp_b, target),
e AS (SELECT *, sum(o) OVER (PARTITION BY grp_b) AS ra, sum(o) OVER (PARTITION BY target) AS cb, sum(o) OVER () AS n
      FROM c)
SELECT sum(o * o / (ra * cb / n)) - max(n) AS chi2, (count(DISTINCT grp_b) - 1) * (count(DISTINCT target) - 1) AS dof,
       max(n) AS n FROM e""")
def chi_square(spark, d):
    return stats.chi_square(applications(spark, d), "grp_b", "target")


@register("a18_mann_whitney", dbl=["u", "z"], sql="""
WITH c AS (SELECT income AS v, sum(CAST(grp_c = 'Female' AS BIGINT)) AS c1, count(*) AS t FROM applications
           WHERE income IS NOT NULL AND grp_c IS NOT NULL GROUP BY income),
r AS (SELECT *, sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_t FROM c),
g AS (SELECT sum(c1 * (cum_t - t + (t + 1) / 2e0)) AS r1, sum(c1) AS n1, sum(t) AS n, sum(t * t * t - t) AS ties FROM r)
SELECT r1 - n1 * (n1 + 1) / 2e0 AS u, n1, n - n1 AS n2,
       (r1 - n1 * (n1 + 1) / 2e0 - n1 * (n - n1) / 2e0)
         / sqrt(n1 * (n - n1) / 12e0 * ((n + 1) - ties / (n * (n - 1e0)))) AS z FROM g""")
def mann_whitney(spark, d):
    return stats.mann_whitney(applications(spark, d), "income", "grp_c", "Female")


@register("a19_corr_with_target", dbl=["corr"], sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(label_signal AS DOUBLE)) AS corr FROM applications"
    for c in CORR_COLS))
def corr_target(spark, d):
    return stats.corr_with_target(applications(spark, d), CORR_COLS, "label_signal")


@register("a19_corr_pairs", dbl=["corr"], sql=" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM applications"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]))
def corr_pairs(spark, d):
    return stats.corr_pairs(applications(spark, d), CORR_COLS)


@register("a20_high_corr_pairs", dbl=["corr", "rel_a", "rel_b"], sql="""
WITH p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM applications"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]) + """),
r AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS f, abs(corr({c}, CAST(label_signal AS DOUBLE))) AS rel FROM applications" for c in CORR_COLS) + """)
SELECT p.a, p.b, p.corr, ra.rel AS rel_a, rb.rel AS rel_b,
       CASE WHEN coalesce(ra.rel, 0) < coalesce(rb.rel, 0) THEN p.a ELSE p.b END AS "drop"
FROM p JOIN r ra ON p.a = ra.f JOIN r rb ON p.b = rb.f WHERE abs(p.corr) > 0.95""")
def high_corr(spark, d):
    return stats.high_corr_pairs(applications(spark, d), CORR_COLS, "label_signal", 0.95)


def _mi_sql(src: str, target: str, cols) -> str:
    edges = ", ".join(f"quantile_cont({c}, {PS9}) AS e_{c}" for c in cols)
    binned = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN {c} IS NULL THEN -1 ELSE len(list_filter(e_{c}, lambda e: e < {c})) END "
        f"AS bin, CAST({target} AS VARCHAR) AS y FROM {src}, ed WHERE {target} IS NOT NULL" for c in cols)
    return f"""
WITH ed AS (SELECT {edges} FROM {src}),
b AS ({binned}),
g AS (SELECT feature, bin, y, count(*) AS nxy FROM b GROUP BY feature, bin, y),
h AS (SELECT *, sum(nxy) OVER (PARTITION BY feature, bin) AS nx, sum(nxy) OVER (PARTITION BY feature, y) AS ny,
             sum(nxy) OVER (PARTITION BY feature) AS n FROM g)
SELECT feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mutual_information,
       sum(nxy / n * ln(nxy * n / (nx * ny))) >= 0.001 AS kept FROM h GROUP BY feature"""


@register("a41_mutual_information", dbl=["mutual_information"], sql=_mi_sql("applications", "label_signal", MI_COLS))
def mutual_information(spark, d):
    return stats.mutual_information(applications(spark, d), MI_COLS, "label_signal", 10, min_mi=0.001)


@register("m22_decorrelate", dbl=["loan_amount", "income"], sql="""
WITH g AS (SELECT grp_b, avg(loan_amount) AS gm_l, count(loan_amount) AS gn_l, avg(income) AS gm_i,
                  count(income) AS gn_i FROM applications WHERE grp_b IS NOT NULL GROUP BY grp_b),
o AS (SELECT *, sum(gm_l * gn_l) OVER () / sum(gn_l) OVER () AS om_l,
             sum(gm_i * gn_i) OVER () / sum(gn_i) OVER () AS om_i FROM g)
SELECT a.application_id, a.grp_b, coalesce(a.loan_amount - o.gm_l + o.om_l, a.loan_amount) AS loan_amount,
       coalesce(a.income - o.gm_i + o.om_i, a.income) AS income
FROM applications a LEFT JOIN o ON a.grp_b = o.grp_b""")
def decorrelate(spark, d):
    a = applications(spark, d).select("application_id", "grp_b", "loan_amount", "income")
    return stats.decorrelate(a, ["loan_amount", "income"], "grp_b")


_GROUP_MEANS = ", ".join(f"avg({c}) AS g_{c}, count({c}) AS n_{c}" for c in MI_COLS)
_ALL_MEANS = ", ".join(f"sum(g_{c} * n_{c}) OVER () / sum(n_{c}) OVER () AS o_{c}" for c in MI_COLS)
_WITHOUT_GROUP = ", ".join(f"coalesce(a.{c} - o.g_{c} + o.o_{c}, a.{c}) AS {c}" for c in MI_COLS)


@register("m23_information_reduction", dbl=["mi_before", "mi_after", "reduction_pct"], ctes=f"""
gm AS (SELECT grp_b, {_GROUP_MEANS} FROM applications WHERE grp_b IS NOT NULL GROUP BY grp_b),
om AS (SELECT *, {_ALL_MEANS} FROM gm),
dec AS (SELECT a.grp_b, {_WITHOUT_GROUP} FROM applications a LEFT JOIN om o ON a.grp_b = o.grp_b)""", sql=f"""
WITH x AS (SELECT (SELECT avg(mutual_information) FROM ({_mi_sql("applications", "grp_b", MI_COLS)})) AS mi_before,
                  (SELECT avg(mutual_information) FROM ({_mi_sql("dec", "grp_b", MI_COLS)})) AS mi_after)
SELECT *, (mi_before - mi_after) / mi_before * 100e0 AS reduction_pct FROM x""")
def information_reduction(spark, d):
    a = applications(spark, d).select("application_id", "grp_b", *MI_COLS)
    return stats.information_reduction(a, stats.decorrelate(a, MI_COLS, "grp_b"), MI_COLS, "grp_b")


_NUMERIC = ["application_id", "loan_amount", "income", "property_value", "interest_rate", "total_loan_costs", "loan_term", "target",
            "has_coborrower", "score_signal", "score_random"]
_OTHER = ["action_taken", "grp_a", "grp_b", "grp_c", "state_code", "county_code", "risk_band", "decision_ts"]
_LEAKAGE_SQL = " UNION ALL ".join(
    ["SELECT 'outcome_name' AS \"check\", 'action_taken' AS \"column\", CAST(NULL AS DOUBLE) AS value, true AS flagged",
     "SELECT 'id_name', 'application_id', NULL, true"]
    + [f"SELECT 'label_corr', '{c}', corr({c}, label_signal), abs(corr({c}, label_signal)) > 0.95 FROM applications" for c in _NUMERIC]
    + [f"SELECT 'constant', '{c}', NULL, min({c}) IS NULL OR min({c}) = max({c}) FROM applications" for c in _NUMERIC + _OTHER]
    + [f"SELECT 'null_rate_by_label', '{c}', abs(avg(CAST({c} IS NULL AS INTEGER)) FILTER (label_signal = 1) - avg(CAST({c} IS NULL AS INTEGER)) FILTER (label_signal = 0)), "
       f"abs(avg(CAST({c} IS NULL AS INTEGER)) FILTER (label_signal = 1) - avg(CAST({c} IS NULL AS INTEGER)) FILTER (label_signal = 0)) > 0.2 FROM applications"
       for c in _NUMERIC + _OTHER]
    + [f"SELECT 'split_overlap', '{x}/{y}', CAST(count(*) AS DOUBLE), count(*) > 0 FROM sa a JOIN sa b ON a.application_id = b.application_id "
       f"WHERE a.split = '{x}' AND b.split = '{y}'" for x, y in (("train", "validation"), ("train", "test"), ("validation", "test"))])


@register("a43_leakage_report", dbl=["value"], ctes=SPLIT_SQL, sql=_LEAKAGE_SQL)
def leakage(spark, d):
    a = sp.split(applications(spark, d))
    parts = {n: a.where(F.col("split") == n) for n in sp.NAMES}
    return stats.leakage_report(a.drop("split"), "label_signal", parts)


@register("x4_input_drift_psi", dbl=["psi"], ctes=SPLIT_SQL, sql=f"""
WITH ed AS (SELECT quantile_cont(loan_amount, {PS9}) AS e_l, quantile_cont(interest_rate, {PS9}) AS e_r
            FROM sa WHERE split = 'train'),
b AS (SELECT split, 'loan_amount' AS feature,
             CASE WHEN loan_amount IS NULL THEN -1 ELSE len(list_filter(e_l, lambda e: e < loan_amount)) END AS bin
      FROM sa, ed
      UNION ALL SELECT split, 'interest_rate',
             CASE WHEN interest_rate IS NULL THEN -1 ELSE len(list_filter(e_r, lambda e: e < interest_rate)) END
      FROM sa, ed),
s AS (SELECT split, feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY split, feature) AS p
      FROM b WHERE split IN ('train', 'test') GROUP BY split, feature, bin),
j AS (SELECT coalesce(x.feature, y.feature) AS feature, greatest(coalesce(x.p, 0e0), 1e-4) AS pb,
             greatest(coalesce(y.p, 0e0), 1e-4) AS pc
      FROM (SELECT * FROM s WHERE split = 'train') x FULL JOIN (SELECT * FROM s WHERE split = 'test') y
        ON x.feature = y.feature AND x.bin = y.bin)
SELECT feature, sum((pc - pb) * ln(pc / pb)) AS psi,
       CASE WHEN sum((pc - pb) * ln(pc / pb)) > 0.25 THEN 'major' WHEN sum((pc - pb) * ln(pc / pb)) > 0.1
            THEN 'moderate' ELSE 'none' END AS drift FROM j GROUP BY feature""")
def input_drift_psi(spark, d):
    a = sp.split(applications(spark, d))
    return stats.population_stability(a.where("split = 'train'"), a.where("split = 'test'"),
                                      ["loan_amount", "interest_rate"])


@register("x4_input_drift_ks", dbl=["ks"], ctes=SPLIT_SQL, sql="""
WITH v AS (SELECT interest_rate AS v, CAST(split = 'train' AS INTEGER) AS b, CAST(split = 'test' AS INTEGER) AS c
           FROM sa WHERE interest_rate IS NOT NULL AND split IN ('train', 'test')),
g AS (SELECT v, sum(b) AS nb, sum(c) AS nc FROM v GROUP BY v),
p AS (SELECT *, sum(nb) OVER w AS cb, sum(nc) OVER w AS cc, sum(nb) OVER () AS tb, sum(nc) OVER () AS tc
      FROM g WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT max(abs(cb / tb - cc / tc)) AS ks, max(tb) AS n_base, max(tc) AS n_current FROM p""")
def input_drift_ks(spark, d):
    a = sp.split(applications(spark, d))
    return stats.ks_statistic(a.where("split = 'train'"), a.where("split = 'test'"), "interest_rate")


# Four degrees of freedom: the upper tail is exp(-x / 2) (1 + x / 2).
@register("a17_chi_square_test", dbl=["chi2", "p_value"], sql="""
WITH c AS (SELECT grp_b, target, count(*) AS o FROM applications WHERE grp_b IS NOT NULL AND target IS NOT NULL GROUP BY grp_b, target),
e AS (SELECT *, sum(o) OVER (PARTITION BY grp_b) AS ra, sum(o) OVER (PARTITION BY target) AS cb, sum(o) OVER () AS n FROM c),
x AS (SELECT sum(o * o / (ra * cb / n)) - max(n) AS chi2, max(n) AS n FROM e)
SELECT chi2, CAST(4 AS BIGINT) AS dof, CAST(n AS BIGINT) AS n, exp(-chi2 / 2e0) * (1e0 + chi2 / 2e0) AS p_value FROM x""")
def chi_square_test(spark, d):
    """The statistic of a17_chi_square with its p-value."""
    return stats.chi_square_test(applications(spark, d), "grp_b", "target")


# The normal tail by Simpson's rule over 2000 steps.
@register("a18_mann_whitney_test", dbl=["u", "z", "p_value"], sql="""
WITH c AS (SELECT income AS v, sum(CAST(grp_c = 'Female' AS BIGINT)) AS c1, count(*) AS t FROM applications
           WHERE income IS NOT NULL AND grp_c IS NOT NULL GROUP BY income),
r AS (SELECT *, sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_t FROM c),
g AS (SELECT sum(c1 * (cum_t - t + (t + 1) / 2e0)) AS r1, sum(c1) AS n1, sum(t) AS n, sum(t * t * t - t) AS ties FROM r),
s AS (SELECT r1 - n1 * (n1 + 1) / 2e0 AS u, CAST(n1 AS BIGINT) AS n1, CAST(n - n1 AS BIGINT) AS n2,
             (r1 - n1 * (n1 + 1) / 2e0 - n1 * (n - n1) / 2e0) / sqrt(n1 * (n - n1) / 12e0 * ((n + 1) - ties / (n * (n - 1e0)))) AS z FROM g)
SELECT *, 1e0 - 2e0 * abs(z) / 2000 / 3 * list_sum(list_transform(range(0, 2001), lambda i:
         (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z * i / 2000) * (z * i / 2000) / 2e0) / sqrt(2e0 * pi()))) AS p_value
FROM s""")
def mann_whitney_test(spark, d):
    """The statistic of a18_mann_whitney with its two-sided p-value."""
    return stats.mann_whitney_test(applications(spark, d), "income", "grp_c", "Female")
