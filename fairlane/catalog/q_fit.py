"""Fit / transform queries (M1-M7, M9-M11, J7): fit on the training split,
apply to every row."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.operators import encode, joins
from fairlane.operators import split as sp
from fairlane.session import checkpoint_dir
from fairlane.sources.tables import applications, hash_bucket_sql

SPLIT_SQL = f"""
sa AS (SELECT *, CASE WHEN {hash_bucket_sql('split', 'application_id', 1 << 30)} < {round(0.70 * (1 << 30))} THEN 'train'
                      WHEN {hash_bucket_sql('split', 'application_id', 1 << 30)} < {round(0.85 * (1 << 30))} THEN 'validation'
                      ELSE 'test' END AS split FROM applications)"""


def _split_apps(spark, d):
    return sp.split(applications(spark, d))


@register("m07_split_shares", dbl=["label_rate", "share"], ctes=SPLIT_SQL, sql="""
SELECT split, count(*) AS rows, avg(target) AS label_rate, count(*) / sum(count(*)) OVER () AS share
FROM sa GROUP BY split""")
def split_shares(spark, d):
    return sp.split_shares(_split_apps(spark, d), label="target")


_E = hash_bucket_sql('split', 'application_id', 1 << 30)


@register("m07_split_uneven_shares", dbl=["share"], sql=f"""
SELECT split, count(*) AS rows, count(*) / sum(count(*)) OVER () AS share
FROM (SELECT CASE WHEN {_E} < {round(0.5 * (1 << 30))} THEN 'part_1' WHEN {_E} < {round(0.75 * (1 << 30))} THEN 'part_2'
                  WHEN {_E} < {round(0.875 * (1 << 30))} THEN 'part_3' ELSE 'part_4' END AS split FROM applications)
GROUP BY split""")
def split_uneven(spark, d):
    return sp.split_shares(sp.split(applications(spark, d), fractions=(0.5, 0.25, 0.125, 0.125)))


@register("m07_stratified_split_shares", sql="""
SELECT t.target, s.split, true AS share_as_asked, t.n AS rows_of_class
FROM (SELECT target, count(*) AS n FROM applications WHERE target IS NOT NULL GROUP BY target) t,
     (VALUES ('train'), ('validation'), ('test')) s(split)""")
def stratified_split(spark, d):
    """Every class is split in the asked shares, within half a percent and a row."""
    a = applications(spark, d).where(F.col("target").isNotNull())
    s = sp.split(a, stratify="target").groupBy("target", "split").agg(F.count(F.lit(1)).alias("n"))
    s = s.withColumn("rows_of_class", F.sum("n").over(Window.partitionBy("target")))
    asked = F.when(F.col("split") == "train", 0.70).otherwise(0.15)
    return s.select("target", "split", (F.abs(F.col("n") - asked * F.col("rows_of_class")) <= 1 + 0.005 * F.col("rows_of_class")).alias("share_as_asked"), "rows_of_class")


@register("j07_split_overlap", ctes=SPLIT_SQL, sql="""
SELECT l AS "left", r AS "right", (SELECT count(*) FROM sa x JOIN sa y ON x.application_id = y.application_id
                                   WHERE x.split = l AND y.split = r) AS shared
FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) v(l, r)""")
def split_overlap(spark, d):
    s = _split_apps(spark, d)
    parts = {n: s.where(F.col("split") == n) for n in sp.NAMES}
    return joins.split_overlap(parts)


@register("m01_median_imputer", dbl=["income", "property_value"], ctes=SPLIT_SQL, sql="""
SELECT application_id,
  coalesce(income, (SELECT quantile_cont(income, 0.5) FROM sa WHERE split = 'train')) AS income,
  coalesce(property_value, (SELECT quantile_cont(property_value, 0.5) FROM sa WHERE split = 'train')) AS property_value
FROM sa""")
def median_imputer(spark, d):
    s = _split_apps(spark, d)
    m = encode.fit_median_imputer(s.where("split = 'train'"), ["income", "property_value"])
    return m.transform(s.select("application_id", "income", "property_value"))


_OH = {"grp_b": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "grp_c": ["Female", "Male"]}


@register("m02_one_hot_drop_first", ctes=SPLIT_SQL, sql="SELECT application_id, " + ", ".join(
    f"CAST(coalesce({c} = '{lab}', false) AS INTEGER) AS \"{c}_{lab}\"" for c, labs in _OH.items() for lab in labs[1:])
    + " FROM sa")
def one_hot(spark, d):
    s = _split_apps(spark, d)
    m = encode.fit_one_hot(s.where("split = 'train'"), ["grp_b", "grp_c", "county_code"], max_labels=10)
    return m.transform(s.select("application_id", "grp_b", "grp_c", "county_code")).drop("county_code")


@register("m03_target_encode_out_of_fold", dbl=["state_code_te"], ctes=SPLIT_SQL + f""",
tr AS (SELECT *, {hash_bucket_sql('fold', 'application_id', 5)} AS fold FROM sa WHERE split = 'train'),
ft AS (SELECT fold, sum(target) AS fs, count(target) AS fc FROM tr WHERE target IS NOT NULL GROUP BY fold),
pr AS (SELECT fold, (sum(fs) OVER () - fs) / (sum(fc) OVER () - fc) AS p FROM ft),
g AS (SELECT state_code, fold, sum(target) AS s, count(target) AS c FROM tr WHERE target IS NOT NULL
      GROUP BY state_code, fold),
k AS (SELECT state_code, sum(s) AS ts, sum(c) AS tc FROM g GROUP BY state_code)""", sql="""
SELECT tr.application_id, tr.state_code,
       coalesce((k.ts - coalesce(g.s, 0) + pr.p * 10e0) / nullif(k.tc - coalesce(g.c, 0) + 10e0, 0), pr.p)
         AS state_code_te
FROM tr LEFT JOIN pr ON tr.fold = pr.fold LEFT JOIN k ON tr.state_code = k.state_code
LEFT JOIN g ON tr.state_code = g.state_code AND tr.fold = g.fold""")
def target_encode(spark, d):
    tr = _split_apps(spark, d).where("split = 'train'").select("application_id", "state_code", "target")
    return encode.target_encode_out_of_fold(tr, "state_code", folds=5, smoothing=10.0).drop("target")


@register("m03_target_encode_apply", dbl=["state_code_te"], ctes=SPLIT_SQL + """,
pr AS (SELECT avg(target) AS p FROM sa WHERE split = 'train' AND target IS NOT NULL),
e AS (SELECT state_code, (sum(target) + (SELECT p FROM pr) * 10e0) / (count(target) + 10e0) AS te
      FROM sa WHERE split = 'train' AND target IS NOT NULL GROUP BY state_code)""", sql="""
SELECT application_id, sa.state_code, coalesce(e.te, (SELECT p FROM pr)) AS state_code_te
FROM sa LEFT JOIN e ON sa.state_code = e.state_code WHERE split <> 'train'""")
def target_encode_apply(spark, d):
    s = _split_apps(spark, d)
    enc = encode.fit_target_encoder(s.where("split = 'train'"), "state_code")
    rest = s.where("split <> 'train'").select("application_id", "state_code")
    return encode.apply_target_encoder(rest, enc, "state_code")


@register("m04_frequency_encode", sql="""
SELECT application_id, a.county_code, f.n AS county_code_frequency FROM applications a
LEFT JOIN (SELECT county_code, count(*) AS n FROM applications WHERE county_code IS NOT NULL GROUP BY county_code) f
  ON a.county_code = f.county_code""")
def frequency(spark, d):
    a = applications(spark, d).select("application_id", "county_code")
    return encode.frequency_encode(a, "county_code")


@register("m05_hash_encode", sql="SELECT application_id, " + ", ".join(
    f"CASE WHEN {hash_bucket_sql('h', 'state_code', 8)} = {i} THEN "
    f"CASE WHEN {hash_bucket_sql('s', 'state_code', 2)} = 0 THEN 1 ELSE -1 END ELSE 0 END AS state_code_h{i}"
    for i in range(8)) + " FROM applications")
def hash_enc(spark, d):
    a = applications(spark, d).select("application_id", "state_code")
    return encode.hash_encode(a, "state_code", 8).drop("state_code")


HASHED = (("state_code", 16), ("risk_band", 5), ("county_code", 32))


@register("m05_hash_encode_columns", sql="SELECT application_id, " + ", ".join(
    f"CASE WHEN {hash_bucket_sql('h', c, n)} = {i} THEN CASE WHEN {hash_bucket_sql('s', c, 2)} = 0 THEN 1 ELSE -1 END ELSE 0 END AS {c}_h{i}"
    for c, n in HASHED for i in range(n)) + " FROM applications")
def hash_enc_columns(spark, d):
    """State, band and county in 16, 5 and 32 buckets."""
    a = applications(spark, d).select("application_id", *[c for c, _ in HASHED])
    for c, n in HASHED:
        a = encode.hash_encode(a, c, n)
    return a.drop(*[c for c, _ in HASHED])


@register("m06_standard_scale", dbl=["loan_amount", "interest_rate"], ctes=SPLIT_SQL + """,
st AS (SELECT avg(loan_amount) AS ma, stddev_pop(loan_amount) AS sa_, avg(interest_rate) AS mr,
              stddev_pop(interest_rate) AS sr FROM sa WHERE split = 'train')""", sql="""
SELECT application_id, (loan_amount - ma) / sa_ AS loan_amount, (interest_rate - mr) / sr AS interest_rate
FROM sa, st""")
def standard_scale(spark, d):
    s = _split_apps(spark, d)
    m = encode.fit_standard_scaler(s.where("split = 'train'"), ["loan_amount", "interest_rate"])
    return m.transform(s.select("application_id", "loan_amount", "interest_rate"))


@register("m09_class_weight", dbl=["weight"], sql="""
SELECT a.application_id, w.weight FROM applications a LEFT JOIN (
  SELECT target, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
  FROM applications WHERE target IS NOT NULL GROUP BY target) w ON a.target = w.target""")
def class_weight(spark, d):
    a = applications(spark, d).select("application_id", "target")
    return encode.class_weights(a, "target").select("application_id", "weight")


@register("m09_group_reweighing", dbl=["weight"], sql="""
WITH g AS (SELECT grp_c, target, count(*) AS nay FROM applications WHERE target IS NOT NULL AND grp_c IS NOT NULL
           GROUP BY grp_c, target),
w AS (SELECT grp_c, target, sum(nay) OVER (PARTITION BY grp_c) * sum(nay) OVER (PARTITION BY target)
                             / (sum(nay) OVER () * nay) AS weight FROM g)
SELECT a.application_id, w.weight FROM applications a LEFT JOIN w ON a.grp_c = w.grp_c AND a.target = w.target""")
def group_reweighing(spark, d):
    a = applications(spark, d).select("application_id", "grp_c", "target")
    return encode.class_weights(a, "target", group="grp_c").select("application_id", "weight")


@register("m10_quantile_one_hot", sql="""
WITH q AS (SELECT quantile_cont(interest_rate, 0.25) AS q1, quantile_cont(interest_rate, 0.5) AS q2,
                  quantile_cont(interest_rate, 0.75) AS q3 FROM applications),
b AS (SELECT application_id, CASE WHEN interest_rate IS NULL THEN NULL WHEN interest_rate <= q1 THEN 0
             WHEN interest_rate <= q2 THEN 1 WHEN interest_rate <= q3 THEN 2 ELSE 3 END AS bin FROM applications, q)
SELECT application_id, CAST(coalesce(bin = 0, false) AS INTEGER) AS interest_rate_q0,
       CAST(coalesce(bin = 1, false) AS INTEGER) AS interest_rate_q1,
       CAST(coalesce(bin = 2, false) AS INTEGER) AS interest_rate_q2,
       CAST(coalesce(bin = 3, false) AS INTEGER) AS interest_rate_q3 FROM b""")
def quantile_one_hot(spark, d):
    a = applications(spark, d).select("application_id", "interest_rate")
    m = encode.fit_quantile_one_hot(a, "interest_rate", 4)
    return m.transform(a).drop("interest_rate")


@register("m11_label_index", sql="""
SELECT a.application_id, a.state_code, i.idx AS state_code_idx FROM applications a LEFT JOIN (
  SELECT state_code, dense_rank() OVER (ORDER BY state_code) - 1 AS idx
  FROM (SELECT DISTINCT state_code FROM applications WHERE state_code IS NOT NULL)) i ON a.state_code = i.state_code""")
def label_idx(spark, d):
    a = applications(spark, d).select("application_id", "state_code")
    return encode.label_index(a, "state_code")


@register("m01_saved_fits", ctes=SPLIT_SQL, sql="""
SELECT m.fit, count(*) AS rows, true AS same FROM sa, (VALUES ('imputer'), ('one_hot'), ('scaler'), ('bins')) m(fit) WHERE split = 'test' GROUP BY m.fit""")
def saved_fits(spark, d):
    """Test rows through each fitted encoder and through what is loaded of it again."""
    t = _split_apps(spark, d).select("application_id", "split", "income", "loan_amount", "grp_b")
    train, test = t.where("split = 'train'"), t.where("split = 'test'")
    fits = {"imputer": encode.fit_median_imputer(train, ["income"]), "one_hot": encode.fit_one_hot(train, ["grp_b"]),
            "scaler": encode.fit_standard_scaler(train, ["loan_amount"]), "bins": encode.fit_quantile_one_hot(train, "loan_amount")}
    out = []
    for name, fit in fits.items():
        again = encode.load_fit(spark, encode.save_fit(spark, fit, f"{checkpoint_dir(spark).rstrip('/')}/fit-{uuid.uuid4().hex}"))
        a, b = fit.transform(test), again.transform(test)
        rows = a.unionByName(b).groupBy(*a.columns).agg(F.count(F.lit(1)).alias("k"))
        out.append(rows.agg(F.lit(name).alias("fit"), F.sum(F.col("k") / 2).cast("bigint").alias("rows"), F.every(F.col("k") % 2 == 0).alias("same")))
    return reduce(DataFrame.unionByName, out)
