"""Property and golden-table tests."""

import itertools

from pyspark.sql import functions as F

from fairlane.operators import encode, fairness, metrics
from fairlane.operators import split as sp
from fairlane.sources.tables import applications

from conftest import SMALL


def _auc_brute(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_matches_brute_force_and_reverses(spark):
    pairs = [(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1), (0.4, 0), (0.7, 1), (0.2, 0), (0.9, 0), (0.4, 1)]
    df = spark.createDataFrame([("m", s, y) for s, y in pairs], "model string, score double, y_true int")
    auc = metrics.roc_auc(df, rows_per_range=3).first()["auc"]
    assert abs(auc - _auc_brute(pairs)) < 1e-12
    rev = metrics.roc_auc(df.withColumn("score", -F.col("score")), rows_per_range=3).first()["auc"]
    assert abs(rev - (1 - auc)) < 1e-12
    const = metrics.roc_auc(df.withColumn("score", F.lit(0.5)), rows_per_range=3).first()["auc"]
    assert const == 0.5


def test_roc_curve_ends_at_one(spark):
    a = applications(spark, SMALL)
    p = a.select(F.lit("m").alias("model"), F.col("score_signal").alias("score"), F.col("label_signal").alias("y_true"))
    c = metrics.roc_curve(p, rows_per_range=200)
    last = c.orderBy("threshold").first()
    assert last["fpr"] == 1.0 and last["tpr"] == 1.0


def test_split_is_disjoint_and_near_shares(spark):
    a = sp.split(applications(spark, SMALL))
    shares = {r["split"]: r["share"] for r in sp.split_shares(a).collect()}
    assert abs(shares["train"] - 0.70) < 0.05 and abs(shares["test"] - 0.15) < 0.05
    assert a.groupBy("application_id").count().where("count > 1").count() == 0


def test_stratified_split_keeps_label_rate(spark):
    a = applications(spark, SMALL).where(F.col("target").isNotNull())
    s = sp.split(a, stratify="target")
    rates = {r["split"]: r["label_rate"] for r in sp.split_shares(s, label="target").collect()}
    overall = a.agg(F.avg("target")).first()[0]
    assert all(abs(r - overall) < 0.02 for r in rates.values())


def test_dpd_zero_when_groups_agree_and_di_at_most_one(spark):
    rows = [("m", g, y, p) for g in ("a", "b") for y, p in ((1, 1), (0, 0), (1, 0), (0, 1))]
    df = spark.createDataFrame(rows, "model string, g string, y_true int, pred int")
    ft = fairness.fairness_table(df, ["g"]).first()
    assert ft["dpd"] == 0.0 and ft["eod"] == 0.0 and ft["disparate_impact"] == 1.0
    a = applications(spark, SMALL)
    p = a.select(F.lit("m").alias("model"), "grp_a", "grp_b", F.col("label_signal").alias("y_true"),
                 (F.col("score_random") >= 0.5).cast("int").alias("pred"))
    assert all(r["disparate_impact"] <= 1.0 for r in fairness.fairness_table(p, ["grp_a", "grp_b"]).collect())


def test_golden_fairness_score(spark):
    # Typed in from the reference's stored audit of its boosted model (three attributes).
    rows = [("XGBoost", "race", 0.09962441314553994, 0.002184598580010923, 0.9003755868544601),
            ("XGBoost", "ethnicity", 0.10371776264374233, 0.0021493820526598604, 0.8962822373562577),
            ("XGBoost", "sex", 0.16494124049288017, 0.00298804780876494, 0.8294830465338489)]
    ft = spark.createDataFrame(rows, "model string, attribute string, dpd double, eod double, disparate_impact double")
    ft = ft.withColumn("accuracy", F.lit(0.9998109002498818)).withColumn("f1", F.lit(0.9999004564781503))
    got = fairness.fairness_score(ft).first()["fairness_score"]
    assert abs(got - 0.650395492352365) < 1e-9
    ft = ft.withColumn("precision", F.lit(0.99993)).withColumn("recall", F.lit(0.99987))
    rec = fairness.recommend(ft).first()
    assert abs(rec["combined_score"] - 0.8251479744152577) < 1e-9 and rec["all_criteria_met"] is False


def test_out_of_fold_encoding_ignores_own_label(spark):
    a = applications(spark, SMALL).select("application_id", "state_code", "target")
    one = a.where("target IS NOT NULL").orderBy("application_id").first()
    flipped = a.withColumn("target", F.when(F.col("application_id") == one["application_id"], 1 - F.col("target"))
                           .otherwise(F.col("target")))
    e1 = encode.target_encode_out_of_fold(a, "state_code").where(F.col("application_id") == one["application_id"])
    e2 = encode.target_encode_out_of_fold(flipped, "state_code").where(F.col("application_id") == one["application_id"])
    assert e1.first()["state_code_te"] == e2.first()["state_code_te"]


def test_pareto_front_keeps_undominated(spark):
    df = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.5, 0.5), ("c", 0.4, 0.4), ("d", 0.1, 0.9)],
                               "model string, x double, y double")
    got = sorted(r["model"] for r in fairness.pareto_front(df, ["x", "y"]).collect())
    assert got == ["a", "b", "d"]


def test_sampled_contributions_add_up_to_score_minus_base(spark):
    from fairlane.catalog.q_models import FEATURES, model_table
    from fairlane.operators import explain, models
    t = model_table(spark, SMALL)
    m = models.train(t, FEATURES, "tree", maxDepth=3)
    bg = t.orderBy("application_id").limit(10).select(*FEATURES)
    c = explain.sampled_contributions(m, t.select("application_id", *FEATURES), FEATURES, bg, n_samples=3)
    g = c.groupBy("application_id").agg(F.sum("contribution").alias("s"), F.first("score").alias("f"),
                                        F.first("base").alias("b"), F.count(F.lit(1)).alias("k"))
    bad = g.where((F.abs(F.col("s") - (F.col("f") - F.col("b"))) > 1e-9) | (F.col("k") != len(FEATURES)))
    assert bad.count() == 0


def test_group_thresholds_equalise_rates(spark):
    from fairlane.operators import explain
    p = spark.createDataFrame([("m", g, i / 100.0, 0) for g in ("a", "b") for i in range(100) if g == "a" or i % 2],
                              "model string, g string, score double, pred int")
    adj = explain.group_thresholds(p, "g", target_rate=0.3)
    rates = {r["g"]: r["r"] for r in adj.groupBy("g").agg(F.avg("pred").alias("r")).collect()}
    assert abs(rates["a"] - 0.3) <= 0.02 and abs(rates["b"] - 0.3) <= 0.03
