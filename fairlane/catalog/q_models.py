"""Model queries (M12-M20, M24) on the learnable ``label_signal``.

All kinds are trained at the operators' reference settings; boosted trees and
the network stop early on the validation rows. Training queries are checked by
rows (and by the AUC they reach: the true score has 0.91); the vote and the
example cases work on the fixed-formula predictions and have SQL oracles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.catalog.q_fit import SPLIT_SQL
from fairlane.functions import features as fx
from fairlane.operators import encode, metrics, models
from fairlane.operators import split as sp
from fairlane.session import checkpoint_dir, written
from fairlane.sources.tables import applications, predictions

FEATURES = ["loan_amount", "income", "property_value", "interest_rate", "loan_term", "has_coborrower",
            "loan_to_income_ratio", "loan_to_value_ratio", "loan_costs_ratio"]
INPUTS = ["loan_amount", "income", "property_value", "interest_rate", "total_loan_costs", "loan_term", "has_coborrower"]


def model_table(spark, d):
    """Applications → imputed inputs (fit on train) → ratio features, with ``label`` and ``split``.

    The inputs are written once: the imputer's fit and every pass of a caller read them, no one joins and groups the tables again.
    """
    a = sp.split(applications(spark, d)).withColumn("label", F.col("label_signal").cast("double"))
    a = written(a.select("application_id", "split", "label", *INPUTS), "model-inputs")
    imp = encode.fit_median_imputer(a.where("split = 'train'"), ["income", "property_value", "interest_rate"])
    t = fx.ratio_features(imp.transform(a))
    return t.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES})


STOPPED = ("gbt", "mlp")        # kinds that look at the validation rows


def _fit_and_score(t, kinds: dict):
    """Fit each kind on the model table and score the test rows with all of them in one pass."""
    t = t.select("application_id", "split", "label", *FEATURES, (F.col("split") == "validation").alias("held"))
    tr = t.where("split <> 'test'")
    fitted = {name: models.train(tr if kind in STOPPED else tr.where("NOT held"), FEATURES, kind, weight="balanced",
                                 validation="held" if kind in STOPPED else None, **params) for name, (kind, params) in kinds.items()}
    return fitted, models.score_batch(fitted, t.where("split = 'test'"))


@register("m12_m13_linear_models")
def linear_models(spark, d):
    _, p = _fit_and_score(model_table(spark, d), {"logistic": ("logistic", {}), "sparse_logistic": ("sparse_logistic", {})})
    return metrics.model_comparison(p)


@register("m13_sparse_weights", ctes=SPLIT_SQL, sql="""
SELECT 'sparse_logistic' AS model, 9 AS weights, true AS some_zero, true AS some_kept, count(*) AS rows FROM sa WHERE split = 'test'""")
def sparse_weights(spark, d):
    """Non-zero weights of the sparse fit: the strong penalty leaves some features out, not all."""
    fitted, p = _fit_and_score(model_table(spark, d), {"sparse_logistic": ("sparse_logistic", {"regParam": 0.05})})
    kept = models.nonzero_weights(fitted["sparse_logistic"])
    return p.agg(F.lit("sparse_logistic").alias("model"), F.lit(len(FEATURES)).alias("weights"), F.lit(kept < len(FEATURES)).alias("some_zero"),
                 F.lit(kept > 0).alias("some_kept"), F.count(F.lit(1)).alias("rows"))


@register("m14_m15_m17_tree_models")
def tree_models(spark, d):
    _, p = _fit_and_score(model_table(spark, d), {"gbt": ("gbt", {}), "forest": ("forest", {}), "tree": ("tree", {})})
    return metrics.model_comparison(p)


@register("m16_mlp_model")
def mlp_model(spark, d):
    _, p = _fit_and_score(model_table(spark, d), {"mlp": ("mlp", {})})
    return metrics.model_comparison(p)


@register("m14_m16_early_stop", ctes=SPLIT_SQL, sql="""
SELECT m.model, m.most, true AS within, count(*) AS rows, count(label_signal) AS labelled
FROM sa, (VALUES ('gbt', 200), ('mlp', 4)) m(model, most) WHERE split = 'test' GROUP BY m.model, m.most""")
def early_stop(spark, d):
    """Boosting rounds chosen on the validation rows (at most 200), the network's layers of weights, and rows scored."""
    fitted, p = _fit_and_score(model_table(spark, d), {"gbt": ("gbt", {}), "mlp": ("mlp", {})})
    most, chosen = {"gbt": 200, "mlp": 4}, {m: models.rounds(f) for m, f in fitted.items()}
    return p.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.count("y_true").alias("labelled")).select(
        "model", F.when(F.col("model") == "gbt", most["gbt"]).otherwise(most["mlp"]).alias("most"),
        F.when(F.col("model") == "gbt", F.lit(1 <= chosen["gbt"] <= most["gbt"])).otherwise(F.lit(chosen["mlp"] == most["mlp"])).alias("within"), "rows", "labelled")


@register("m19_score_batch_long")
def score_batch(spark, d):
    _, p = _fit_and_score(model_table(spark, d), {"logistic": ("logistic", {}), "tree": ("tree", {}), "logistic_c05": ("logistic_c05", {})})
    return p


@register("m19_score_batch_counts", ctes=SPLIT_SQL, sql="""
SELECT m.model, count(*) AS rows, true AS in_range, count(label_signal) AS labelled
FROM sa, (VALUES ('logistic'), ('sparse_logistic'), ('forest'), ('gbt'), ('mlp'), ('tree')) m(model) WHERE split = 'test' GROUP BY m.model""")
def score_batch_counts(spark, d):
    """All kinds of model in one scoring pass."""
    _, p = _fit_and_score(model_table(spark, d), {k: (k, {}) for k in ("logistic", "sparse_logistic", "tree", "forest", "gbt", "mlp")})
    return p.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.every(F.col("score").between(0.0, 1.0)).alias("in_range"),
                                  F.count("y_true").alias("labelled"))


@register("m12_saved_model_scores_the_same", ctes=SPLIT_SQL, sql="""
SELECT count(*) AS rows, true AS same FROM sa WHERE split = 'test'""")
def saved_model(spark, d):
    t = model_table(spark, d).select("application_id", "split", "label", *FEATURES)
    m = models.train(t.where("split = 'train'"), FEATURES, "logistic", weight="balanced")
    again = models.load_model(models.save_model(m, f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"))
    p = models.score_batch({"fitted": m, "loaded": again}, t.where("split = 'test'"))
    per = p.groupBy("application_id").agg((F.max("score") == F.min("score")).alias("same"))
    return per.agg(F.count(F.lit(1)).alias("rows"), F.every("same").alias("same"))


@register("m20_model_importance")
def importance(spark, d):
    t = model_table(spark, d).where("split = 'train'")
    m = models.train(t, FEATURES, "tree", maxDepth=5)
    return models.model_importance(m, FEATURES)


@register("m18_soft_vote", dbl=["score"], sql="""
SELECT application_id, 'vote' AS model, max(y_true) AS y_true, avg(score) AS score,
       CAST(avg(score) > 0.5 AS INTEGER) AS pred FROM predictions GROUP BY application_id HAVING count(*) >= 3""")
def soft_vote(spark, d):
    return models.soft_vote(predictions(spark, d))


@register("m24_example_cases", dbl=["score"], sql="""
WITH c AS (SELECT *, CASE WHEN score >= 0.4 AND score <= 0.6 THEN 'borderline'
                          WHEN y_true = 1 AND pred = 1 THEN 'correct_approval'
                          WHEN y_true = 0 AND pred = 0 THEN 'correct_denial'
                          WHEN y_true = 0 AND pred = 1 THEN 'false_positive'
                          WHEN y_true = 1 AND pred = 0 THEN 'false_negative' END AS case_type FROM predictions)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, case_type ORDER BY application_id) AS rank
               FROM c WHERE case_type IS NOT NULL) WHERE rank <= 3""")
def example_cases(spark, d):
    return models.example_cases(predictions(spark, d), 3)


@register("m18_vote_batch", ctes=SPLIT_SQL, sql="""
SELECT count(*) AS rows, count(label_signal) AS labelled, true AS same FROM sa WHERE split = 'test'""")
def vote_batch(spark, d):
    """The vote of three fitted models row by row, equal to the vote over their long prediction table."""
    t = model_table(spark, d)
    fitted, p = _fit_and_score(t, {"logistic": ("logistic", {}), "tree": ("tree", {}), "logistic_c05": ("logistic_c05", {})})
    t = t.where("split = 'test'").select("application_id", "label", *FEATURES)
    a, b = models.vote_batch(fitted, t), models.soft_vote(p).select("application_id", F.col("score").alias("other"))
    j = a.join(b, "application_id", "left")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count("y_true").alias("labelled"), F.every(F.abs(F.col("score") - F.col("other")) < 1e-12).alias("same"))
