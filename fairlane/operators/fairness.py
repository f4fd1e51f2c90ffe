"""Group fairness audit and model choice.

The reference loops over models, attributes and groups and rescans the data
for each metric. Here predictions are one long table; the protected
attributes are unpivoted (Expand, no extra scan) and ONE grouped pass over
``(model, attribute, group)`` yields every count that DPD, EOD, DI and the
per-model scores need. Everything downstream runs on that tiny table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlane.operators._util import as_list, div0, safe_div
from fairlane.session import written

LIMITS = {"dpd": 0.05, "eod": 0.05, "di": 0.80}


_OVERALL = "__overall__"


def group_counts(preds: DataFrame, attrs: list[str], y: str = "y_true", pred: str = "pred",
                 by="model", min_group_size: int = 0, overall: bool = False) -> DataFrame:
    """Per (model, attribute, group): n, predicted positives, TP, FN, FP, TN.
    With ``overall`` one more pseudo-attribute holds every labelled row, so
    the model-level confusion counts come from the same single pass."""
    by = as_list(by)
    cols = [F.col(a).cast("string").alias(a) for a in attrs]
    names = list(attrs)
    if overall:
        cols.append(F.when(F.col(y).isNotNull() & F.col(pred).isNotNull(), F.lit("all")).alias(_OVERALL))
        names.append(_OVERALL)
    long = (preds.select(*by, y, pred, *cols)
            .unpivot([*by, y, pred], names, "attribute", "grp")
            .where(F.col("grp").isNotNull()))
    yc, pc = F.col(y), F.col(pred)
    g = long.groupBy(*by, "attribute", "grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pc == 1).alias("pos"),
        F.count_if((yc == 1) & (pc == 1)).alias("tp"),
        F.count_if((yc == 1) & (pc == 0)).alias("fn"),
        F.count_if((yc == 0) & (pc == 1)).alias("fp"),
        F.count_if((yc == 0) & (pc == 0)).alias("tn"))
    if min_group_size:
        g = g.where((F.col("n") >= min_group_size) | (F.col("attribute") == _OVERALL))
    return g.select(*by, "attribute", "grp", "n", "pos", "tp", "fn", "fp", "tn",
                    (F.col("pos") / F.col("n")).alias("rate"),
                    div0(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
                    div0(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def demographic_parity(preds: DataFrame, attrs: list[str], pred: str = "pred", y: str = "y_true",
                       by="model", min_group_size: int = 0) -> DataFrame:
    """Per group predicted-positive rate, and DPD = max − min over groups."""
    by = as_list(by)
    g = group_counts(preds, attrs, y, pred, by, min_group_size)
    w = Window.partitionBy(*by, "attribute")
    return g.select(*by, "attribute", "grp", "n", "rate",
                    (F.max("rate").over(w) - F.min("rate").over(w)).alias("dpd"))


def _attr_metrics(g: DataFrame, by: list[str], reference: dict | None = None) -> DataFrame:
    """DPD, EOD, DI per (model, attribute) from the group counts."""
    ref_rate = F.max("rate")
    if reference:
        cond = None
        for attr, grp in reference.items():
            c = (F.col("attribute") == attr) & (F.col("grp") == str(grp))
            cond = c if cond is None else cond | c
        # Given reference group if present, else the best group.
        ref_rate = F.coalesce(F.max(F.when(cond, F.col("rate"))), F.max("rate"))
    a = g.groupBy(*by, "attribute").agg(
        (F.max("rate") - F.min("rate")).alias("dpd"),
        (F.max("tpr") - F.min("tpr")).alias("tpr_diff"),
        (F.max("fpr") - F.min("fpr")).alias("fpr_diff"),
        F.min("rate").alias("_min_rate"), ref_rate.alias("ref_rate"),
        F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("min_group_n"))
    # min over groups of rate / reference rate = lowest rate / reference rate
    di = F.when(F.col("ref_rate") > 0, F.col("_min_rate") / F.col("ref_rate")).otherwise(F.lit(0.0))
    return a.select(*by, "attribute", "dpd", F.greatest("tpr_diff", "fpr_diff").alias("eod"),
                    "tpr_diff", "fpr_diff", di.alias("disparate_impact"), "n_groups", "min_group_n")


def equalized_odds(preds: DataFrame, attrs: list[str], y: str = "y_true", pred: str = "pred",
                   by="model", min_group_size: int = 0) -> DataFrame:
    """Max of the TPR spread and the FPR spread (empty denominators → 0)."""
    by = as_list(by)
    m = _attr_metrics(group_counts(preds, attrs, y, pred, by, min_group_size), by)
    return m.select(*by, "attribute", "tpr_diff", "fpr_diff", "eod")


def disparate_impact(preds: DataFrame, attrs: list[str], pred: str = "pred", y: str = "y_true",
                     by="model", reference: dict | None = None, limit: float = 0.80,
                     min_group_size: int = 0) -> DataFrame:
    """Lowest ratio of a group's rate to the reference rate (the given
    group, else the best group); passes at ``limit``."""
    by = as_list(by)
    m = _attr_metrics(group_counts(preds, attrs, y, pred, by, min_group_size), by, reference)
    return m.select(*by, "attribute", "disparate_impact",
                    (F.col("disparate_impact") >= limit).alias("passes_80"))


def fairness_table(preds: DataFrame, attrs: list[str], y: str = "y_true", pred: str = "pred",
                   by="model", limits: dict | None = None, min_group_size: int = 0,
                   reference: dict | None = None) -> DataFrame:
    """DPD, EOD, DI, pass flags and overall classification metrics for
    every model × attribute, from one grouped pass.

    ``degenerate`` marks models whose predictions are constant (the audit
    passes them trivially, SURVEY 1.2 no. 10).
    """
    by = as_list(by)
    lim = {**LIMITS, **(limits or {})}
    g = group_counts(preds, attrs, y, pred, by, min_group_size, overall=True)
    m = _attr_metrics(g.where(F.col("attribute") != _OVERALL), by, reference)
    # Model-level metrics from the pseudo-attribute of the same grouped pass
    # (every labelled prediction, including rows whose attributes are null).
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    perf = g.where(F.col("attribute") == _OVERALL).select(
        *by, div0(tp + tn, tp + fp + fn + tn).alias("accuracy"), div0(tp, tp + fp).alias("precision"),
        div0(tp, tp + fn).alias("recall"), div0(F.lit(2.0) * tp, F.lit(2) * tp + fp + fn).alias("f1"),
        ((tp + fp == 0) | (tn + fn == 0)).alias("degenerate"))
    out = m.join(perf, by, "left")
    return out.select(*by, "attribute", "dpd", (F.col("dpd") < lim["dpd"]).alias("dpd_pass"),
                      "eod", (F.col("eod") < lim["eod"]).alias("eod_pass"),
                      "disparate_impact", (F.col("disparate_impact") >= lim["di"]).alias("di_pass"),
                      "accuracy", "precision", "recall", "f1", "degenerate", "n_groups", "min_group_n")


def best_per_attribute(ft: DataFrame, model: str = "model") -> DataFrame:
    """Model with the lowest DPD, lowest EOD, highest DI per attribute
    (ties broken by model name)."""
    m = F.col(model)
    return ft.groupBy("attribute").agg(
        F.min_by(m, F.struct("dpd", model)).alias("best_dpd_model"), F.min("dpd").alias("best_dpd"),
        F.min_by(m, F.struct("eod", model)).alias("best_eod_model"), F.min("eod").alias("best_eod"),
        F.min_by(m, F.struct(-F.col("disparate_impact"), m)).alias("best_di_model"),
        F.max("disparate_impact").alias("best_di"))


def pass_counts(ft: DataFrame, key: str = "attribute", limits: dict | None = None) -> DataFrame:
    """How many rows (models) pass each limit, per attribute or per model."""
    lim = {**LIMITS, **(limits or {})}
    return ft.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_models"),
        F.count_if(F.col("dpd") < lim["dpd"]).alias("dpd_pass"),
        F.count_if(F.col("eod") < lim["eod"]).alias("eod_pass"),
        F.count_if(F.col("disparate_impact") >= lim["di"]).alias("di_pass"))


def fairness_score(ft: DataFrame, model: str = "model", dpd_limit: float = 0.05,
                   eod_limit: float = 0.05, di_limit: float = 0.80) -> DataFrame:
    """Mean of max(0, 1 − DPD/0.05), max(0, 1 − EOD/0.05), min(1, DI/0.8)
    on the attribute means; a missing mean contributes 0."""
    a = ft.groupBy(model).agg(F.avg("dpd").alias("avg_dpd"), F.avg("eod").alias("avg_eod"),
                              F.avg("disparate_impact").alias("avg_di"),
                              F.first("accuracy").alias("accuracy"), F.first("f1").alias("f1"))
    t1 = F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("avg_dpd") / dpd_limit), F.lit(0.0))
    t2 = F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("avg_eod") / eod_limit), F.lit(0.0))
    t3 = F.coalesce(F.least(F.lit(1.0), F.col("avg_di") / di_limit), F.lit(0.0))
    return a.select(model, "avg_dpd", "avg_eod", "avg_di", ((t1 + t2 + t3) / 3.0).alias("fairness_score"),
                    "accuracy", "f1")


def compliance(ft: DataFrame, model: str = "model", limits: dict | None = None,
               perf_limits: dict | None = None) -> DataFrame:
    """All fairness limits hold on every attribute, and the performance
    limits (F1 0.70, precision 0.80, recall 0.70) hold."""
    lim = {**LIMITS, **(limits or {})}
    pl = {"f1": 0.70, "precision": 0.80, "recall": 0.70, **(perf_limits or {})}
    a = ft.groupBy(model).agg(
        F.bool_and(F.col("dpd") < lim["dpd"]).alias("dpd_pass"),
        F.bool_and(F.col("eod") < lim["eod"]).alias("eod_pass"),
        F.bool_and(F.col("disparate_impact") >= lim["di"]).alias("di_pass"),
        F.first("f1").alias("f1"), F.first("precision").alias("precision"), F.first("recall").alias("recall"))
    fair = F.col("dpd_pass") & F.col("eod_pass") & F.col("di_pass")
    perf = (F.col("f1") >= pl["f1"]) & (F.col("precision") >= pl["precision"]) & (F.col("recall") >= pl["recall"])
    return a.select(model, fair.alias("fairness_pass"), perf.alias("performance_pass"),
                    (fair & perf).alias("all_criteria_met"))


def recommend(ft: DataFrame, model: str = "model", limits: dict | None = None) -> DataFrame:
    """A33 (+ J8): combined score = (fairness score + F1) / 2, ranked with
    compliant models first; ``recommended`` marks the chosen row."""
    ft = written(ft, "audit")           # read twice
    s = fairness_score(ft, model)
    c = compliance(ft, model, limits)
    j = s.join(c, model)
    combined = (F.col("fairness_score") + F.col("f1")) / 2.0
    w = Window.orderBy(F.col("all_criteria_met").desc(), F.col("combined_score").desc(), F.col(model))
    j = j.withColumn("combined_score", combined)
    return j.select(model, "fairness_pass", "performance_pass", "all_criteria_met", "fairness_score", "f1",
                    "combined_score", (F.row_number().over(w) == 1).alias("recommended"))


def validate_models(ft: DataFrame, perf: DataFrame, model: str = "model",
                    limits: dict | None = None) -> DataFrame:
    """Worst DPD / EOD, lowest DI and all-pass per model; the pick is
    the best AUC among passing models, else the lowest worst-DPD."""
    lim = {**LIMITS, **(limits or {})}
    v = ft.groupBy(model).agg(
        F.max("dpd").alias("dpd_max"), F.bool_and(F.col("dpd") < lim["dpd"]).alias("dpd_pass"),
        F.max("eod").alias("eod_max"), F.bool_and(F.col("eod") < lim["eod"]).alias("eod_pass"),
        F.min("disparate_impact").alias("di_min"),
        F.bool_and(F.col("disparate_impact") >= lim["di"]).alias("di_pass"))
    v = v.withColumn("all_criteria", F.col("dpd_pass") & F.col("eod_pass") & F.col("di_pass"))
    v = v.join(perf.select(model, "auc"), model, "left")
    w = Window.orderBy(F.col("all_criteria").desc(),
                       F.when(F.col("all_criteria"), -F.col("auc")).otherwise(F.col("dpd_max")), F.col(model))
    return v.withColumn("recommended", F.row_number().over(w) == 1)


def compare_runs(old: DataFrame, new: DataFrame, name_map: DataFrame | None = None,
                 model: str = "model") -> DataFrame:
    """J3 + A35: pair base and mitigated rows by (mapped model, attribute),
    keep pairs found in both, improvement % = (old − new) / old × 100 (0 if old is 0)."""
    o = old.select(F.col(model).alias("base_model"), "attribute", F.col("dpd").alias("original_dpd"),
                   F.col("eod").alias("original_eod"), F.col("disparate_impact").alias("original_di"))
    n = new.select(F.col(model).alias("new_model"), "attribute", F.col("dpd").alias("fair_dpd"),
                   F.col("eod").alias("fair_eod"), F.col("disparate_impact").alias("fair_di"))
    if name_map is not None:
        n = n.join(name_map.select(F.col("new_model"), F.col("base_model")), "new_model")
    else:
        n = n.withColumn("base_model", F.col("new_model"))
    j = o.join(n, ["base_model", "attribute"])
    imp = lambda a, b: F.when(F.col(a) != 0, (F.col(a) - F.col(b)) / F.col(a) * 100.0).otherwise(F.lit(0.0))
    return j.select(F.col("base_model").alias(model), "attribute", "original_dpd", "fair_dpd",
                    imp("original_dpd", "fair_dpd").alias("dpd_improvement_pct"),
                    "original_eod", "fair_eod", imp("original_eod", "fair_eod").alias("eod_improvement_pct"),
                    "original_di", "fair_di")


def _undominated(x: np.ndarray, block: int = 512) -> np.ndarray:
    """Rows of ``x`` that no other row beats (≥ on all, > on one), sorted first by
    their sum: only an earlier row can beat a later one."""
    x = x[np.argsort(-x.sum(axis=1), kind="stable")]
    front = x[:0]
    for at in range(0, len(x), block):
        new = x[at:at + block]
        for against in (new, *(front[k:k + block] for k in range(0, len(front), block))):
            beaten = ((against[:, None] >= new).all(2) & (against[:, None] > new).any(2)).any(0)
            new = new[~beaten]
        front = np.concatenate((front, new))
    return front


def pareto_front(df: DataFrame, maximise: list[str], key: str = "model", merge: int = 8) -> DataFrame:
    """Rows that no other row dominates (≥ on all, > on one).

    A skyline without a pairwise join: each task keeps the front of its
    distinct score vectors, fronts of ``merge`` tasks meet and lose what the
    others beat, until one front is left; the rows that have its vectors are
    the result. A task holds fronts only, never rows. Rows with a null or NaN
    score are not compared and stay.
    """
    cols = [f"m{i}" for i in range(len(maximise))]
    known = reduce(lambda a, b: a & b, [F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double")) for m in maximise])
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = df.where(known).select(*[F.col(m).cast("double").alias(c) for m, c in zip(maximise, cols)]).distinct()

    def rows(front: np.ndarray, group: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(front[:, i]) for i in range(len(cols))), pa.array(np.full(len(front), group))], [*cols, "group"])

    def local(batches):
        front = np.zeros((0, len(cols)))
        for batch in batches:
            front = _undominated(np.concatenate((front, np.column_stack([c.to_numpy() for c in batch.columns]))))
        yield rows(front, TaskContext.get().partitionId())

    def merged(table: pa.Table) -> pa.Table:
        front = _undominated(np.column_stack([table.column(c).to_numpy() for c in cols]))
        return pa.Table.from_batches([rows(front, table.column("group")[0].as_py())])

    schema = ", ".join(f"{c} double" for c in cols) + ", group long"
    fronts = vectors.mapInArrow(local, schema)
    while groups > 1:
        groups = -(-groups // merge)
        fronts = fronts.withColumn("group", F.pmod("group", F.lit(groups)).cast("bigint")).groupBy("group").applyInArrow(merged, schema)
    on = reduce(lambda a, b: a & b, [F.col(m).cast("double") == F.col(c) for m, c in zip(maximise, cols)])
    return df.join(fronts, on, "left_semi").unionByName(df.where(~known))


def parity_gap_detail(ft: DataFrame, model: str = "model", gap: float = 0.05) -> DataFrame:
    """Per attribute, models whose DPD is over ``gap``, and the best and worst model."""
    m = F.col(model)
    return ft.groupBy("attribute").agg(
        F.count_if(F.col("dpd") > gap).alias("n_over_gap"),
        F.min_by(m, F.struct("dpd", model)).alias("best_model"), F.min("dpd").alias("best_dpd"),
        F.max_by(m, F.struct("dpd", model)).alias("worst_model"),
        F.max("dpd").alias("worst_dpd"))


def actual_vs_predicted(preds: DataFrame, attr: str, y: str = "y_true", pred: str = "pred",
                        model: str = "model", top_k: int = 10) -> DataFrame:
    """For the ``top_k`` largest groups, the true rate, each model's
    predicted rate and the spread between models."""
    g = (preds.where(F.col(attr).isNotNull())
         .groupBy(attr, model).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("actual_rate"),
                                   F.avg(pred).alias("predicted_rate")))
    size_w = Window.partitionBy(attr)
    g = g.withColumn("group_n", F.max("n").over(size_w))
    g = written(g, "groups")
    top = g.select(attr, "group_n").distinct().orderBy(F.col("group_n").desc(), attr).limit(top_k).select(attr)
    g = g.join(top, attr, "left_semi")
    return g.select(attr, model, "group_n", "actual_rate", "predicted_rate",
                    (F.max("predicted_rate").over(size_w) - F.min("predicted_rate").over(size_w)).alias("spread"))
