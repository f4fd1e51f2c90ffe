"""Classification metrics.

Confusion counts are four ``count_if`` aggregates in one pass, partially
aggregated per task. Exact AUC and the ROC / PR curves go through counts per
distinct score and the two-level prefix sum in :mod:`fairlane.operators.prefix`
(ties are averaged, as in the usual exact definition). The threshold sweep
evaluates every cut inside one aggregate (no join with a threshold table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlane.operators._util import as_list, div0, safe_div
from fairlane.operators.prefix import ordered_prefix_sums


def _confusion_aggs(y: str, pred: str):
    yc, pc = F.col(y), F.col(pred)
    return [F.count_if((yc == 0) & (pc == 0)).alias("tn"),
            F.count_if((yc == 0) & (pc == 1)).alias("fp"),
            F.count_if((yc == 1) & (pc == 0)).alias("fn"),
            F.count_if((yc == 1) & (pc == 1)).alias("tp")]


def confusion(df: DataFrame, y: str = "y_true", pred: str = "pred", by=None) -> DataFrame:
    """TN, FP, FN, TP with false positive and false negative rates."""
    by = as_list(by)
    g = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(*_confusion_aggs(y, pred))
    return g.select(*by, "tn", "fp", "fn", "tp",
                    div0(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
                    div0(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"))


def _scores_from_counts(g: DataFrame, by: list[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = div0(tp, tp + fp)
    recall = div0(tp, tp + fn)
    f1 = div0(F.lit(2.0) * tp, F.lit(2) * tp + fp + fn)
    n = tp + fp + fn + tn
    return g.select(*by, "tn", "fp", "fn", "tp", n.alias("n"),
                    div0(tp + tn, n).alias("accuracy"), precision.alias("precision"),
                    recall.alias("recall"), f1.alias("f1"))


def classification_metrics(df: DataFrame, y: str = "y_true", pred: str = "pred", by="model") -> DataFrame:
    """Accuracy, precision, recall, F1 with zero-division = 0."""
    by = as_list(by)
    g = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(*_confusion_aggs(y, pred))
    return _scores_from_counts(g, by)


def per_class_report(df: DataFrame, y: str = "y_true", pred: str = "pred", by="model") -> DataFrame:
    """A23 per-class form: precision / recall / F1 / support for class 0 and 1."""
    by = as_list(by)
    g = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(*_confusion_aggs(y, pred))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one = F.struct(F.lit(1).alias("cls"), div0(tp, tp + fp).alias("precision"), div0(tp, tp + fn).alias("recall"),
                   div0(F.lit(2.0) * tp, F.lit(2) * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))
    zero = F.struct(F.lit(0).alias("cls"), div0(tn, tn + fn).alias("precision"), div0(tn, tn + fp).alias("recall"),
                    div0(F.lit(2.0) * tn, F.lit(2) * tn + fn + fp).alias("f1"), (tn + fp).alias("support"))
    return g.select(*by, F.inline(F.array(zero, one)))


def score_counts(df: DataFrame, score: str = "score", y: str = "y_true", by="model") -> DataFrame:
    """Counts of positives and negatives per distinct score (the pre-aggregate)."""
    by = as_list(by)
    return (df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
            .groupBy(*by, score)
            .agg(F.sum(F.col(y).cast("long")).alias("pos"),
                 F.count_if(F.col(y) == 0).alias("neg")))


def roc_auc(df: DataFrame, score: str = "score", y: str = "y_true", by="model",
            rows_per_range: int | None = None) -> DataFrame:
    """Exact ROC AUC with ties averaged: Σ pos(s)·(neg below s + neg(s)/2) / (P·N)."""
    by = as_list(by)
    c = ordered_prefix_sums(score_counts(df, score, y, by), by, score, ["neg"], rows_per_range=rows_per_range)
    below = F.col("cum_neg") - F.col("neg")
    g = c.groupBy(*by).agg(
        F.sum(F.col("pos").cast("double") * (below + F.col("neg") / F.lit(2.0))).alias("_num"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return g.select(*by, safe_div(F.col("_num"), F.col("p").cast("double") * F.col("n")).alias("auc"), "p", "n")


def _descending_curve(df: DataFrame, score: str, y: str, by: list[str], rows_per_range: int | None) -> DataFrame:
    c = ordered_prefix_sums(score_counts(df, score, y, by), by, score, ["pos", "neg"], descending=True, totals=True,
                            rows_per_range=rows_per_range)
    return c.withColumnsRenamed({"cum_pos": "tps", "cum_neg": "fps", "tot_pos": "P", "tot_neg": "N"})


def roc_curve(df: DataFrame, score: str = "score", y: str = "y_true", by="model",
              rows_per_range: int | None = None) -> DataFrame:
    """One point per distinct threshold (score >= threshold is positive)."""
    by = as_list(by)
    c = _descending_curve(df, score, y, by, rows_per_range)
    return c.select(*by, F.col(score).alias("threshold"), safe_div(F.col("fps"), F.col("N")).alias("fpr"),
                    safe_div(F.col("tps"), F.col("P")).alias("tpr"), "tps", "fps")


def pr_curve(df: DataFrame, score: str = "score", y: str = "y_true", by="model",
             rows_per_range: int | None = None) -> DataFrame:
    """Precision and recall at each distinct threshold."""
    by = as_list(by)
    c = _descending_curve(df, score, y, by, rows_per_range)
    return c.select(*by, F.col(score).alias("threshold"),
                    safe_div(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
                    safe_div(F.col("tps"), F.col("P")).alias("recall"))


def average_precision(df: DataFrame, score: str = "score", y: str = "y_true", by="model",
                      rows_per_range: int | None = None) -> DataFrame:
    """AP = Σ over thresholds of (recall step) × precision."""
    by = as_list(by)
    c = _descending_curve(df, score, y, by, rows_per_range)
    prec = F.col("tps") / (F.col("tps") + F.col("fps"))
    return c.groupBy(*by).agg(safe_div(F.sum(F.col("pos") * prec), F.first("P")).alias("average_precision"))


def sweep_thresholds(start: float = 0.30, stop: float = 0.80, step: float = 0.05) -> list[float]:
    n = int(round((stop - start) / step))
    return [round(start + i * step, 10) for i in range(n) if start + i * step < stop - 1e-12]


def threshold_sweep(df: DataFrame, thresholds=None, score: str = "score", y: str = "y_true", by="model",
                    min_precision: float = 0.80, min_recall: float = 0.70) -> DataFrame:
    """Metrics at each cut (``score >= t``), all cuts in one aggregate pass."""
    by = as_list(by)
    ts = [float(t) for t in (thresholds or sweep_thresholds())]
    s, yc = F.col(score), F.col(y)
    cells = [F.struct(F.lit(t).alias("threshold"),
                      F.count_if((s >= t) & (yc == 1)).alias("tp"),
                      F.count_if((s >= t) & (yc == 0)).alias("fp"),
                      F.count_if((s < t) & (yc == 1)).alias("fn"),
                      F.count_if((s < t) & (yc == 0)).alias("tn")) for t in ts]
    g = (df.where(s.isNotNull() & yc.isNotNull()).groupBy(*by).agg(F.array(*cells).alias("_cells"))
         .select(*by, F.inline("_cells")))
    m = _scores_from_counts(g.withColumnRenamed("threshold", "_t"), by + ["_t"])
    return m.select(*by, F.col("_t").alias("threshold"), "precision", "recall", "f1", "fp", "fn",
                    ((F.col("precision") >= min_precision) & (F.col("recall") >= min_recall)).alias("meets_criteria"))


def model_comparison(df: DataFrame, score: str = "score", y: str = "y_true", pred: str = "pred",
                     by="model", limits: dict | None = None) -> DataFrame:
    """AUC with the classification metrics per model and the acceptance
    flags (AUC 0.75, precision 0.80, recall 0.70, F1 0.70 by default)."""
    by = as_list(by)
    lim = {"auc": 0.75, "precision": 0.80, "recall": 0.70, "f1": 0.70, **(limits or {})}
    m = classification_metrics(df, y, pred, by).join(roc_auc(df, score, y, by).select(*by, "auc"), by)
    return m.select(*by, "auc", "accuracy", "precision", "recall", "f1",
                    (F.col("auc") >= lim["auc"]).alias("auc_pass"),
                    (F.col("precision") >= lim["precision"]).alias("precision_pass"),
                    (F.col("recall") >= lim["recall"]).alias("recall_pass"),
                    (F.col("f1") >= lim["f1"]).alias("f1_pass"),
                    ((F.col("auc") >= lim["auc"]) & (F.col("precision") >= lim["precision"])
                     & (F.col("recall") >= lim["recall"])).alias("all_pass"))


def error_cohort_profile(df: DataFrame, features: list[str], y: str = "y_true", pred: str = "pred",
                         by="model") -> DataFrame:
    """Mean of each feature among false positives and false negatives
    versus all rows, and the percent gap (0 when the overall mean is 0)."""
    by = as_list(by)
    fp = (F.col(y) == 0) & (F.col(pred) == 1)
    fn = (F.col(y) == 1) & (F.col(pred) == 0)
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}__all"),
                 F.avg(F.when(fp, F.col(f))).alias(f"{f}__fp"),
                 F.avg(F.when(fn, F.col(f))).alias(f"{f}__fn")]
    g = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__all").alias("mean_all"),
                              F.col(f"{f}__fp").alias("mean_fp"), F.col(f"{f}__fn").alias("mean_fn"))
                     for f in features])
    out = g.select(*by, F.inline(rows))
    pct = lambda c: F.when(F.col("mean_all") != 0, (F.col(c) - F.col("mean_all")) / F.col("mean_all") * 100.0) \
        .otherwise(F.lit(0.0))
    return out.select(*by, "feature", "mean_all", "mean_fp", "mean_fn",
                      pct("mean_fp").alias("fp_gap_pct"), pct("mean_fn").alias("fn_gap_pct"))
