"""Monitors that wait for outcomes.

One stream-stream LEFT OUTER join follows each prediction until its outcome
comes, or until no outcome can come any more: ``patience`` bounds the state.
An outcome within ``bound`` is a label; a later one is counted as too late, a
missing one as missing. On the followed rows, windowed counts are taken in the
same query (a second stateful operator behind the join):

* X1: per (window, model, attribute, group) the confusion counts of every
  protected attribute, unpivoted row by row; the spreads of their rates are
  DPD (over all predictions) and EOD (over those with a label);
* X3: per (window, model, score) the labels, from which AUC is exact.

What compares windows or groups of a closed window runs in ``foreachBatch``.
The AUC of the window before is kept in a state table beside the results: a
row per model and window, one partition per micro-batch. A micro-batch reads
only partitions of earlier batches and overwrites its own, so a batch that
runs again after a restart finds the state it had and leaves the same rows.

Every function also works on static tables; the batch queries use the same code.

Stream fixture on ``events``: as in ``monitors``, with two protected attributes
(``user_id % 5`` and a hash of the user) and two models (the formula score and
a hash score).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlane.sources.tables import hash_bucket
from fairlane.streaming import monitors as mon

ATTRIBUTES = {"grp": "grp", "area": "area"}
MODELS = {"formula": "score", "shadow": "shadow_score"}
BOUND, PATIENCE, WATERMARK = "3 days", "7 days", "1 day"


def monitored_decisions(events: DataFrame) -> DataFrame:
    """Fixture: decisions with a second attribute and a second model's score."""
    d = events.where(F.col("event_type").isin("purchase", "error"))
    approved = (F.col("event_type") == "purchase").cast("int")
    return d.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.pmod(F.col("user_id"), F.lit(5)).cast("string").alias("grp"),
                    hash_bucket("a", F.col("user_id"), 3).cast("string").alias("area"),
                    ((approved * F.lit(1000) + hash_bucket("p", F.col("event_id"), 1000)) / F.lit(2000.0)).alias("score"),
                    (hash_bucket("m", F.col("event_id"), 1000) / F.lit(1000.0)).alias("shadow_score"))


def followed(preds: DataFrame, outs: DataFrame, bound: str = BOUND, patience: str = PATIENCE, watermark: str = WATERMARK) -> DataFrame:
    """Every prediction once, with ``y_true`` (null without an outcome within ``bound``), ``too_late`` and ``missing``.

    ``preds`` has ``event_id`` and ``ts``, ``outs`` has ``o_event_id`` (at most
    one row each), ``outcome_ts`` and ``y_true``. An outcome later than
    ``patience`` counts as missing; one from before its prediction is none.
    """
    p, o = mon._windowed(preds, "ts", watermark), mon._windowed(outs, "outcome_ts", watermark)
    met = ((F.col("event_id") == F.col("o_event_id")) & (F.col("outcome_ts") >= F.col("ts"))
           & (F.col("outcome_ts") <= F.col("ts") + F.expr(f"INTERVAL {patience}")))
    late = F.col("outcome_ts") > F.col("ts") + F.expr(f"INTERVAL {bound}")
    return p.join(o, met, "leftOuter").select(
        *[F.col(c) for c in preds.columns], F.when(~late, F.col("y_true")).alias("y_true"),
        F.coalesce(late, F.lit(False)).alias("too_late"), F.col("o_event_id").isNull().alias("missing"))


def by_model(rows: DataFrame, models: dict[str, str], threshold: float = 0.5) -> DataFrame:
    """One row per model: ``model``, ``score`` and ``pred`` in place of the models' score columns."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in models.items()])
    long = rows.select(*[c for c in rows.columns if c not in models.values()], F.inline(cells))
    return long.withColumn("pred", (F.col("score") >= F.lit(threshold)).cast("int"))


def group_windows(rows: DataFrame, attributes: dict[str, str], window: str = "1 day") -> DataFrame:
    """X1 step 1: per (window, model, attribute, group) n, selected and the confusion counts of labelled rows."""
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(c).cast("string").alias("grp")) for a, c in attributes.items()])
    long = rows.select("ts", "model", "y_true", "pred", F.inline(cells)).where(F.col("grp").isNotNull())
    y, p = F.col("y_true"), F.col("pred")
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(p == 1).alias("selected"),
              *[F.count_if((y == a) & (p == b)).alias(name) for name, a, b in (("tp", 1, 1), ("fn", 1, 0), ("fp", 0, 1), ("tn", 0, 0))]]
    g = long.groupBy(F.window("ts", window).alias("w"), "model", "attribute", "grp").agg(*counts)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *g.columns[1:])


def fairness_by_window(counts: DataFrame, limit: float = mon.DPD_ALERT, review: float = mon.DPD_REVIEW) -> DataFrame:
    """X1 step 2: DPD and EOD per (window, model, attribute) and the alert level of the larger one.

    EOD is the larger spread of true and false positive rates over the groups
    that have labels of that class; without two of them it is 0.
    """
    tpr = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    fpr = F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn")))
    rate = F.col("selected") / F.col("n")
    labelled = F.sum(F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn"))
    g = counts.groupBy("window_start", "window_end", "model", "attribute").agg(
        (F.max(rate) - F.min(rate)).alias("dpd"),
        F.coalesce(F.greatest(F.max(tpr) - F.min(tpr), F.max(fpr) - F.min(fpr)), F.lit(0.0)).alias("eod"),
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"), labelled.alias("labelled"))
    worst = F.greatest("dpd", "eod")
    return g.withColumn("level", F.when(worst > review, "immediate review").when(worst > limit, "alert").otherwise("ok"))


def score_windows(rows: DataFrame, window: str = "7 days") -> DataFrame:
    """X3 step 1: per (window, model, score) labels by class, outcomes too late and missing."""
    g = rows.groupBy(F.window("ts", window).alias("w"), "model", "score").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"),
        F.count(F.lit(1)).alias("predictions"), F.count_if("too_late").alias("too_late"), F.count_if("missing").alias("missing"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *g.columns[1:])


def performance_windows(counts: DataFrame) -> DataFrame:
    """X3 step 2: exact AUC, accuracy, F1 and the limits per (window, model), with what had no label in time."""
    keys = ["window_start", "window_end", "model"]
    perf = mon.performance_by_window(counts, by=["model"])
    rest = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("predictions", "too_late", "missing")])
    return perf.join(rest, keys)


STATE = ["model", "window_start", "auc"]


def with_window_before(perf: DataFrame, state: DataFrame | None = None, drop: float = mon.AUC_DROP) -> DataFrame:
    """X3 step 3: AUC of the model's window before, whether this one lies more
    than the share ``drop`` below it, and the signal to retrain.

    ``state`` holds (model, window_start, auc) of windows closed earlier; only
    the last one of each model is looked at.
    """
    new = perf.withColumn("_new", F.lit(True))
    if state is not None:
        last = state.groupBy("model").agg(F.max(F.struct("window_start", "auc")).alias("l")).select("model", "l.*", F.lit(False).alias("_new"))
        new = new.unionByName(last, allowMissingColumns=True)
    before = F.lag("auc").over(Window.partitionBy("model").orderBy("window_start"))
    out = new.withColumn("auc_before", before).where("_new").drop("_new")
    dropped = F.coalesce(F.col("auc") < F.col("auc_before") * F.lit(1.0 - drop), F.lit(False))
    return out.withColumn("dropped", dropped).withColumn("retrain_signal", F.col("retrain") | F.col("dropped"))


# --- running the streams -------------------------------------------------------------------------

def _followed_stream(spark: SparkSession, prediction_dir: str, outcome_dir: str, patience: str) -> DataFrame:
    preds = monitored_decisions(mon.read_events_stream(spark, prediction_dir))
    return by_model(followed(preds, mon.outcomes(mon.read_events_stream(spark, outcome_dir)), patience=patience), MODELS)


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Rows that earlier micro-batches wrote, or None before the first one."""
    try:
        return spark.read.parquet(path).where(F.col("batch_id") < batch_id)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def run_fairness_follow_up(spark: SparkSession, prediction_dir: str, outcome_dir: str, sink_dir: str, name: str = "fairness-follow-up",
                           window: str = "1 day", patience: str = PATIENCE):
    """X1 as a stream: DPD and EOD of every closed window, model and attribute under ``sink_dir``/fairness."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        mon._write_batch(batch, f"{sink_dir}/counts", batch_id)
        mon._write_batch(fairness_by_window(spark.read.parquet(f"{sink_dir}/counts/batch_id={batch_id}")), f"{sink_dir}/fairness", batch_id)

    counts = group_windows(_followed_stream(spark, prediction_dir, outcome_dir, patience), ATTRIBUTES, window)
    return (counts.writeStream.outputMode("append").foreachBatch(sink)
            .option("checkpointLocation", mon._ckpt(spark, name)).trigger(availableNow=True).start())


def run_performance_follow_up(spark: SparkSession, prediction_dir: str, outcome_dir: str, sink_dir: str, name: str = "performance-follow-up",
                              window: str = "7 days", patience: str = PATIENCE):
    """X3 as a stream: each closed window of each model under ``sink_dir``/performance, compared with the window before."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        mon._write_batch(batch, f"{sink_dir}/counts", batch_id)
        perf = performance_windows(spark.read.parquet(f"{sink_dir}/counts/batch_id={batch_id}"))
        state = _earlier(spark, f"{sink_dir}/performance", batch_id)
        mon._write_batch(with_window_before(perf, None if state is None else state.select(*STATE)), f"{sink_dir}/performance", batch_id)

    counts = score_windows(_followed_stream(spark, prediction_dir, outcome_dir, patience), window)
    return (counts.writeStream.outputMode("append").foreachBatch(sink)
            .option("checkpointLocation", mon._ckpt(spark, name)).trigger(availableNow=True).start())
