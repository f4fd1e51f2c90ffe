"""Running monitors on Structured Streaming.

Every monitor is written once as DataFrame code that works on a static
table (the batch form, checked against SQL) and on a streaming one
(``readStream``): event time is cast from ``timestamp_ntz`` to ``timestamp``
(a watermark refuses the former), windows are tumbling, the watermark bounds
the state, and windows are emitted in append mode once the watermark has
passed them. Aggregates over aggregates (DPD over group rates, AUC over
score counts) run in ``foreachBatch`` on the rows a micro-batch emits – a
closed window's rows all arrive in the same micro-batch.

Stream fixture on ``events``: ``purchase`` is an approval, ``error`` a
denial, other types are ignored; the group is ``user_id % 5``; the model
score is a fixed formula; the outcome of a decision arrives
``event_id % 96`` hours after it (a late-outcome stream for X3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlane.operators._util import as_list, safe_div
from fairlane.operators.prefix import ordered_prefix_sums
from fairlane.session import checkpoint_dir
from fairlane.sources.tables import hash_bucket

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DPD_ALERT, DPD_REVIEW = 0.05, 0.10


def decisions(events: DataFrame) -> DataFrame:
    """Decision rows from raw events (works on batch and streaming input)."""
    d = events.where(F.col("event_type").isin("purchase", "error"))
    approved = (F.col("event_type") == "purchase").cast("int")
    score = (approved * F.lit(1000) + hash_bucket("p", F.col("event_id"), 1000)) / F.lit(2000.0)
    return d.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.pmod(F.col("user_id"), F.lit(5)).cast("string").alias("grp"),
                    approved.alias("approved"), score.alias("score"),
                    (score >= F.lit(0.5)).cast("int").alias("pred"))


def _windowed(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(ts, watermark) if (df.isStreaming and watermark) else df


def fairness_counts(dec: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """X1 step 1: decisions and approvals per (window, group)."""
    d = _windowed(dec, "ts", watermark)
    g = d.groupBy(F.window("ts", window).alias("w"), "grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("approved").cast("bigint").alias("approved"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "grp", "n", "approved")


def dpd_by_window(counts: DataFrame, limit: float = DPD_ALERT, review: float = DPD_REVIEW) -> DataFrame:
    """X1 step 2: demographic parity difference of approval rates per window
    and the alert level (over ``limit``: alert; over ``review``: review)."""
    rate = safe_div(F.col("approved"), F.col("n"))
    g = counts.groupBy("window_start", "window_end").agg((F.max(rate) - F.min(rate)).alias("dpd"),
                                           F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"))
    level = F.when(F.col("dpd") > review, "immediate review").when(F.col("dpd") > limit, "alert").otherwise("ok")
    return g.withColumn("level", level)


def volume(dec: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Decisions, denials (errors) and the denial rate per window."""
    d = _windowed(dec, "ts", watermark)
    g = d.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("volume"), F.count_if(F.col("approved") == 0).alias("errors"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "volume", "errors",
                    safe_div(F.col("errors"), F.col("volume")).alias("error_rate"))


def outcomes(events: DataFrame, max_delay_hours: int = 96) -> DataFrame:
    """Late outcomes of decisions: the true label arrives some hours later."""
    d = decisions(events)
    delay = F.pmod(F.col("event_id"), F.lit(max_delay_hours)).cast("int")
    return d.select(F.col("event_id").alias("o_event_id"),
                    (F.col("ts") + F.make_interval(hours=delay)).alias("outcome_ts"),
                    F.col("approved").alias("y_true"))


def joined_outcomes(preds: DataFrame, outs: DataFrame, bound: str = "3 days",
                    watermark: str = "1 day") -> DataFrame:
    """X3 step 1: predictions joined to outcomes that arrive within ``bound``
    (a watermarked stream-stream inner join with a time bound, so state is
    dropped once no outcome can match any more)."""
    p = _windowed(preds, "ts", watermark)
    o = _windowed(outs, "outcome_ts", watermark)
    cond = ((F.col("event_id") == F.col("o_event_id")) & (F.col("outcome_ts") >= F.col("ts"))
            & (F.col("outcome_ts") <= F.col("ts") + F.expr(f"INTERVAL {bound}")))
    return p.join(o, cond, "inner")


def performance_counts(joined: DataFrame, window: str = "7 days", watermark: str = "1 day") -> DataFrame:
    """X3 step 2: counts per (window, distinct score) of positives and
    negatives – the exact input of AUC and the confusion metrics."""
    g = joined.groupBy(F.window("ts", window).alias("w"), "score").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "score", "pos", "neg")


# Limits below which a model is to be retrained, and the drop of AUC that does the same.
AUC_LIMIT, ACCURACY_LIMIT, F1_LIMIT, AUC_DROP = 0.75, 0.90, 0.85, 0.05


def performance_by_window(counts: DataFrame, auc_limit: float = AUC_LIMIT, accuracy_limit: float = ACCURACY_LIMIT,
                          f1_limit: float = F1_LIMIT, by=None) -> DataFrame:
    """X3 step 3: exact AUC (ties averaged), accuracy and F1 at 0.5 and the
    retrain flag per window (and ``by``), from the counts per (window, score).
    A window of one class only has no AUC, which is no reason to retrain."""
    keys = ["window_start", "window_end", *as_list(by)]
    c = ordered_prefix_sums(counts, keys, "score", ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    hit, miss = F.sum(F.when(F.col("score") >= 0.5, F.col("pos"))), F.sum(F.when(F.col("score") < 0.5, F.col("pos")))
    false = F.sum(F.when(F.col("score") >= 0.5, F.col("neg")))
    tp, fn, fp = (F.coalesce(x, F.lit(0)).cast("double") for x in (hit, miss, false))
    g = c.groupBy(*keys).agg(
        safe_div(F.sum(F.col("pos").cast("double") * (below + F.col("neg") / F.lit(2.0))),
                 F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
        safe_div(F.sum(F.when(F.col("score") >= 0.5, F.col("pos")).otherwise(F.col("neg"))),
                 F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"),
        safe_div(2 * tp, 2 * tp + fn + fp).alias("f1"),
        F.sum(F.col("pos") + F.col("neg")).alias("n"))
    below = (F.coalesce(F.col("auc") < F.lit(auc_limit), F.lit(False)) | F.coalesce(F.col("accuracy") < F.lit(accuracy_limit), F.lit(False))
             | F.coalesce(F.col("f1") < F.lit(f1_limit), F.lit(False)))
    return g.withColumn("retrain", below)


def auc_drops(performance: DataFrame, drop: float = AUC_DROP) -> DataFrame:
    """X3 step 4: AUC of the window before, and whether this one's lies more
    than ``drop`` (a share) below it. One row per window goes in and out."""
    before = F.lag("auc").over(Window.orderBy("window_start"))
    return performance.withColumn("auc_before", before).withColumn(
        "dropped", F.coalesce(F.col("auc") < F.col("auc_before") * F.lit(1.0 - drop), F.lit(False)))


def unmatched_outcomes(preds: DataFrame, outs: DataFrame, bound: str = "3 days", window: str = "7 days") -> DataFrame:
    """Per window, predictions whose outcome came too late or never (batch form)."""
    late = F.col("outcome_ts") > F.col("ts") + F.expr(f"INTERVAL {bound}")
    j = preds.join(outs, F.col("event_id") == F.col("o_event_id"), "left")
    g = j.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if(F.col("o_event_id").isNull()).alias("without_outcome"), F.count_if(late).alias("too_late"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "predictions", "without_outcome", "too_late")


# --- running the streams -------------------------------------------------------------------------

def read_events_stream(spark: SparkSession, source_dir: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)


def _ckpt(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch as its own partition: a batch that is run again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run_fairness_monitor(spark: SparkSession, source_dir: str, sink_dir: str, name: str = "fairness",
                         window: str = "1 day", watermark: str = "1 day"):
    """X1 as a stream: windowed group counts in append mode; each micro-batch
    writes the counts and the DPD of the windows it closes. Returns the query
    (``availableNow``: processes what is there, then stops)."""
    counts = fairness_counts(decisions(read_events_stream(spark, source_dir)), window, watermark)

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, f"{sink_dir}/counts", batch_id)
        _write_batch(dpd_by_window(spark.read.parquet(f"{sink_dir}/counts/batch_id={batch_id}")), f"{sink_dir}/dpd", batch_id)

    return (counts.writeStream.outputMode("append").foreachBatch(sink)
            .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True).start())


def run_volume_monitor(spark: SparkSession, source_dir: str, sink_dir: str, name: str = "volume"):
    """X2 as a stream: append windows to a Parquet sink."""
    v = volume(decisions(read_events_stream(spark, source_dir)))
    return (v.writeStream.outputMode("append").format("parquet").option("path", sink_dir)
            .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True).start())


def run_performance_monitor(spark: SparkSession, prediction_dir: str, outcome_dir: str, sink_dir: str,
                            name: str = "performance", window: str = "7 days", bound: str = "3 days",
                            watermark: str = "1 day"):
    """X3 as a stream: predictions and late outcomes arrive as two streams of
    event files; the time-bounded join keeps state only for ``bound`` plus the
    watermark; counts per (window, score) are appended when a window closes and
    each micro-batch writes AUC / accuracy of the windows it closes."""
    preds = decisions(read_events_stream(spark, prediction_dir))
    outs = outcomes(read_events_stream(spark, outcome_dir))
    counts = performance_counts(joined_outcomes(preds, outs, bound, watermark), window)

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, f"{sink_dir}/counts", batch_id)
        _write_batch(performance_by_window(spark.read.parquet(f"{sink_dir}/counts/batch_id={batch_id}")), f"{sink_dir}/performance", batch_id)

    return (counts.writeStream.outputMode("append").foreachBatch(sink)
            .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True).start())


def run_audit_log(spark: SparkSession, source_dir: str, sink_dir: str, name: str = "audit",
                  watermark: str = "1 day"):
    """Append-only audit log partitioned by date; repeated deliveries of
    an event inside the watermark are written once."""
    d = decisions(read_events_stream(spark, source_dir)).withWatermark("ts", watermark)
    d = d.dropDuplicatesWithinWatermark(["event_id"]).withColumn("date", F.to_date("ts"))
    return (d.writeStream.outputMode("append").format("parquet").partitionBy("date").option("path", sink_dir)
            .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True).start())


def dropped_late_rows(query) -> int:
    """Late rows dropped by the watermark so far (from the query progress)."""
    total = 0
    for p in query.recentProgress:
        for op in p.stateOperators or []:
            total += op.numRowsDroppedByWatermark or 0
    return total

