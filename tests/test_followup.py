"""The follow-up monitors as streams: equal to their batch form, also when the
job ends and starts again between two windows, and when a batch runs twice."""

import os
import tempfile

from pyspark.sql import functions as F
from test_streaming import _feed

from fairlane.streaming import followup as fol
from fairlane.streaming import monitors as mon

PATIENCE = "84 hours"


def _batch(spark, src):
    ev = spark.read.parquet(*[os.path.join(src, f) for f in os.listdir(src) if "late" not in f])
    return fol.by_model(fol.followed(fol.monitored_decisions(ev), mon.outcomes(ev), patience=PATIENCE), fol.MODELS)


def _rows(df, columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def _run_in_two_jobs(spark, src, run):
    """Half of the files, then, in a new job with the same checkpoint, the rest."""
    part = os.path.join(os.path.dirname(src), "part")
    os.makedirs(part)
    files = sorted(os.listdir(src))
    for i, f in enumerate(files):
        if i == len(files) // 2:
            run(part).awaitTermination(600)
        os.link(os.path.join(src, f), os.path.join(part, f))
    run(part).awaitTermination(600)


def test_fairness_of_attributes_and_models_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="fl-follow-", dir="/tmp")
    src, sink = _feed(root, late_mod=10**9, chunks=4), os.path.join(root, "sink")
    fol.run_fairness_follow_up(spark, src, src, sink, os.path.basename(root), patience=PATIENCE).awaitTermination(600)
    got = spark.read.parquet(f"{sink}/fairness").drop("batch_id")
    closed = got.select("window_start").distinct()
    want = fol.fairness_by_window(fol.group_windows(_batch(spark, src), fol.ATTRIBUTES)).join(closed, "window_start", "left_semi")
    assert closed.count() > 5 and {r[0] for r in got.select("attribute").distinct().collect()} == {"grp", "area"}
    assert _rows(got, got.columns) == _rows(want, got.columns)
    assert got.where("eod > 0").count() > 0


def test_performance_compares_windows_over_a_restart(spark):
    root = tempfile.mkdtemp(prefix="fl-perf-follow-", dir="/tmp")
    src, sink = _feed(root, late_mod=10**9, chunks=6), os.path.join(root, "sink")

    def run(files):
        return fol.run_performance_follow_up(spark, files, files, sink, os.path.basename(root), patience=PATIENCE)
    _run_in_two_jobs(spark, src, run)
    got = spark.read.parquet(f"{sink}/performance").drop("batch_id")
    closed = got.select("window_start").distinct()
    want = fol.with_window_before(fol.performance_windows(fol.score_windows(_batch(spark, src)))).join(closed, "window_start", "left_semi")
    assert closed.count() >= 3 and got.where("auc_before IS NOT NULL").count() == got.count() - len(fol.MODELS)
    assert got.agg(F.sum("too_late")).first()[0] > 0 and got.agg(F.sum("missing")).first()[0] > 0
    assert _rows(got, got.columns) == _rows(want, got.columns)


def test_state_of_earlier_batches_only(spark):
    """A batch that runs again compares with what came before it, not with itself."""
    rows = [("m", f"2024-01-{d:02d} 00:00:00", auc, False) for d, auc in ((1, 0.9), (8, 0.8), (15, 0.79))]
    perf = spark.createDataFrame(rows, "model string, window_start string, auc double, retrain boolean")
    sink = os.path.join(tempfile.mkdtemp(prefix="fl-state-", dir="/tmp"), "performance")
    assert fol._earlier(spark, sink, 0) is None
    for _ in range(2):
        for batch_id, day in ((0, "2024-01-01"), (1, "2024-01-08"), (2, "2024-01-15")):
            state = fol._earlier(spark, sink, batch_id)
            new = fol.with_window_before(perf.where(F.col("window_start").startswith(day)), None if state is None else state.select(*fol.STATE))
            mon._write_batch(new, sink, batch_id)
    got = spark.read.parquet(sink).orderBy("window_start").collect()
    assert [(r["auc_before"], r["dropped"], r["retrain_signal"]) for r in got] == [(None, False, False), (0.9, True, True), (0.8, False, False)]


def test_each_prediction_once_and_nulls(spark):
    preds = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00")],
                                  "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    outs = spark.createDataFrame([(1, "2024-01-02 00:00:00", 1), (2, "2024-01-04 06:00:00", 0), (3, "2023-12-31 00:00:00", 1)],
                                 "o_event_id long, outcome_ts string, y_true int").withColumn("outcome_ts", F.col("outcome_ts").cast("timestamp"))
    got = {r["event_id"]: (r["y_true"], r["too_late"], r["missing"]) for r in fol.followed(preds, outs).collect()}
    assert got == {1: (1, False, False), 2: (None, True, False), 3: (None, False, True), None: (None, False, True)}
    assert fol.fairness_by_window(fol.group_windows(fol.by_model(preds.limit(0).selectExpr(
        "ts", "'a' AS grp", "1 AS y_true", "0.5D AS score"), {"m": "score"}), {"grp": "grp"})).count() == 0
