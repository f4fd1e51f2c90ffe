"""X5 and X4 as streams: whole audit rows once, over replays, compaction and
expiry; drift of closed windows equal to the batch form after a restart."""

import datetime as dt
import os
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_followup import _rows, _run_in_two_jobs
from test_streaming import _feed, _order_by_name

from fairlane.catalog.q_stream import COEFS, INTERCEPT, MEANS, drift_inputs
from fairlane.streaming import audit, drift


def test_audit_stream_writes_whole_rows_once(spark):
    root = tempfile.mkdtemp(prefix="fl-audit-", dir="/tmp")
    src, sink = _feed(root, late_mod=10**9, chunks=3), os.path.join(root, "sink")
    first = sorted(os.listdir(src))[0]
    pq.write_table(pq.read_table(os.path.join(src, first)), os.path.join(src, "part-00b-again.parquet"))
    _order_by_name(src)
    audit.run_prediction_audit(spark, src, sink, "card", "1", COEFS, MEANS, INTERCEPT, os.path.basename(root)).awaitTermination(600)
    rows = audit.audit_rows(spark, sink)
    want = audit.audited(audit.requests(spark.read.parquet(*[os.path.join(src, f) for f in os.listdir(src) if "late" not in f and "again" not in f])),
                         "card", "1", COEFS, MEANS, INTERCEPT)
    cols = ["request_id", "ts", "date", "model", "version", "score", "decision", "feature", "input", "contribution"]
    assert _rows(audit.audit_cells(rows), cols) == _rows(audit.audit_cells(want), cols)
    assert rows.where("processed_at IS NULL").count() == 0
    total = rows.select("score", (F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["value"])).alias("m"))
    assert total.where("abs(score - 1 / (1 + exp(-m))) > 1e-12").count() == 0


def test_replayed_batch_compaction_and_expiry(spark):
    sink = os.path.join(tempfile.mkdtemp(prefix="fl-audit-", dir="/tmp"), "sink")
    days = ["2015-03-01 10:00:00", "2024-01-01 10:00:00", "2024-01-02 10:00:00"]

    def rows(ids, day):
        return audit.audited(spark.createDataFrame([(i, day, 1.0, None, 3.0) for i in ids], "request_id long, ts string, value double, hour double, weekday double")
                             .withColumn("ts", F.col("ts").cast("timestamp")), "card", "1", COEFS, MEANS)
    for b, day in enumerate(days):
        audit.write_batch(rows(range(10 * b, 10 * b + 4), day), sink, b)
    before = sorted(map(str, audit.audit_rows(spark, sink).collect()))
    audit.write_batch(rows(range(10, 14), days[1]), sink, 1)                          # the batch runs again
    assert sorted(map(str, audit.audit_rows(spark, sink).collect())) == before        # processing times too
    for _ in range(2):
        audit.compact(spark, sink, dt.date(2024, 1, 2))
        assert audit.audit_rows(spark, sink).count() == 12
    audit.write_batch(rows([99], days[1]), sink, 7)                                   # a late row of a compacted day
    assert audit.audit_rows(spark, sink).where("request_id = 99").count() == 1
    assert len(audit.expire(spark, sink, dt.date(2024, 2, 29))) == 2                  # log and daily of 2015
    assert sorted(r[0] for r in audit.audit_rows(spark, sink).select("request_id").collect()) == [10, 11, 12, 13, 20, 21, 22, 23, 99]


def test_drift_stream_equals_batch_after_a_restart(spark):
    root = tempfile.mkdtemp(prefix="fl-drift-", dir="/tmp")
    src, sink = _feed(root, late_mod=10**9, chunks=4), os.path.join(root, "sink")
    rows = drift_inputs(spark.read.parquet(*[os.path.join(src, f) for f in os.listdir(src) if "late" not in f]))
    base = drift.fit_baseline(rows.where("ts < '2024-01-11'"), ["value", "user_part"])
    path = base.save(spark, os.path.join(root, "baseline"))
    assert drift.Baseline.load(spark, path).edges == base.edges

    def run(files):
        return drift.run_drift_monitor(spark, files, sink, path, drift_inputs, os.path.basename(root))
    _run_in_two_jobs(spark, src, run)
    got = spark.read.parquet(f"{sink}/drift").drop("batch_id")
    closed = got.select("window_start").distinct()
    want = drift.drift_by_window(drift.bin_windows(rows, base), base).join(closed, "window_start", "left_semi")
    assert closed.count() > 5 and _rows(got, got.columns) == _rows(want, got.columns)


def test_drift_of_shifted_null_and_constant_inputs(spark):
    base = drift.fit_baseline(spark.range(1000).select((F.col("id") / 10).alias("x"), F.lit(1.0).alias("one")), ["x", "one"])
    day = F.lit("2024-01-01").cast("timestamp").alias("ts")
    now = spark.range(500).select(day, F.when(F.col("id") % 2 == 0, F.col("id") / 10 + 60).alias("x"), F.lit(1.0).alias("one"))
    got = {r["feature"]: r for r in drift.drift_by_window(drift.bin_windows(now, base), base).collect()}
    assert got["x"]["drift"] == "major" and got["x"]["ks"] > 0.5 and got["one"]["psi"] == 0.0 and got["one"]["ks"] == 0.0
    assert drift.drift_by_window(drift.bin_windows(now.limit(0), base), base).count() == 0
