"""Stream form = batch form for the monitors: events are
fed as day-ordered files, late rows are held back and replayed at the end,
where the watermark drops (and counts) them."""

import os
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fairlane.streaming import monitors as mon

SRC = "/root/testdata/sf0.01/events.parquet"


def _feed(root: str, late_mod: int = 50, chunks: int = 6) -> str:
    t = pq.read_table(SRC).sort_by([("ts", "ascending")])
    late = pc.equal(pc.subtract(t["event_id"], pc.multiply(pc.divide(t["event_id"], late_mod), late_mod)), 0)
    on_time, held = t.filter(pc.invert(late)), t.filter(late)
    src = os.path.join(root, "src")
    os.makedirs(src)
    n = on_time.num_rows
    for i in range(chunks):
        pq.write_table(on_time.slice(i * n // chunks, (i + 1) * n // chunks - i * n // chunks),
                       os.path.join(src, f"part-{i:02d}.parquet"))
    pq.write_table(held, os.path.join(src, "part-99-late.parquet"))
    _order_by_name(src)
    return src


def _order_by_name(src: str) -> None:
    # The file source takes files in modification-time order; make it the name order.
    base = 1_700_000_000
    for i, f in enumerate(sorted(os.listdir(src))):
        os.utime(os.path.join(src, f), (base + 10 * i, base + 10 * i))


def test_fairness_monitor_stream_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="fl-stream-", dir="/tmp")
    src = _feed(root)
    q = mon.run_fairness_monitor(spark, src, os.path.join(root, "sink"), name=os.path.basename(root))
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(root, "sink", "counts")).drop("batch_id")
    # Spark judges a late row against the watermark of the batch BEFORE the
    # one it arrives in: rows whose window ends after that are still counted.
    wm_prev = q.recentProgress[-2].eventTime["watermark"].replace("T", " ").replace("Z", "")
    files = os.listdir(src)
    on_time = spark.read.parquet(*[os.path.join(src, f) for f in files if "late" not in f])
    late = spark.read.parquet(*[os.path.join(src, f) for f in files if "late" in f])
    late_in = late.where((F.col("ts").cast("date") + F.expr("INTERVAL 1 DAY")).cast("timestamp")
                         > F.lit(wm_prev).cast("timestamp"))
    batch = mon.fairness_counts(mon.decisions(on_time.unionByName(late_in)))
    closed = streamed.select("window_start").distinct()
    expected = batch.join(closed, "window_start", "left_semi")
    assert streamed.count() > 0
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, expected.select(*streamed.columns).collect()))
    assert mon.dropped_late_rows(q) > 0
    dpd = spark.read.parquet(os.path.join(root, "sink", "dpd"))
    assert dpd.count() == closed.count()


def test_audit_log_writes_each_event_once(spark):
    root = tempfile.mkdtemp(prefix="fl-audit-", dir="/tmp")
    src = _feed(root, chunks=3)
    # Deliver one file twice.
    first = sorted(f for f in os.listdir(src) if "late" not in f)[0]
    pq.write_table(pq.read_table(os.path.join(src, first)), os.path.join(src, "part-00b-again.parquet"))
    _order_by_name(src)
    q = mon.run_audit_log(spark, src, os.path.join(root, "audit"), name=os.path.basename(root))
    q.awaitTermination(300)
    log = spark.read.parquet(os.path.join(root, "audit"))
    assert log.count() > 0
    assert log.groupBy("event_id").count().where("count > 1").count() == 0


def test_performance_monitor_stream_join_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="fl-perf-", dir="/tmp")
    src = _feed(root, late_mod=10**9)           # only event 0 is held back (and dropped as late)
    q = mon.run_performance_monitor(spark, src, src, os.path.join(root, "sink"), name=os.path.basename(root))
    q.awaitTermination(600)
    streamed = spark.read.parquet(os.path.join(root, "sink", "counts")).drop("batch_id")
    ev = spark.read.parquet(*[os.path.join(src, f) for f in os.listdir(src) if "late" not in f])
    batch = mon.performance_counts(mon.joined_outcomes(mon.decisions(ev), mon.outcomes(ev)))
    closed = streamed.select("window_start").distinct()
    expected = batch.join(closed, "window_start", "left_semi").select(*streamed.columns)
    assert closed.count() > 0
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, expected.collect()))


def test_one_class_window_and_hourly_windows(spark):
    rows = [(i, f"2024-01-01 0{i % 3}:10:00", "a", 1, 0.4 + i / 20) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id long, ts string, grp string, y_true int, score double").withColumn("ts", F.col("ts").cast("timestamp"))
    perf = mon.performance_by_window(mon.performance_counts(df, "1 day")).collect()
    assert len(perf) == 1 and perf[0]["auc"] is None and perf[0]["n"] == 6
    hourly = mon.fairness_counts(df.withColumn("approved", F.col("y_true")), "1 hour").select("window_start", "window_end").distinct().collect()
    assert len(hourly) == 3 and all((r["window_end"] - r["window_start"]).total_seconds() == 3600 for r in hourly)


def test_a_batch_that_runs_again_replaces_itself(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fl-again-", dir="/tmp"), "sink")
    for _ in range(2):
        mon._write_batch(spark.range(5), path, 3)
    assert spark.read.parquet(path).count() == 5
