"""Audit log of predictions: who was scored when, from which
inputs, by which model, with what result and which contributions.

* The log is written in ``foreachBatch``, one folder per batch id that a batch
  overwrites when it runs again; inside it, one folder per day of the request.
  Repeated deliveries of a request inside the watermark are written once. The
  processing time of a batch is noted in a ledger before its rows are written,
  so a batch that runs again leaves equal rows.
* ``compact`` gathers closed days into one folder each (the many small files
  of micro-batches become few); it can run again at any time. ``audit_rows``
  reads a day's compacted rows and what came later from the log.
* ``expire`` removes days beyond the retention, from both places.

Fixture on ``events``: a decision's inputs are its value, hour and weekday; the
model is a linear score card, whose contributions are exact.
"""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlane.operators.explain import contribution_array
from fairlane.streaming import monitors as mon

RETENTION_YEARS = 7


def requests(events: DataFrame) -> DataFrame:
    """Fixture: decision requests with three numeric inputs (batch or streaming)."""
    ts = F.col("ts").cast("timestamp")
    return events.where(F.col("event_type").isin("purchase", "error")).select(
        F.col("event_id").alias("request_id"), ts.alias("ts"), F.col("value").cast("double").alias("value"),
        F.hour(ts).cast("double").alias("hour"), F.dayofweek(ts).cast("double").alias("weekday"))


def audited(reqs: DataFrame, model: str, version: str, coefs: dict[str, float], means: dict[str, float], intercept: float = 0.0,
            threshold: float = 0.5, id_col: str = "request_id", ts: str = "ts") -> DataFrame:
    """One audit row per request: ``inputs`` and ``contributions`` by name, the
    logistic ``score`` of their sum, the decision, model and version, and the day.

    A null input counts as its mean (contribution 0) and is logged as null.
    """
    base = intercept + sum(coefs[c] * means[c] for c in coefs)
    inputs = F.map_from_arrays(F.array(*[F.lit(c) for c in coefs]), F.array(*[F.col(c).cast("double") for c in coefs]))
    rows = reqs.select(F.col(id_col).alias("request_id"), F.col(ts).alias("ts"), F.lit(model).alias("model"), F.lit(version).alias("version"),
                       inputs.alias("inputs"), F.lit(float(base)).alias("base"), contribution_array(coefs, means).alias("contributions"))
    margin = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["value"])
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    return rows.select("*", score.alias("score")).select(
        "*", F.when(F.col("score") >= threshold, "approved").otherwise("denied").alias("decision"), F.to_date("ts").alias("date"))


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _batch_time(spark: SparkSession, sink_dir: str, batch_id: int) -> datetime:
    """The time a batch was first begun, noted once."""
    path = f"{sink_dir}/ledger/batch_id={batch_id}"
    noted = _existing(spark, path)
    if noted is None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        spark.createDataFrame([(now,)], "begun timestamp").coalesce(1).write.mode("ignore").parquet(path)
        noted = spark.read.parquet(path)
    return noted.first()["begun"]


def write_batch(rows: DataFrame, sink_dir: str, batch_id: int) -> None:
    """Write a batch's audit rows as its own folder; running it again replaces it by equal rows."""
    spark = rows.sparkSession
    stamped = rows.withColumn("processed_at", F.lit(_batch_time(spark, sink_dir, batch_id)).cast("timestamp"))
    stamped.write.mode("overwrite").partitionBy("date").parquet(f"{sink_dir}/log/batch_id={batch_id}")


def run_prediction_audit(spark: SparkSession, source_dir: str, sink_dir: str, model: str, version: str, coefs: dict, means: dict,
                         intercept: float = 0.0, name: str = "prediction-audit", watermark: str = "1 day"):
    """X5 as a stream over event files: every request once, with all audit fields."""
    reqs = requests(mon.read_events_stream(spark, source_dir)).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["request_id"])

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, sink_dir, batch_id)

    return (audited(reqs, model, version, coefs, means, intercept).writeStream.outputMode("append").foreachBatch(sink)
            .option("checkpointLocation", mon._ckpt(spark, name)).trigger(availableNow=True).start())


def compact(spark: SparkSession, sink_dir: str, before: date) -> None:
    """Write each day before ``before`` as one folder under ``daily``, replacing what is there for these days."""
    log = spark.read.parquet(f"{sink_dir}/log").where(F.col("date") < F.lit(before))
    log.repartition("date").sortWithinPartitions("date", "ts", "request_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{sink_dir}/daily")


def audit_rows(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Every audit row once: compacted days, and from the log what they lack (later days and later batches)."""
    log, daily = spark.read.parquet(f"{sink_dir}/log"), _existing(spark, f"{sink_dir}/daily")
    if daily is None:
        return log
    done = daily.select("date", "batch_id").distinct()
    return daily.unionByName(log.join(done, ["date", "batch_id"], "left_anti"))


def expire(spark: SparkSession, sink_dir: str, today: date, years: int = RETENTION_YEARS) -> list[str]:
    """Remove the folders of days more than ``years`` years before ``today``; returns their paths."""
    oldest = f"date={today.replace(year=today.year - years, day=min(today.day, 28))}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    removed = []
    for pattern in (f"{sink_dir}/daily/date=*", f"{sink_dir}/log/batch_id=*/date=*"):
        path = hadoop.Path(pattern)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.globStatus(path) or []:
            if found.getPath().getName() < oldest:
                removed.append(found.getPath().toString())
                files.delete(found.getPath(), True)
    return removed


def audit_cells(rows: DataFrame) -> DataFrame:
    """Long form for reading: one row per request and input, with its contribution."""
    cells = F.transform("contributions", lambda c: F.struct(c["feature"].alias("feature"), _input(c["feature"]).alias("input"), c["value"].alias("contribution")))
    return rows.select("request_id", "ts", "date", "model", "version", "score", "decision", F.inline(cells))


def _input(name: Column) -> Column:
    return F.element_at(F.col("inputs"), name)
