"""Running input drift against a stored baseline.

``fit_baseline`` takes the quantile edges of each feature on the training rows
and the share of each bin; the small table can be saved and read by a later
job. A stream counts the rows of every event-time window per feature and bin
(the only state), and each micro-batch compares the windows it closes with the
baseline: population stability index, and the largest gap of the two binned
distribution functions (Kolmogorov-Smirnov distance on the bins). Nulls are a
bin of their own. The same functions work on static tables; all features are
counted in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlane.operators._util import as_list
from fairlane.operators.stats import _bin_expr, quantile_edges
from fairlane.streaming import monitors as mon

NULLS = -1
FLOOR = 1e-4


def _bins(df: DataFrame, edges: dict[str, list[float]], keep=()) -> DataFrame:
    """(keep..., feature, bin) of every row and feature; bin −1 for nulls and NaN."""
    cells = [F.struct(F.lit(c).alias("feature"),
                      F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(NULLS)).otherwise(_bin_expr(c, e)).alias("bin"))
             for c, e in edges.items()]
    return df.select(*keep, F.inline(F.array(*cells)))


@dataclass
class Baseline:
    """Bin edges and the share of each bin, per feature."""

    edges: dict[str, list[float]]
    shares: dict[str, dict[int, float]]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(feature, bin, share, upto) with one row per bin, empty ones too."""
        rows = [(c, b, float(self.shares[c].get(b, 0.0)), float(e[b]) if 0 <= b < len(e) else None)
                for c, e in self.edges.items() for b in range(NULLS, len(e) + 1)]
        return spark.createDataFrame(rows, "feature string, bin int, share double, upto double")

    def save(self, spark: SparkSession, path: str) -> str:
        self.to_df(spark).coalesce(1).write.mode("overwrite").parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> Baseline:
        edges, shares = {}, {}
        for r in sorted(spark.read.parquet(path).collect(), key=lambda r: (r["feature"], r["bin"])):
            edges.setdefault(r["feature"], [])
            shares.setdefault(r["feature"], {})[r["bin"]] = r["share"]
            if r["upto"] is not None:
                edges[r["feature"]].append(r["upto"])
        return Baseline(edges, shares)


def fit_baseline(df: DataFrame, cols, n_bins: int = 10) -> Baseline:
    """Exact quantile edges of each feature, and the shares of the bins between them."""
    edges = quantile_edges(df, as_list(cols), n_bins)
    counts = _bins(df, edges).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    total = {c: sum(r["n"] for r in counts if r["feature"] == c) for c in edges}
    return Baseline(edges, {c: {r["bin"]: r["n"] / total[c] for r in counts if r["feature"] == c} for c in edges})


def bin_windows(df: DataFrame, baseline: Baseline, ts: str = "ts", window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """(window_start, window_end, feature, bin, n): rows of each window per feature and baseline bin."""
    long = _bins(mon._windowed(df, ts, watermark), baseline.edges, [ts])
    g = long.groupBy(F.window(ts, window).alias("w"), "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature", "bin", "n")


def drift_by_window(counts: DataFrame, baseline: Baseline) -> DataFrame:
    """PSI and binned KS distance per (window, feature), with a level by PSI.

    Shares are floored at ``FLOOR`` for the PSI; KS leaves the bin of nulls out.
    """
    keys = ["window_start", "window_end", "feature"]
    bins = baseline.to_df(counts.sparkSession).drop("upto")
    grid = counts.select(*keys).distinct().join(bins, "feature")
    c = grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("bin") != NULLS
    c = c.select("*", F.sum("n").over(whole).alias("rows"),
                 F.sum(F.when(known, F.col("n"))).over(order).alias("cn"), F.sum(F.when(known, F.col("n"))).over(whole).alias("tn"),
                 F.sum(F.when(known, F.col("share"))).over(order).alias("cb"), F.sum(F.when(known, F.col("share"))).over(whole).alias("tb"))
    now, then = F.greatest(F.col("n") / F.col("rows"), F.lit(FLOOR)), F.greatest("share", F.lit(FLOOR))
    gap = F.abs(F.try_divide("cn", "tn") - F.try_divide("cb", "tb"))
    out = c.groupBy(*keys).agg(F.max("rows").alias("n"), F.sum((now - then) * F.log(now / then)).alias("psi"), F.max(F.when(known, gap)).alias("ks"))
    return out.withColumn("drift", F.when(F.col("psi") > 0.25, "major").when(F.col("psi") > 0.1, "moderate").otherwise("none"))


def run_drift_monitor(spark: SparkSession, source_dir: str, sink_dir: str, baseline_path: str, prepare, name: str = "drift",
                      window: str = "1 day", watermark: str = "1 day"):
    """X4 as a stream: drift of every closed window under ``sink_dir``/drift.

    ``prepare`` turns raw events into rows with ``ts`` and the baseline's features.
    """
    baseline = Baseline.load(spark, baseline_path)
    counts = bin_windows(prepare(mon.read_events_stream(spark, source_dir)), baseline, "ts", window, watermark)

    def sink(batch: DataFrame, batch_id: int) -> None:
        mon._write_batch(batch, f"{sink_dir}/counts", batch_id)
        mon._write_batch(drift_by_window(spark.read.parquet(f"{sink_dir}/counts/batch_id={batch_id}"), baseline), f"{sink_dir}/drift", batch_id)

    return (counts.writeStream.outputMode("append").foreachBatch(sink)
            .option("checkpointLocation", mon._ckpt(spark, name)).trigger(availableNow=True).start())
