"""Ordered prefix sums over any number of keys, without a task that holds a key.

A running total over an ordered column is the core of exact AUC, ROC / PR
curves, rank tests and quantiles. A window over a key would sort all of its
values in one task, and a window without keys the whole table. Instead:

1. the caller pre-aggregates to one row per distinct order value (the input
   here is a "counts per value" table, much smaller than the rows); it is
   written once, so that nothing above it runs again;
2. if some key has more than ``ROWS_PER_RANGE`` rows, ONE global range
   partitioning by (key, order) cuts the table into as many ranges as it has
   that many rows. A hot key spans many ranges, rare keys share one. Short
   ranges are cut inside the sorted partitions, so that the tasks, their files
   and what they report to the driver follow ``ROWS_PER_RANGE``, not the length
   of a range. The range of each row is written with it, so a recomputed task
   finds the same ranges; no cut points come to the driver, however many keys
   there are;
3. running totals inside each (range, key), totals of those, exclusive running
   totals per key over its ranges, joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlane.operators._util import as_list
from fairlane.session import written

ROWS_PER_RANGE = 1_000_000
TASKS = 200                     # range partitions of a table of less than that many times ROWS_PER_RANGE rows


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are not kept."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def ordered_ranges(df: DataFrame, part, order: str, rows_per_range: int | None = None, stored: bool = False) -> tuple[DataFrame, bool]:
    """``df``, written (unless it is a ``stored`` table), with the number ``_b`` of its row's range, and whether there are several.

    Ranges ascend with ``order`` inside a key. Tables without a key of more
    than ``rows_per_range`` rows are one range.
    """
    part, most = as_list(part), rows_per_range or ROWS_PER_RANGE
    t = df if stored else written(df, "ordered")
    n = heaviest = t.count()                             # from the footers of what was just written
    if n > most and part:
        heaviest = t.groupBy(*part).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if heaviest <= most:
        return t.withColumn("_b", F.lit(0)), False
    ranges, tasks = -(-n // most), max(TASKS, -(-n // ROWS_PER_RANGE))
    if ranges <= tasks:
        t = t.repartitionByRange(ranges, *part, order).withColumn("_b", F.spark_partition_id())
        return written(t, "ranges"), True
    # partition number and place in the partition: the upper and the lower 33 bits of the id
    t = t.repartitionByRange(tasks, *part, order).sortWithinPartitions(*part, order).withColumn("_b", F.monotonically_increasing_id())
    place = F.col("_b").bitwiseAND(F.lit((1 << 33) - 1))
    return written(t.withColumn("_b", F.col("_b") - place + F.floor(place / most)), "ranges"), True


def ordered_prefix_sums(df: DataFrame, part, order: str, cols: list[str], descending: bool = False,
                        totals: bool = False, rows_per_range: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in ``order``) for each column,
    and with ``totals`` its sum over the key as ``tot_<c>``.

    ``order`` must be unique within ``part`` (aggregate first). Null keys are
    a key like any other.
    """
    part = as_list(part)
    t, several = ordered_ranges(df, part, order, rows_per_range)

    def by(c):
        return F.col(c).desc() if descending else F.col(c).asc()
    w = Window.partitionBy(*part, *(["_b"] if several else []))
    run = w.orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", *[F.sum(c).over(run).alias(f"_in_{c}") for c in cols],
                 *([F.sum(c).over(w).alias(f"_all_{c}") for c in cols] if totals and not several else []))
    if not several:
        return t.select(*df.columns, *[F.col(f"_in_{c}").alias(f"cum_{c}") for c in cols],
                        *([F.col(f"_all_{c}").alias(f"tot_{c}") for c in cols] if totals else []))
    sums = t.groupBy(*part, "_b").agg(*[F.sum(c).alias(f"_bt_{c}") for c in cols])
    before = Window.partitionBy(*part).orderBy(by("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    off = sums.select(*part, "_b", *[F.coalesce(F.sum(f"_bt_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in cols],
                      *[F.sum(f"_bt_{c}").over(whole).alias(f"tot_{c}") for c in cols if totals])
    j = null_safe_join(t, off, [*part, "_b"])
    return j.select(*df.columns, *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in cols],
                    *([f"tot_{c}" for c in cols] if totals else []))
