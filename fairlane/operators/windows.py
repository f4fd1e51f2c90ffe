"""Window operators.

Gap filling over a whole ordered partition is done in two levels so that one
hot partition key (a third of all rows) is not sorted and scanned by a single
task: if a key has very many rows, one global range partitioning by (key,
order) cuts it, fills are computed inside each (key, range), and the last /
first non-null value of the preceding / following ranges of the key is carried
over from a tiny per-range table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlane.operators._util import as_list, with_constants
from fairlane.operators.prefix import null_safe_join, ordered_ranges


def fill_gaps(df: DataFrame, cols, order_by: str, partition_by, rows_per_range: int | None = None,
              stored: bool = False) -> DataFrame:
    """Forward fill, then backward fill, within each partition key in
    ``order_by`` order (which must be unique within a key). The table is
    written once; if a key has more than ``rows_per_range`` rows, it is cut
    into ordered ranges of about that many. ``stored`` tells that ``df`` is
    a written table already."""
    cols = as_list(cols)
    part = as_list(partition_by)
    if not part:
        raise ValueError("fill_gaps needs a partition key (a whole-table window runs on one task)")
    t, several = ordered_ranges(df, part, order_by, rows_per_range, stored)
    o = F.col(order_by)
    w_f = Window.partitionBy(*part, "_b").orderBy(o.asc()).rowsBetween(Window.unboundedPreceding, 0)
    w_b = Window.partitionBy(*part, "_b").orderBy(o.desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", *[F.last(c, True).over(w_f).alias(f"_lf_{c}") for c in cols],
                 *[F.last(c, True).over(w_b).alias(f"_lb_{c}") for c in cols])
    if not several:
        return t.select(*[F.coalesce(f"_lf_{c}", f"_lb_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])
    # Last / first non-null value of each bucket, by order.
    bk = t.groupBy(*part, "_b").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(f"_bl_{c}") for c in cols],
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(f"_bf_{c}") for c in cols])
    w_prev = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    w_next = Window.partitionBy(*part).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carry = bk.select(*part, "_b", *[F.last(f"_bl_{c}", True).over(w_prev).alias(f"_cf_{c}") for c in cols],
                      *[F.first(f"_bf_{c}", True).over(w_next).alias(f"_cb_{c}") for c in cols])
    j = null_safe_join(t, carry, [*part, "_b"], "left")
    out = []
    for c in df.columns:
        if c in cols:
            ff = F.coalesce(F.col(f"_lf_{c}"), F.col(f"_cf_{c}"))
            bf = F.coalesce(F.col(f"_lb_{c}"), F.col(f"_cb_{c}"))
            out.append(F.coalesce(ff, bf).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def rank_importance(df: DataFrame, value: str = "importance", key: str = "feature", by=None) -> DataFrame:
    """Rank 1…n by descending value (ties by name) on a small result table."""
    w = Window.partitionBy(*as_list(by)).orderBy(F.col(value).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(w))


def top_k_per_key(df: DataFrame, key, order: Column | str, k: int, tie=None) -> DataFrame:
    """The ``k`` first rows per key. ``row_number() <= k`` is planned with a
    partial WindowGroupLimit before the shuffle, so each task sends at most k
    rows per key."""
    order_c = F.col(order).desc() if isinstance(order, str) else order
    ties = [F.col(t) for t in as_list(tie)]
    w = Window.partitionBy(*as_list(key)).orderBy(order_c, *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def share_of_total(df: DataFrame, value: str, by=None, out: str = "share") -> DataFrame:
    """Value / total of the value within the partition (on result tables)."""
    if not as_list(by):
        t, total = with_constants(df, F.sum(value))
        return t.withColumn(out, F.try_divide(F.col(value).cast("double"), F.lit(total)))
    w = Window.partitionBy(*as_list(by))
    return df.withColumn(out, F.try_divide(F.col(value).cast("double"), F.sum(value).over(w)))


def top_factors(df: DataFrame, contrib: str = "contributions", k: int = 3) -> DataFrame:
    """Per row, the k largest positive and k most negative contributions
    of an ``array<struct<feature, value>>`` column, plus the k largest by size.
    Row-local array functions: no shuffle."""
    arr = F.col(contrib)
    by_value = F.array_sort(arr, lambda a, b: F.when(a["value"] > b["value"], -1)
                            .when(a["value"] < b["value"], 1)
                            .otherwise(F.when(a["feature"] < b["feature"], -1)
                                       .when(a["feature"] > b["feature"], 1).otherwise(0)))
    by_size = F.array_sort(arr, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                           .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
                           .otherwise(F.when(a["feature"] < b["feature"], -1)
                                      .when(a["feature"] > b["feature"], 1).otherwise(0)))
    pos = F.slice(F.filter(by_value, lambda x: x["value"] > 0), 1, k)
    neg = F.slice(F.reverse(F.filter(by_value, lambda x: x["value"] < 0)), 1, k)
    return df.withColumn("top_positive", pos).withColumn("top_negative", neg) \
             .withColumn("top_by_size", F.slice(by_size, 1, k))
