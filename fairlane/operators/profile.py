"""Data-quality profiling.

Per-column statistics are computed as ONE wide aggregate where the statistic
is algebraic (counts, min / max, sums), and through a long ``unpivot`` form
where it needs distinct values, which avoids Spark's Expand of many
``count(DISTINCT)`` aggregates. ``exact=False`` switches distinct counts to
HyperLogLog for very wide or very large tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlane.operators._util import as_list, numeric_columns, string_columns
from fairlane.operators.quantiles import exact_quantiles
from fairlane.operators.columns import RANGE_RULES


def _type_name(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _long_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value")


def distinct_counts(df: DataFrame, cols=None, dropna: bool = True, exact: bool = True) -> DataFrame:
    """Distinct values per column: ``(column, n_distinct)``.

    Exact form: each value goes as its column's number and 128 hash bits of
    the value in its own type, distinct pairs are counted per column (two
    different values of a column meet with a chance of 2^-128). With
    ``dropna=False`` a null counts as one more value (pandas
    ``nunique(dropna=False)``).
    """
    cols = as_list(cols) or df.columns
    if not exact:
        row = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in cols]
                     + [F.max(F.col(f"`{c}`").isNull().cast("int")).alias(f"_null_{c}") for c in cols])
        cells = [F.struct(F.lit(c).alias("column"),
                          (F.col(c) + (F.lit(0) if dropna else F.coalesce(F.col(f"_null_{c}"), F.lit(0))))
                          .cast("bigint").alias("n_distinct")) for c in cols]
        return row.select(F.inline(F.array(*cells)))

    def cell(i, c):
        known = F.col(f"`{c}`").isNotNull()
        return F.struct(F.lit(i).alias("i"), F.when(known, F.xxhash64(f"`{c}`")).alias("h"),
                        F.when(known, F.xxhash64(F.lit("second"), f"`{c}`")).alias("g"))
    d = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(cols)]))).distinct()
    n = (F.count("h") if dropna else F.count(F.lit(1))).alias("n_distinct")
    return d.groupBy("i").agg(n).select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1).alias("column"), "n_distinct")


def null_profile(df: DataFrame, cols=None, limit: float = 0.4, exact: bool = True) -> DataFrame:
    """A5: null count and share, distinct count (non-null), type, and whether
    the share is over ``limit``."""
    cols = as_list(cols) or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_nn{i}")
                                                  for i, c in enumerate(cols)])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(_type_name(df, c)).alias("dtype"),
                      (F.col("_n") - F.col(f"_nn{i}")).alias("null_count"),
                      (F.try_divide((F.col("_n") - F.col(f"_nn{i}")).cast("double"), F.col("_n")) * F.lit(100.0)).alias("null_pct"))
             for i, c in enumerate(cols)]
    nulls = row.select(F.inline(F.array(*cells)))
    out = nulls.join(distinct_counts(df, cols, True, exact), "column", "left")
    return out.select("column", "dtype", "null_count", "null_pct",
                      F.coalesce(F.col("n_distinct"), F.lit(0)).cast("bigint").alias("n_distinct"),
                      (F.col("null_pct") > F.lit(limit * 100.0)).alias("over_limit"))


def completeness(df: DataFrame, cols) -> DataFrame:
    """Complete / missing / complete % for key columns (present ones)."""
    cols = [c for c in as_list(cols) if c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("complete"),
                      (F.col("_n") - F.col(f"_c{i}")).alias("missing"),
                      (F.try_divide(F.col(f"_c{i}").cast("double"), F.col("_n")) * F.lit(100.0)).alias("complete_pct"))
             for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*cells)))


def cardinality_classes(df: DataFrame, cols=None, low: int = 10, high: int = 50, exact: bool = True) -> DataFrame:
    """Distinct values (null counted as a value), class low ≤ 10 < medium ≤ 50 < high."""
    cols = as_list(cols) or string_columns(df)
    d = distinct_counts(df, cols, dropna=False, exact=exact)
    n = F.col("n_distinct")
    return d.select("column", "n_distinct",
                    F.when(n > high, "high").when(n > low, "medium").otherwise("low").alias("cardinality"))


def describe_numeric(df: DataFrame, cols=None, by: str | None = None, approx: bool = False) -> DataFrame:
    """A8 numeric: count, mean, std (n−1), min, quartiles, max per column
    (and per group with ``by``); long form, one aggregate pass."""
    cols = as_list(cols) or [c for c in numeric_columns(df) if c != by]
    keys = [by] if by else []
    long = (df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot(keys, cols, "column", "value"))
    if by:
        long = long.where(F.col(by).isNotNull())
    ps = [0.25, 0.5, 0.75]
    g = long.groupBy(*keys, "column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), *([F.percentile_approx("value", ps, 10000).alias("_q")] if approx else []))
    if not approx:
        g = g.join(exact_quantiles(long, [*keys, "column"], "value", ps, "_q"), [*keys, "column"], "left")
    return g.select(*keys, "column", "count", "mean", "std", "min",
                    F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")


def describe_text(df: DataFrame, cols=None) -> DataFrame:
    """A8 text: count, unique, top (most frequent, smallest on ties), freq.

    Grouped steps only: value counts, the top frequency per column, and the
    smallest value having it – no per-column sort of all distinct values.
    """
    cols = as_list(cols) or string_columns(df)
    long = _long_strings(df, cols).where(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq"))
    stats = vc.groupBy("column").agg(F.sum("freq").alias("count"), F.count(F.lit(1)).alias("unique"),
                                     F.max("freq").alias("freq"))
    top = (vc.join(stats.select("column", "freq"), ["column", "freq"])
           .groupBy("column").agg(F.min("value").alias("top")))
    return stats.join(top, "column").select("column", "count", "unique", "top", "freq")


def duplicate_rows(df: DataFrame, cols=None) -> DataFrame:
    """Number and share of exact repeats (nulls equal, as in pandas)."""
    cols = as_list(cols) or df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_k"))
    return g.agg(F.sum("_k").alias("rows"), F.sum(F.col("_k") - 1).alias("duplicates")).select(
        "rows", "duplicates", (F.col("duplicates") / F.col("rows") * F.lit(100.0)).alias("duplicate_pct"))


def range_check(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Below-min and above-max counts per rule (one pass), and a fault flag."""
    rules = {c: r for c, r in (rules or RANGE_RULES).items() if c in df.columns}
    aggs = []
    for i, (c, (lo, hi)) in enumerate(rules.items()):
        x = F.col(c).cast("double")
        aggs += [F.count_if(x < F.lit(float(lo))).alias(f"_b{i}"), F.count_if(x > F.lit(float(hi))).alias(f"_a{i}")]
    row = df.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(float(lo)).alias("min"), F.lit(float(hi)).alias("max"),
                      F.col(f"_b{i}").alias("below_min"), F.col(f"_a{i}").alias("above_max"))
             for i, (c, (lo, hi)) in enumerate(rules.items())]
    out = row.select(F.inline(F.array(*cells)))
    return out.withColumn("at_fault", (F.col("below_min") > 0) | (F.col("above_max") > 0))


def class_balance(df: DataFrame, label: str = "target", high: float = 2.0, low: float = 0.5) -> DataFrame:
    """Counts of 1 / 0 / null, shares, rate, imbalance ratio and a verdict."""
    y = F.col(label)
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(y == 1).alias("approved"),
                 F.count_if(y == 0).alias("denied"), F.count_if(y.isNull()).alias("excluded"))
    ratio = F.try_divide(F.col("approved").cast("double"), F.col("denied"))
    verdict = (F.when(ratio.isNull(), "undefined").when(ratio > high, "imbalanced")
               .when(ratio < low, "reverse imbalance").otherwise("acceptable"))
    return row.select("rows", "approved", "denied", "excluded",
                      (F.try_divide(F.col("approved").cast("double"), F.col("rows")) * 100.0).alias("approved_pct"),
                      (F.try_divide(F.col("denied").cast("double"), F.col("rows")) * 100.0).alias("denied_pct"),
                      (F.try_divide(F.col("excluded").cast("double"), F.col("rows")) * 100.0).alias("excluded_pct"),
                      F.try_divide(F.col("approved") * 100.0, F.col("approved") + F.col("denied")).alias("approval_rate_pct"),
                      ratio.alias("imbalance_ratio"), verdict.alias("verdict"))


def quality_report(df: DataFrame, rules: dict | None = None, limit: float = 0.4) -> DataFrame:
    """Rows, columns, sparse columns, duplicate rows, columns at fault –
    one row from two passes: one aggregate for nulls and ranges, one for repeats."""
    rules = {c: r for c, r in (rules or RANGE_RULES).items() if c in df.columns}
    n, x = F.count(F.lit(1)), (lambda c: F.col(c).cast("double"))
    sparse = [(F.try_divide((n - F.count(F.col(f"`{c}`"))).cast("double"), n) > limit) for c in df.columns]
    faulty = [F.count_if((x(c) < float(lo)) | (x(c) > float(hi))) > 0 for c, (lo, hi) in rules.items()]
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"_{i}") for i, c in enumerate([*sparse, *faulty])]).first()
    marks = list(row)
    return duplicate_rows(df).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(sum(marks[:len(sparse)])).cast("bigint").alias("sparse_columns"),
        "duplicates", F.lit(sum(marks[len(sparse):])).cast("bigint").alias("faulty_columns"))


def constant_columns(df: DataFrame, cols=None) -> DataFrame:
    """Columns with at most one distinct non-null value (``min = max``, or all null)."""
    cols = as_list(cols) or df.columns
    row = df.agg(*[F.min(F.col(f"`{c}`")).alias(f"_mn{i}") for i, c in enumerate(cols)],
                 *[F.max(F.col(f"`{c}`")).alias(f"_mx{i}") for i, c in enumerate(cols)])
    cells = [F.struct(F.lit(c).alias("column"),
                      (F.col(f"_mn{i}").isNull() | (F.col(f"_mn{i}") == F.col(f"_mx{i}"))).alias("is_constant"))
             for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*cells)))


def nonfinite_profile(df: DataFrame, cols=None) -> DataFrame:
    """Null, NaN and infinite counts per numeric column."""
    cols = as_list(cols) or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count_if(x.isNull()).alias(f"_n{i}"), F.count_if(F.isnan(x)).alias(f"_nan{i}"),
                 F.count_if(x == F.lit(float("inf"))).alias(f"_pi{i}"),
                 F.count_if(x == F.lit(float("-inf"))).alias(f"_ni{i}")]
    row = df.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("nulls"), F.col(f"_nan{i}").alias("nans"),
                      (F.col(f"_pi{i}") + F.col(f"_ni{i}")).alias("infinites")) for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*cells)))


__all__ = ["distinct_counts", "null_profile", "completeness", "cardinality_classes", "describe_numeric",
           "describe_text", "duplicate_rows", "range_check", "class_balance", "quality_report",
           "constant_columns", "nonfinite_profile", "Window", "T"]
