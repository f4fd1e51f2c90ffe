"""Exact quantiles without a task that holds a whole group.

``percentile`` ends each group in one task that keeps all its distinct values.
Here the values are counted per group first (map-side combined), ordered
prefix sums over the counts give each value's ranks, and the two neighbours of
each wanted rank are picked by an aggregate and interpolated linearly, as
pandas does. Several value columns are counted in one pass in long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlane.operators._util import as_list
from fairlane.operators.prefix import ordered_prefix_sums


def exact_quantiles(df: DataFrame, by, value: str, ps: list[float], out: str = "quantiles") -> DataFrame:
    """(by..., out): for each group an array of the quantiles ``ps`` of the non-null values.

    A group without values has nulls. Without ``by`` there is one row.
    """
    by = as_list(by)
    v = F.col(value).cast("double")
    counts = df.groupBy(*by, v.alias("_v")).agg(F.count(v).alias("_c"))     # the row of a group's nulls counts 0
    ranked = ordered_prefix_sums(counts, by, "_v", ["_c"], totals=True)
    picks = []
    for i, p in enumerate(ps):
        at = F.lit(float(p)) * (F.col("tot__c") - 1)
        for name, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("cum__c") - F.col("_c") <= k) & (k < F.col("cum__c"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_f{i}"))
    got = ranked.groupBy(*by).agg(*picks)
    lo, hi, f = (lambda i: F.col(f"_lo{i}")), (lambda i: F.col(f"_hi{i}")), (lambda i: F.col(f"_f{i}"))
    return got.select(*by, F.array(*[lo(i) + (hi(i) - lo(i)) * f(i) for i in range(len(ps))]).alias(out))


def column_quantiles(df: DataFrame, cols, ps: list[float], by=None) -> DataFrame:
    """(by..., column, quantiles) of several columns from one count of their values."""
    by, cols = as_list(by), as_list(cols)
    long = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(by, cols, "column", "value")
    return exact_quantiles(long, [*by, "column"], "value", ps)


def fitted_quantiles(df: DataFrame, cols, ps: list[float]) -> dict[str, list[float]]:
    """The quantiles of each column as constants of a fit; an empty list for a column without values."""
    rows = {r["column"]: r["quantiles"] for r in column_quantiles(df, cols, ps).collect()}
    return {c: [float(v) for v in rows.get(c) or [] if v is not None] for c in as_list(cols)}
