"""Segment analysis: rates by group, profiles, value counts, medians, grids,
histograms, intersectional rates and proxy strength (SURVEY §2.4 A1-A4,
A10-A12, A16, A44, A47, A48).

All of these are one grouped pass with map-side partial aggregation, so a hot
key (a third of all rows in one group) is reduced to one partial row per task
before the shuffle. Totals that a result needs (overall rate, shares) are taken
from the grouped rows, written once, as constants: never by re-reading the
input, and without a window that would end in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlane.operators._util import as_list, drop_null_keys, median, not_null_all, quantiles as _q, safe_div, with_constants
from fairlane.operators.quantiles import column_quantiles, exact_quantiles


def _all():
    return Window.partitionBy()


def rate_by(df: DataFrame, keys, label: str = "target", min_count: int = 0,
            keep_null: bool = False) -> DataFrame:
    """A1 / A3: labelled count, approved, denied, rate and percent per group.

    Rows with a null label are not counted (``count(label)``), rows with a
    null key form no group unless ``keep_null``; groups below ``min_count``
    labelled rows are left out (A3).
    """
    keys = as_list(keys)
    out = (drop_null_keys(df, keys, keep_null)
           .groupBy(*keys)
           .agg(F.count(label).alias("n"),
                F.sum(label).cast("bigint").alias("approved"),
                F.avg(label).alias("rate")))
    out = out.select(*keys, "n", "approved", (F.col("n") - F.col("approved")).alias("denied"),
                     "rate", (F.col("rate") * F.lit(100.0)).alias("rate_pct"))
    if min_count:
        out = out.where(F.col("n") >= F.lit(min_count))
    return out


def flag_rate_gap(df: DataFrame, key: str, label: str = "target", points: float = 5.0,
                  min_count: int = 0) -> DataFrame:
    """A2: groups whose rate is more than ``points`` percentage points off the
    overall rate of all labelled rows (null-key rows count in the overall)."""
    g = (df.groupBy(key)
         .agg(F.count(label).alias("n"), F.sum(label).cast("bigint").alias("approved")))
    g, total, approved = with_constants(g, F.sum("n"), F.sum("approved"))
    g = g.where(F.col(key).isNotNull() & (F.col("n") > 0))
    rate_pct = F.col("approved") / F.col("n") * F.lit(100.0)
    overall = F.lit(approved) / F.lit(total) * F.lit(100.0)
    out = g.select(key, "n", rate_pct.alias("rate_pct"), overall.alias("overall_pct"),
                   (rate_pct - overall).alias("diff_pct"))
    if min_count:
        out = out.where(F.col("n") >= min_count)
    return out.where(F.abs(F.col("diff_pct")) > F.lit(float(points)))


def segment_profile(df: DataFrame, key: str, label: str = "target", income: str = "income",
                    amount: str = "loan_amount", approx: bool = False) -> DataFrame:
    """A4: applications, approved, rate, median income and amount, market share."""
    d = drop_null_keys(df, [key])
    g = d.groupBy(key).agg(F.count(label).alias("applications"), F.sum(label).cast("bigint").alias("approved"),
                           F.avg(label).alias("approval_rate"),
                           *([median(income, True).alias("median_income"), median(amount, True).alias("median_amount")] if approx else []))
    if not approx:
        q = column_quantiles(d, [income, amount], [0.5], key).groupBy(key).agg(
            *[F.max(F.when(F.col("column") == value, F.col("quantiles")[0])).alias(name)
              for value, name in ((income, "median_income"), (amount, "median_amount"))])
        g = g.join(q, key, "left")
    g, total = with_constants(g, F.sum("applications"))
    return g.withColumn("market_share_pct", F.col("applications") / F.lit(total) * F.lit(100.0))


def disparate_impact_overall(df: DataFrame, key: str, label: str = "target",
                             limit: float = 0.8) -> DataFrame:
    """A27 (overall-rate form): group rate / overall rate, pass at ``limit``."""
    g, total, approved = with_constants(df.groupBy(key).agg(F.count(label).alias("n"), F.sum(label).alias("s")), F.sum("n"), F.sum("s"))
    g = g.where(F.col(key).isNotNull())
    rate = safe_div(F.col("s"), F.col("n"))
    overall = safe_div(F.lit(approved), F.lit(total))
    ratio = F.when(overall > 0, rate / overall).otherwise(F.lit(0.0))
    return g.select(key, "n", rate.alias("rate"), overall.alias("overall_rate"),
                    ratio.alias("impact_ratio"), (ratio >= F.lit(limit)).alias("passes"))


def value_counts(df: DataFrame, col: str, normalize: bool = True, dropna: bool = True) -> DataFrame:
    """A10: frequency and share of each value; ``dropna`` as in pandas."""
    d = df.where(F.col(col).isNotNull()) if dropna else df
    g = d.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        g, total = with_constants(g, F.sum("count"))
        g = g.withColumn("share", F.col("count") / F.lit(total))
    return g


def median_by(df: DataFrame, value: str, by: str, approx: bool = False) -> DataFrame:
    """Median of ``value`` per group, and the gap between the largest and
    smallest group median."""
    d = drop_null_keys(df, [by])
    if approx:
        g = d.groupBy(by).agg(median(value, True).alias("median"))
        return g.withColumn("gap", g.agg(F.max("median") - F.min("median")).scalar())
    g = exact_quantiles(d, by, value, [0.5], "median").withColumn("median", F.col("median")[0])
    g, gap = with_constants(g, F.max("median") - F.min("median"))
    return g.withColumn("gap", F.lit(gap).cast("double"))


def quantile_table(df: DataFrame, col: str, ps=(0.25, 0.33, 0.67, 0.75, 0.99),
                   approx: bool = False) -> DataFrame:
    """One row per requested probability (linear interpolation)."""
    ps = [float(p) for p in ps]
    row = df.agg(_q(col, ps, True).alias("_v")) if approx else exact_quantiles(df, [], col, ps, "_v")
    return row.select(F.posexplode("_v").alias("_i", "value")).select(
        F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("_i") + 1).alias("p"), "value")


def rate_grid(df: DataFrame, row: str, col: str, col_labels: list[str], label: str = "target") -> DataFrame:
    """2-D rate and count grid; the label list is given so the pivot runs
    no extra job to find values; missing cells give rate null and count 0."""
    g = (drop_null_keys(df, [row, col]).groupBy(row).pivot(col, list(col_labels))
         .agg(F.avg(label).alias("rate"), F.count(label).alias("n")))
    cols = [F.col(row)]
    for lab in col_labels:
        cols.append(F.col(f"`{lab}_rate`").alias(f"rate_{lab}"))
        cols.append(F.coalesce(F.col(f"`{lab}_n`"), F.lit(0)).cast("bigint").alias(f"n_{lab}"))
    return g.select(*cols)


def histogram(df: DataFrame, col: str, bins: int, lo: float | Column | None = None,
              hi: float | Column | None = None, by: str | None = None) -> DataFrame:
    """Equal-width bin counts (numpy convention: last bin closed on the
    right). ``lo``/``hi`` default to the data range, taken as scalar sub-queries."""
    x = F.col(col)
    if lo is None or hi is None:
        rng = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
        lo_c = rng.select("lo").scalar() if lo is None else F.lit(float(lo))
        hi_c = rng.select("hi").scalar() if hi is None else F.lit(float(hi))
    else:
        lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
    width = (hi_c - lo_c) / F.lit(float(bins))
    b = F.least(F.floor(safe_div(x - lo_c, width)), F.lit(bins - 1)).cast("int")
    keys = ([by] if by else [])
    d = df.where(x.isNotNull() & (x >= lo_c) & (x <= hi_c))
    d = drop_null_keys(d, keys)
    g = d.groupBy(*keys, F.coalesce(b, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return g.select(*keys, "bin", (lo_c + F.col("bin") * width).alias("bin_lo"),
                    (lo_c + (F.col("bin") + 1) * width).alias("bin_hi"), "count")


def intersectional_rates(df: DataFrame, attrs: list[str], label: str = "target",
                         min_count: int = 0) -> DataFrame:
    """Rates for every combination of the attributes (``cube``), with
    the level (``grouping_id``) and the gap to the overall rate."""
    d = df.where(not_null_all(attrs))
    g = d.cube(*attrs).agg(F.grouping_id().alias("level"), F.count(label).alias("n"),
                           F.avg(label).alias("rate"))
    full = (1 << len(attrs)) - 1
    overall = F.max(F.when(F.col("level") == full, F.col("rate"))).over(_all())
    g = g.withColumn("gap", F.col("rate") - overall)
    if min_count:
        g = g.where(F.col("n") >= min_count)
    return g


def proxy_correlation(df: DataFrame, features: list[str], group: str, alarm: float = 0.5) -> DataFrame:
    """Correlation ratio (eta) of each numeric feature with a protected
    group: sqrt(between-group sum of squares / total sum of squares).

    Long form: one ``unpivot`` (Expand) and two small grouped steps; the
    within-group part uses population variances, so no Σx² cancellation.
    """
    long = (df.where(F.col(group).isNotNull())
            .select(group, *[F.col(c).cast("double").alias(c) for c in features])
            .unpivot([group], features, "feature", "value")
            .where(F.col("value").isNotNull()))
    g = long.groupBy("feature", group).agg(F.count("value").alias("n"), F.avg("value").alias("m"),
                                           F.var_pop("value").alias("v"))
    w = Window.partitionBy("feature")
    g = g.withColumn("_mean", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    out = g.groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("_mean")) ** 2).alias("ss_between"),
        F.sum(F.col("n") * F.col("v")).alias("ss_within"))
    eta = F.sqrt(safe_div(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")))
    return out.select("feature", eta.alias("eta"), (eta > F.lit(alarm)).alias("alarm"))
