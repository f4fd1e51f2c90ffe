"""Statistics.

Every test statistic is computed from a small grouped table (contingency
counts, counts per distinct value), never from a sort of all rows:

* χ² uses Σ o² / e − n over the OBSERVED cells only, so no cross product of
  the label sets is built;
* rank statistics (Mann-Whitney U, Kolmogorov-Smirnov) use counts per
  distinct value and the two-level prefix sum of :mod:`prefix`;
* mutual information uses quantile bins fitted in one aggregate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlane.operators._util import as_list, safe_div, with_constants
from fairlane.operators.prefix import ordered_prefix_sums
from fairlane.operators.quantiles import fitted_quantiles
from fairlane.session import written


# --- A17: chi-square ---------------------------------------------------------------

def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed cell counts with row and column totals (null keys left out)."""
    g = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    g, n = with_constants(g, F.sum("o"))
    return (g.withColumn("ra", F.sum("o").over(Window.partitionBy(a)))
             .withColumn("cb", F.sum("o").over(Window.partitionBy(b)))
             .withColumn("n", F.lit(n).cast("bigint")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """χ² statistic and degrees of freedom of the a × b table."""
    c = contingency(df, a, b)
    o = F.col("o").cast("double")
    e = F.col("ra").cast("double") * F.col("cb") / F.col("n")
    return c.agg((F.sum(o * o / e) - F.first("n")).alias("chi2"),
                 ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("dof"),
                 F.first("n").alias("n"))


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the χ² distribution (regularised upper incomplete gamma
    Q(k/2, x/2), series / continued fraction) – for the p-value of one statistic."""
    if x <= 0 or k <= 0:
        return 1.0
    s, z = k / 2.0, x / 2.0
    if z < s + 1:
        term = total = 1.0 / s
        n = s
        for _ in range(1000):
            n += 1
            term *= z / n
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-z + s * math.log(z) - math.lgamma(s)))
    b, c, d = z + 1 - s, 1e300, 1 / (z + 1 - s)
    h = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-z + s * math.log(z) - math.lgamma(s)) * h


def chi_square_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """A17 with the p-value of the one statistic: (chi2, dof, n, p_value); all null or 0 without rows."""
    r = chi_square(df, a, b).first()
    p = chi2_sf(r["chi2"], r["dof"]) if r["chi2"] is not None else None
    return df.sparkSession.createDataFrame([(r["chi2"], r["dof"], r["n"], p)], "chi2 double, dof long, n long, p_value double")


# --- A18: Mann-Whitney U -------------------------------------------------------------

def mann_whitney(df: DataFrame, value: str, group: str, first) -> DataFrame:
    """U of the ``first`` group against the rest, tie-averaged ranks,
    normal approximation z with the tie correction."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    is1 = (F.col(group) == F.lit(first)).cast("long")
    c = d.groupBy(value).agg(F.sum(is1).alias("c1"), F.count(F.lit(1)).alias("t"))
    c = ordered_prefix_sums(c, [], value, ["t"])
    avg_rank = F.col("cum_t") - F.col("t") + (F.col("t") + F.lit(1)) / F.lit(2.0)
    g = c.agg(F.sum(F.col("c1") * avg_rank).alias("r1"), F.sum("c1").alias("n1"), F.sum("t").alias("n"),
              F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + F.lit(1)) / F.lit(2.0)
    sigma = F.sqrt(n1 * n2 / F.lit(12.0) * ((n + F.lit(1)) - safe_div(F.col("ties"), n * (n - F.lit(1)))))
    z = safe_div(u - n1 * n2 / F.lit(2.0), sigma)
    return g.select(u.alias("u"), "n1", (F.col("n") - F.col("n1")).alias("n2"), z.alias("z"))


def mann_whitney_test(df: DataFrame, value: str, group: str, first) -> DataFrame:
    """A18 with the two-sided p-value of the normal approximation: (u, n1, n2, z, p_value)."""
    r = mann_whitney(df, value, group, first).first()
    p = math.erfc(abs(r["z"]) / math.sqrt(2.0)) if r["z"] is not None else None
    return df.sparkSession.createDataFrame([(*r, p)], "u double, n1 long, n2 long, z double, p_value double")


# --- A19 / A20: correlations -----------------------------------------------------------

def corr_with_target(df: DataFrame, cols, target: str) -> DataFrame:
    """Pearson correlation of each column with the target, one pass."""
    cols = as_list(cols)
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in cols]
    return row.select(F.inline(F.array(*cells)))


MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_moments(df: DataFrame, cols) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of every column pair i < j over the rows where both are known.

    One pass for all pairs: a task multiplies blocks of rows (values, squares
    and known marks as matrices) and sends one row per pair, which Spark adds
    up. Values are taken off their column's mean first, so that sums of
    squares keep their digits.
    """
    cols = as_list(cols)
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    first = numbers.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in numbers.columns]).first()
    mean = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in first])
    i, j = np.triu_indices(len(cols), 1)

    def gram(batches):
        n, s, q, p = (np.zeros((len(cols), len(cols))) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - mean
            known = (~np.isnan(x)).astype(float)
            x[known == 0] = 0.0
            n += known.T @ known
            s += x.T @ known
            q += (x * x).T @ known
            p += x.T @ x
        parts = (n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j])
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (i, j, *parts)], ["i", "j", *MOMENTS])

    sums = numbers.mapInArrow(gram, "i long, j long, " + ", ".join(f"{m} double" for m in MOMENTS))
    return sums.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def corr_pairs(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every column pair (upper triangle), one pass
    however many columns there are; null without two known rows or with a constant column."""
    cols = as_list(cols)
    n, sx, sy, sxx, syy, sxy = (F.col(m) for m in MOMENTS)
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    r = F.when((vx > 0) & (vy > 0), (sxy - sx * sy / n) / F.sqrt(vx * vy))
    names = F.array(*[F.lit(c) for c in cols])
    return pair_moments(df, cols).where("n > 0").select(
        F.element_at(names, (F.col("i") + 1).cast("int")).alias("a"), F.element_at(names, (F.col("j") + 1).cast("int")).alias("b"), r.alias("corr"))


def high_corr_pairs(df: DataFrame, cols, target: str, threshold: float = 0.95) -> DataFrame:
    """Pairs with |r| above the threshold and the member to drop (the
    one less correlated with the target; ties drop the later name). Features
    and target are correlated in the same pass."""
    cols = as_list(cols)
    every = written(corr_pairs(df, [*cols, target]), "correlations")
    p = every.where((F.col("b") != target) & (F.abs("corr") > F.lit(threshold)))
    rel = every.where(F.col("b") == target)
    ra = rel.select("a", F.abs("corr").alias("rel_a"))
    rb = rel.select(F.col("a").alias("b"), F.abs("corr").alias("rel_b"))
    j = p.join(ra, "a", "left").join(rb, "b", "left")
    drop = F.when(F.coalesce(F.col("rel_a"), F.lit(0.0)) < F.coalesce(F.col("rel_b"), F.lit(0.0)), F.col("a")) \
        .otherwise(F.col("b"))
    return j.select("a", "b", "corr", "rel_a", "rel_b", drop.alias("drop"))


# --- A41 / M23: mutual information ------------------------------------------------------

def quantile_edges(df: DataFrame, cols, n_bins: int = 10, approx: bool = False) -> dict[str, list[float]]:
    """Inner cut points of ``n_bins`` quantile bins per column (one aggregate)."""
    cols = as_list(cols)
    ps = [i / n_bins for i in range(1, n_bins)]
    if approx:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), ps, 10000).alias(c) for c in cols]).first().asDict()
    else:
        row = fitted_quantiles(df, cols, ps)
    return {c: sorted(set(float(v) for v in (row[c] or []))) for c in cols}


def _bin_expr(c: str, edges: list[float]):
    x = F.col(c).cast("double")
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < x))


def mutual_information(df: DataFrame, cols, target: str, n_bins: int = 10, edges: dict | None = None,
                       min_mi: float = 0.0) -> DataFrame:
    """Plug-in mutual information (nats) between each quantile-binned
    column and a discrete target: Σ p(x,y) ln(p(x,y) / (p(x) p(y))).
    Long form: one unpivot, one grouped count, windows on the small table."""
    cols = as_list(cols)
    edges = edges or quantile_edges(df, cols, n_bins)
    d = df.where(F.col(target).isNotNull())
    binned = d.select(F.col(target).cast("string").alias("_y"),
                      *[F.when(F.col(c).isNull(), F.lit(-1)).otherwise(_bin_expr(c, edges[c])).alias(c) for c in cols])
    long = binned.unpivot(["_y"], cols, "feature", "bin")
    g = long.groupBy("feature", "bin", "_y").agg(F.count(F.lit(1)).alias("nxy"))
    g = (g.withColumn("nx", F.sum("nxy").over(Window.partitionBy("feature", "bin")))
          .withColumn("ny", F.sum("nxy").over(Window.partitionBy("feature", "_y")))
          .withColumn("n", F.sum("nxy").over(Window.partitionBy("feature"))))
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy").cast("double") * F.col("n") / (F.col("nx").cast("double") * F.col("ny")))
    out = g.groupBy("feature").agg(F.sum(term).alias("mutual_information"))
    return out.withColumn("kept", F.col("mutual_information") >= F.lit(min_mi))


def decorrelate(df: DataFrame, cols, group: str, suffix: str = "") -> DataFrame:
    """Remove the group signal from each feature linearly: x − mean of x
    in the row's group + overall mean of x. One grouped pass (group × features,
    tiny), joined back; rows with a null group keep their value."""
    cols = as_list(cols)
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        *[F.avg(c).alias(f"_gm_{c}") for c in cols], *[F.count(c).alias(f"_gn_{c}") for c in cols])
    g, *means = with_constants(g, *[F.try_divide(F.sum(F.col(f"_gm_{c}") * F.col(f"_gn_{c}")), F.sum(f"_gn_{c}")) for c in cols])
    g = g.select(group, *[F.col(f"_gm_{c}") for c in cols], *[F.lit(m).cast("double").alias(f"_om_{c}") for c, m in zip(cols, means)])
    j = df.join(g, group, "left")
    out = {c + suffix: F.coalesce(F.col(c) - F.col(f"_gm_{c}") + F.col(f"_om_{c}"), F.col(c)) for c in cols}
    return j.withColumns(out).drop(*[f"_gm_{c}" for c in cols], *[f"_om_{c}" for c in cols])


def information_reduction(before: DataFrame, after: DataFrame, cols, group: str, n_bins: int = 10) -> DataFrame:
    """Mean mutual information of the features about the group, before
    and after, and the percent reduction (edges fitted on each table)."""
    b = mutual_information(before, cols, group, n_bins).agg(F.avg("mutual_information").alias("mi_before"))
    a = mutual_information(after, cols, group, n_bins).agg(F.avg("mutual_information")).scalar()
    j = b.withColumn("mi_after", a)
    return j.withColumn("reduction_pct", safe_div(F.col("mi_before") - F.col("mi_after"), F.col("mi_before")) * 100.0)


# --- X4: input drift ------------------------------------------------------------------------

def population_stability(base: DataFrame, current: DataFrame, cols, n_bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """PSI per feature over quantile bins of the baseline:
    Σ (c − b) · ln(c / b) with shares floored at ``eps``."""
    cols = as_list(cols)
    edges = quantile_edges(base, cols, n_bins)

    def shares(df, tag):
        b = df.select(*[F.when(F.col(c).isNull(), F.lit(-1)).otherwise(_bin_expr(c, edges[c])).alias(c) for c in cols])
        g = b.unpivot([], cols, "feature", "bin").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("k"))
        return g.select("feature", "bin", (F.col("k") / F.sum("k").over(Window.partitionBy("feature"))).alias(tag))
    j = shares(base, "pb").join(shares(current, "pc"), ["feature", "bin"], "full")
    pb = F.greatest(F.coalesce(F.col("pb"), F.lit(0.0)), F.lit(eps))
    pc = F.greatest(F.coalesce(F.col("pc"), F.lit(0.0)), F.lit(eps))
    out = j.groupBy("feature").agg(F.sum((pc - pb) * F.log(pc / pb)).alias("psi"))
    return out.withColumn("drift", F.when(F.col("psi") > 0.25, "major").when(F.col("psi") > 0.1, "moderate")
                          .otherwise("none"))


def ks_statistic(base: DataFrame, current: DataFrame, col: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance max |F_base − F_current|
    from counts per distinct value and the two-level prefix sum."""
    b = base.where(F.col(col).isNotNull()).select(F.col(col).alias("v"), F.lit(1).alias("_b"), F.lit(0).alias("_c"))
    c = current.where(F.col(col).isNotNull()).select(F.col(col).alias("v"), F.lit(0).alias("_b"), F.lit(1).alias("_c"))
    g = b.unionByName(c).groupBy("v").agg(F.sum("_b").alias("nb"), F.sum("_c").alias("nc"))
    j = ordered_prefix_sums(g, [], "v", ["nb", "nc"], totals=True)
    gap = F.abs(safe_div(F.col("cum_nb"), F.col("tot_nb")) - safe_div(F.col("cum_nc"), F.col("tot_nc")))
    return j.agg(F.max(gap).alias("ks"), F.max("tot_nb").alias("n_base"), F.max("tot_nc").alias("n_current"))


# --- A43: leakage report ---------------------------------------------------------------------

# Parts of names that the leakage report looks for.
OUTCOME_NAME_TERMS = ("action_taken", "denial_reason", "approved", "originated", "purchaser", "aus", "preapproval")
ID_NAME_TERMS = ("id", "lei", "respondent", "unnamed", "index")
TIME_NAME_TERMS = ("year", "date")


def leakage_report(df: DataFrame, label: str, splits: dict | None = None, key: str = "application_id",
                   corr_limit: float = 0.95, null_gap: float = 0.2) -> DataFrame:
    """Findings ``(check, column, value, flagged)``: outcome-, id- and
    time-like names (driver-side over the schema), |corr| with the label,
    constant columns, null-rate gap between the label classes, and rows
    shared between splits. Each data check is one aggregate pass."""
    from fairlane.operators.joins import split_overlap
    from fairlane.operators.profile import constant_columns
    spark = df.sparkSession
    schema = "check string, column string, value double, flagged boolean"
    rows = []
    for c in df.columns:
        if c == label:
            continue
        for check, terms in (("outcome_name", OUTCOME_NAME_TERMS), ("id_name", ID_NAME_TERMS),
                             ("time_name", TIME_NAME_TERMS)):
            if any(t in c.lower() for t in terms):
                rows.append((check, c, None, True))
    parts = [spark.createDataFrame(rows, schema)]
    num = [f.name for f in df.schema.fields if f.name != label
           and f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    if num:
        cw = corr_with_target(df, num, label)
        parts.append(cw.select(F.lit("label_corr").alias("check"), F.col("feature").alias("column"),
                               F.col("corr").alias("value"), (F.abs("corr") > F.lit(corr_limit)).alias("flagged")))
    cc = constant_columns(df, [c for c in df.columns if c != label])
    parts.append(cc.select(F.lit("constant").alias("check"), "column", F.lit(None).cast("double").alias("value"),
                           F.col("is_constant").alias("flagged")))
    y = F.col(label)
    others = [c for c in df.columns if c != label]
    row = df.agg(*[F.avg(F.when(y == 1, F.col(c).isNull().cast("double"))).alias(f"_a{i}") for i, c in enumerate(others)],
                 *[F.avg(F.when(y == 0, F.col(c).isNull().cast("double"))).alias(f"_b{i}") for i, c in enumerate(others)])
    gaps = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"),
                                                  F.abs(F.col(f"_a{i}") - F.col(f"_b{i}")).alias("value"))
                                         for i, c in enumerate(others)])))
    parts.append(gaps.select(F.lit("null_rate_by_label").alias("check"), "column", "value",
                             F.coalesce(F.col("value") > F.lit(null_gap), F.lit(False)).alias("flagged")))
    if splits:
        ov = split_overlap(splits, key)
        parts.append(ov.select(F.lit("split_overlap").alias("check"),
                               F.concat_ws("/", "left", "right").alias("column"),
                               F.col("shared").cast("double").alias("value"), (F.col("shared") > 0).alias("flagged")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
