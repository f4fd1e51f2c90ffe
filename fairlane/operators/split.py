"""Repeatable splits.

Rows are assigned by a hash of their key, never by row order or by a random
draw, so a lost executor that recomputes a partition puts every row in the
same split again, and DuckDB computes the same assignment.

* plain form: a 30-bit md5 bucket against the cumulative shares, any number of parts;
* stratified form: per label, cut points of the row hash at the cumulative
  shares (``percentile_approx`` – bounded memory per label, brought back as
  labels × 2 numbers and planted as literals), so each class is split in the
  same proportions without a rank window over all rows (which would run in
  one task);
* ordered form: the same cut on an order key (first 70 % train, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlane.sources.tables import hash_bucket

NAMES = ("train", "validation", "test")
BUCKETS = 1 << 30


def part_names(fractions, names=None) -> list[str]:
    """Names of the parts: the given ones, the usual three, or part_1, part_2, ..."""
    names = names or (NAMES if len(fractions) <= len(NAMES) else [f"part_{i + 1}" for i in range(len(fractions))])
    if len(names) < len(fractions):
        raise ValueError(f"{len(fractions)} parts need as many names, got {len(names)}")
    return list(names)


def _cum(fractions) -> list[float]:
    out, s = [], 0.0
    for f in fractions[:-1]:
        s += float(f)
        out.append(s)
    return out


def split_column(key: str = "application_id", fractions=(0.70, 0.15, 0.15), salt: str = "split",
                 names=None) -> Column:
    """M7 plain form: the split name from an md5 bucket of the key."""
    names = part_names(fractions, names)
    b = hash_bucket(salt, F.col(key), BUCKETS)
    expr = None
    for cut, name in zip(_cum(fractions), names):
        lim = F.lit(int(round(cut * BUCKETS)))
        expr = F.when(b < lim, F.lit(name)) if expr is None else expr.when(b < lim, F.lit(name))
    return expr.otherwise(F.lit(names[len(fractions) - 1]))


def stratified_split_column(df: DataFrame, label: str, key: str = "application_id",
                            fractions=(0.70, 0.15, 0.15), salt: str = "split", names=None,
                            accuracy: int = 100000) -> Column:
    """M7 stratified form: per-label hash cut points (one aggregate)."""
    names = part_names(fractions, names)
    h = hash_bucket(salt, F.col(key), BUCKETS).cast("double")
    cums = _cum(fractions)
    rows = (df.where(F.col(label).isNotNull())
            .groupBy(label).agg(F.percentile_approx(h, cums, accuracy).alias("_q")).collect())
    expr = None
    for r in rows:
        cond_lab = F.col(label) == F.lit(r[label])
        inner = None
        for q, name in zip(r["_q"], names):
            c = h <= F.lit(float(q))
            inner = F.when(c, F.lit(name)) if inner is None else inner.when(c, F.lit(name))
        inner = inner.otherwise(F.lit(names[len(fractions) - 1]))
        expr = F.when(cond_lab, inner) if expr is None else expr.when(cond_lab, inner)
    return expr if expr is not None else F.lit(None).cast("string")


def ordered_split_column(df: DataFrame, order_by: str, fractions=(0.70, 0.15, 0.15), names=None,
                         accuracy: int = 100000) -> Column:
    """M7 ordered form: cut points of the order key at the cumulative shares."""
    names = part_names(fractions, names)
    qs = df.agg(F.percentile_approx(F.col(order_by).cast("double"), _cum(fractions), accuracy)).first()[0]
    x = F.col(order_by).cast("double")
    expr = None
    for q, name in zip(qs, names):
        expr = F.when(x <= F.lit(float(q)), F.lit(name)) if expr is None else expr.when(x <= F.lit(float(q)), F.lit(name))
    return expr.otherwise(F.lit(names[len(fractions) - 1]))


def split(df: DataFrame, key: str = "application_id", fractions=(0.70, 0.15, 0.15), stratify: str | None = None,
          salt: str = "split", out: str = "split") -> DataFrame:
    """M7: add the split name; callers select each part with ``where``."""
    col = (stratified_split_column(df, stratify, key, fractions, salt) if stratify
           else split_column(key, fractions, salt))
    return df.withColumn(out, col)


def split_shares(df: DataFrame, split_col: str = "split", label: str | None = None) -> DataFrame:
    """Rows and share per split (and label rate per split)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if label:
        aggs.append(F.avg(label).alias("label_rate"))
    g = df.groupBy(split_col).agg(*aggs)
    return g.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))
