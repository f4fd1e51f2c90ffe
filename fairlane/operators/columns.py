"""Projection, coercion, labelling and row filters.

Column-set decisions (sparse, wide, constant columns) run ONE wide aggregate,
bring back one small row of statistics and turn it into a column list on the
driver; the data itself never leaves the executors. Row filters are plain
``where`` clauses so Catalyst pushes them into the Parquet scan.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlane.operators._util import as_list, not_null_all, string_columns
from fairlane.operators.quantiles import fitted_quantiles

# Outcome text (lower case) → label; 1 = decision to lend,
# 0 = denial, null = not an underwriting decision.
OUTCOME_LABELS = {
    "loan originated": 1,
    "application approved but not accepted": 1,
    "purchased loan": 1,
    "application denied": 0,
    "application withdrawn by applicant": None,
    "file closed for incompleteness": None,
    "preapproval request denied": None,
    "preapproval request approved but not accepted": None,
}

# Outlier caps (keep 0 < x <= cap), in the order applied.
OUTLIER_CAPS = {"loan_amount": 3_000_000.0, "income": 500_000.0, "property_value": 5_000_000.0}

# Range rules (min, max) for the validity check.
RANGE_RULES = {
    "income": (0.0, 1_000_000.0),
    "loan_amount": (0.0, 100_000_000.0),
    "property_value": (0.0, 200_000_000.0),
    "interest_rate": (0.0, 20.0),
    "loan_term": (0.0, 480.0),
}

# Parts of names of columns that must not be model inputs, and the columns kept in spite of one.
PROTECTED_TERMS = ("race", "ethnicity", "sex", "gender", "minority", "hispanic", "applicant_sex")
ID_TERMS = ("id", "lei", "respondent", "activity_year", "census_tract", "tract_population")
OUTCOME_TERMS = ("action_taken", "denial_reason", "denial", "aus_result")
KEPT_FEATURES = ("has_coborrower", "application_type")


def standardize_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().lower())


def standardize_columns(df: DataFrame) -> DataFrame:
    """Lower case, trim, blanks to ``_`` (a rename, no data movement)."""
    return df.toDF(*[standardize_name(c) for c in df.columns])


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns with equal names (rename by position)."""
    tmp = [f"_c{i}" for i in range(len(df.columns))]
    seen, keep = set(), []
    for i, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            keep.append(F.col(tmp[i]).alias(c))
    return df.toDF(*tmp).select(*keep)


def coerce_numeric(df: DataFrame, cols, strip_commas: bool = False) -> DataFrame:
    """Text to double; unparseable values become null (ANSI-safe ``try_cast``)."""
    out = df
    for c in as_list(cols):
        src = F.col(c).cast("string")
        if strip_commas:
            src = F.regexp_replace(src, ",", "")
        out = out.withColumn(c, src.try_cast("double"))
    return out


def numeric_like_columns(df: DataFrame, min_ratio: float = 1.0, cols=None) -> DataFrame:
    """Share of non-null values of each text column that parse as numbers
    after removing commas (all rows, not one sample); ``numeric_like`` when the
    share reaches ``min_ratio``."""
    cols = as_list(cols) or string_columns(df)
    long = df.select(*cols).unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
    parsed = F.regexp_replace(F.col("value"), ",", "").try_cast("double").isNotNull()
    g = long.groupBy("column").agg(F.avg(parsed.cast("double")).alias("parse_share"))
    return g.withColumn("numeric_like", F.col("parse_share") >= F.lit(float(min_ratio)))


def outcome_label(col: str | Column, mapping: dict | None = None) -> Column:
    """The label expression of P5: ``CASE lower(col) ...``; unknown → null."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    expr = None
    for text, lab in (mapping or OUTCOME_LABELS).items():
        if lab is None:
            continue
        expr = F.when(c == text, F.lit(int(lab))) if expr is None else expr.when(c == text, F.lit(int(lab)))
    return expr if expr is not None else F.lit(None).cast("int")


def derive_label(df: DataFrame, col: str = "action_taken", out: str = "target",
                 mapping: dict | None = None) -> DataFrame:
    """P5: outcome text → 1 / 0 / null."""
    return df.withColumn(out, outcome_label(col, mapping))


def keep_labelled(df: DataFrame, label: str = "target") -> DataFrame:
    """Rows with a label."""
    return df.where(F.col(label).isNotNull())


def filter_equals(df: DataFrame, conditions: dict) -> DataFrame:
    """``col == value`` for every pair (skipped when the column is absent)."""
    out = df
    for c, v in conditions.items():
        if c in df.columns:
            out = out.where(F.col(c) == F.lit(v))
    return out


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """Value in list."""
    return df.where(F.col(col).isin(list(values)))


def exclude_values(df: DataFrame, cols, values) -> DataFrame:
    """Drop rows whose value in any of ``cols`` is null or uninformative."""
    cond = F.lit(True)
    for c in as_list(cols):
        cond = cond & F.col(c).isNotNull() & ~F.col(c).isin(list(values))
    return df.where(cond)


def _cap_condition(c: str, cap: float) -> Column:
    x = F.col(c).cast("double")
    return (x > 0) & (x <= F.lit(float(cap)))


def clip_outlier_rows(df: DataFrame, caps: dict | None = None) -> DataFrame:
    """Keep ``0 < x <= cap`` for each capped column present."""
    caps = caps or OUTLIER_CAPS
    cond = F.lit(True)
    for c, cap in caps.items():
        if c in df.columns:
            cond = cond & _cap_condition(c, cap)
    return df.where(cond)


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """P17 (and the per-rule counts of P9): rows before / after / retained %
    for each cumulative step, from ONE pass of ``count_if`` aggregates."""
    cum = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("_s0")]
    for i, (_, cond) in enumerate(steps, start=1):
        cum = cum & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(cum).alias(f"_s{i}"))
    row = df.agg(*aggs)
    cells = [F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"),
                      F.col(f"_s{i - 1}").alias("rows_before"), F.col(f"_s{i}").alias("rows_after"))
             for i, (name, _) in enumerate(steps, start=1)]
    out = row.select(F.inline(F.array(*cells)))
    return out.select("step_no", "step", "rows_before", "rows_after",
                      (F.col("rows_before") - F.col("rows_after")).alias("removed"),
                      F.try_divide(F.col("rows_after") * F.lit(100.0), F.col("rows_before")).alias("retained_pct"))


def outlier_funnel(df: DataFrame, caps: dict | None = None) -> DataFrame:
    """P9 counts: rows removed by each cap rule in order."""
    caps = caps or OUTLIER_CAPS
    return funnel(df, [(c, _cap_condition(c, cap)) for c, cap in caps.items() if c in df.columns])


def drop_null_rows(df: DataFrame, subset) -> DataFrame:
    """P10: drop rows with a null in any critical column present."""
    subset = [c for c in as_list(subset) if c in df.columns]
    return df.dropna(subset=subset) if subset else df


def null_shares(df: DataFrame, cols=None) -> DataFrame:
    """Null share of each column in one wide aggregate, as long rows."""
    cols = as_list(cols) or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_nn{i}")
                                                  for i, c in enumerate(cols)])
    cells = [F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(f"_nn{i}")).alias("null_count"),
                      F.try_divide((F.col("_n") - F.col(f"_nn{i}")).cast("double"), F.col("_n")).alias("null_share"))
             for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*cells)))


def sparse_column_plan(df: DataFrame, threshold: float = 0.4, keep=()) -> DataFrame:
    """P11 decision table: null share per column and whether it is dropped."""
    keep = list(keep)
    s = null_shares(df)
    return s.withColumn("dropped", (F.col("null_share") > F.lit(float(threshold))) & ~F.col("column").isin(keep))


def drop_sparse_columns(df: DataFrame, threshold: float = 0.4, keep=()) -> DataFrame:
    """Drop columns with null share above ``threshold`` except ``keep``
    (one aggregate action; the list comes back, the data does not)."""
    rows = sparse_column_plan(df, threshold, keep).where("dropped").select("column").collect()
    return df.drop(*[r["column"] for r in rows])


def select_features(df: DataFrame, exclude_terms=PROTECTED_TERMS + ID_TERMS + OUTCOME_TERMS,
                    keep=KEPT_FEATURES, numeric_only: bool = False, label: str = "target") -> DataFrame:
    """Leave out the label and columns whose lower-case name contains a
    protected, id or outcome term anywhere, except ``keep``."""
    cols = []
    for f in df.schema.fields:
        hit = any(t in f.name.lower() for t in exclude_terms)
        if f.name in keep or not hit and f.name != label:
            if not numeric_only or isinstance(f.dataType, T.NumericType):
                cols.append(f.name)
    return df.select(*cols)


def wide_category_plan(df: DataFrame, limit: int = 50, cols=None) -> DataFrame:
    """P13 decision table (column, n_distinct, dropped): non-null labels per
    text column, exact up to ``limit``; any more are given as ``limit`` + 1.

    A saturating count: a task keeps at most ``limit`` + 1 labels of a column
    and sends no more than these, so a column of any width costs a few rows a
    task, and a column within the limit sends every label it has.
    """
    cols = as_list(cols) or string_columns(df)

    def few(batches):
        seen = {c: pa.array([], pa.string()) for c in cols}
        for batch in batches:
            for c in cols:
                if len(seen[c]) <= limit:
                    labels = pc.drop_null(pc.unique(batch.column(c))).cast(pa.string())
                    seen[c] = pc.unique(pa.concat_arrays([seen[c], labels])).slice(0, limit + 1)
        names = pa.array([c for c in cols for _ in range(len(seen[c]))], pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.concat_arrays([seen[c] for c in cols])], ["column", "value"])

    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long, dropped boolean")
    labels = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).mapInArrow(few, "column string, value string")
    found = labels.distinct().groupBy("column").agg(F.count("value").alias("n"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    n = F.least(F.coalesce(F.col("n"), F.lit(0)), F.lit(limit + 1)).cast("bigint")
    return every.join(found, "column", "left").select("column", n.alias("n_distinct"), (n > F.lit(limit)).alias("dropped"))


def wide_category_counts(df: DataFrame, cols=None, limit: int = 50) -> DataFrame:
    """P13 exact form as a lazy plan: distinct non-null labels per text column."""
    cols = as_list(cols) or string_columns(df)
    long = df.select(*cols).unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
    g = long.select("column", "value").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    return g.withColumn("dropped", F.col("n_distinct") > F.lit(limit))


def drop_wide_categories(df: DataFrame, limit: int = 50, keep=()) -> DataFrame:
    """Drop text columns with more than ``limit`` labels (unless in ``keep``)."""
    plan = wide_category_plan(df, limit).where("dropped").collect()
    return df.drop(*[r["column"] for r in plan if r["column"] not in keep])


def align_schema(df: DataFrame, expected: list[str], fill=0) -> DataFrame:
    """Add missing columns as ``fill``, drop extras, fix the order."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in expected])


def select_by_type(df: DataFrame, kind: str = "numeric") -> DataFrame:
    """Numeric or text columns."""
    if kind == "numeric":
        return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    return df.select(*string_columns(df))


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """Drop a fixed list, only the columns that are present."""
    return df.drop(*[c for c in as_list(cols) if c in df.columns])


def plot_domain_filters(df: DataFrame, income_max: float = 500_000.0, amount_q: float = 0.99,
                        ratio_col: str | None = None, ratio_max: float = 5.0,
                        approx: bool = False) -> DataFrame:
    """Income below a cap, amount below its ``amount_q`` quantile (a
    constant of one fit), optional ratio below a cap."""
    if approx:
        q = df.agg(F.percentile_approx("loan_amount", amount_q, 10000)).first()[0]
    else:
        q = next(iter(fitted_quantiles(df, "loan_amount", [amount_q])["loan_amount"]), None)
    cond = (F.col("income") < F.lit(income_max)) & (F.col("loan_amount") < F.lit(q).cast("double"))
    if ratio_col:
        cond = cond & (F.col(ratio_col) < F.lit(ratio_max))
    return df.where(cond)


__all__ = [n for n in dir() if not n.startswith("_")] + ["not_null_all"]
