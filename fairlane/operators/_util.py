"""Small shared helpers for operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlane.session import written


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def not_null_all(cols: Iterable[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def drop_null_keys(df: DataFrame, keys: Iterable[str], keep_null: bool = False) -> DataFrame:
    """pandas ``groupby`` leaves out rows whose key is null; Spark keeps them as a group."""
    keys = list(keys)
    return df if keep_null or not keys else df.where(not_null_all(keys))


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields null on zero / null denominators (ANSI-safe)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def div0(a: Column, b: Column) -> Column:
    """Division with the zero-division convention of the reference: 0 when empty."""
    return F.coalesce(safe_div(a, b), F.lit(0.0))


def median(c: str | Column, approx: bool = False, accuracy: int = 10000) -> Column:
    """Exact (linear interpolation, like pandas) or bounded-memory median.

    ``percentile`` keeps every distinct value of a group in one task; for
    groups above ~10^7 rows use ``approx=True``.
    """
    col = F.col(c) if isinstance(c, str) else c
    if approx:
        return F.percentile_approx(col, 0.5, accuracy).cast("double")
    return F.percentile(col, F.lit(0.5))


def quantiles(c: str | Column, ps: list[float], approx: bool = False, accuracy: int = 10000) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    arr = F.array(*[F.lit(float(p)) for p in ps])
    if approx:
        return F.percentile_approx(col, arr, accuracy)
    return F.percentile(col, arr)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def with_constants(df: DataFrame, *aggs: Column) -> tuple:
    """``df``, written once, and aggregates over all its rows as constants."""
    t = written(df, "grouped")
    return (t, *t.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).first())
