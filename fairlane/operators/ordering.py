"""Sort, limit and sample.

Every order carries a tie-break key so results are repeatable; samples are a
hash of the key below a share, so the same rows come back on every run and
every partitioning (and the same rows in DuckDB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlane.operators._util import as_list
from fairlane.sources.tables import hash_bucket


def order_by(df: DataFrame, cols, ascending=True, tie=None) -> DataFrame:
    """Sort with an explicit tie-break."""
    cols = as_list(cols)
    asc = ascending if isinstance(ascending, (list, tuple)) else [ascending] * len(cols)
    keys = [F.col(c).asc() if a else F.col(c).desc() for c, a in zip(cols, asc)]
    return df.orderBy(*keys, *[F.col(t) for t in as_list(tie)])


def list_order_key(col: str, labels: list[str]) -> Column:
    """Position of the value in a fixed label list (unknown last)."""
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(col))
    return F.when(pos == 0, F.lit(len(labels) + 1)).otherwise(pos)


def order_by_list(df: DataFrame, col: str, labels: list[str], tie=None) -> DataFrame:
    """Fixed label order."""
    return df.orderBy(list_order_key(col, labels), *[F.col(t) for t in as_list(tie)])


def top_n(df: DataFrame, col: str, n: int, tie=None) -> DataFrame:
    """N largest (TakeOrderedAndProject: per-task top n, then a merge)."""
    return df.orderBy(F.col(col).desc(), *[F.col(t) for t in as_list(tie)]).limit(n)


def sample_rows(df: DataFrame, key: str, share: float, seed: str = "sample") -> DataFrame:
    """T4: repeatable sample – rows whose hash of (seed, key) falls below the share."""
    return df.where(hash_bucket(seed, F.col(key), 1_000_000) < F.lit(int(round(share * 1_000_000))))


def head_tail(df: DataFrame, key: str, n: int, tail: bool = False) -> DataFrame:
    """T5: first or last n rows by key."""
    return df.orderBy(F.col(key).desc() if tail else F.col(key).asc()).limit(n)
