"""Set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlane.operators._util import as_list


def union_all(*dfs: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Stack tables by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=allow_missing)
    return out


def distinct_rows(df: DataFrame, subset=None) -> DataFrame:
    """Drop exact repeats (nulls equal)."""
    return df.dropDuplicates(as_list(subset) or None)


def common_top_features(ranked: DataFrame, k: int = 10, model: str = "model", feature: str = "feature",
                        rank: str = "rank") -> DataFrame:
    """Features in the top k of every model (count of models = all models)."""
    n_models = ranked.select(model).distinct().agg(F.count(F.lit(1)).alias("m")).select("m").scalar()
    top = ranked.where(F.col(rank) <= k)
    g = top.groupBy(feature).agg(F.countDistinct(model).alias("n_models"))
    return g.where(F.col("n_models") == n_models)


def schema_diff(spark: SparkSession, df: DataFrame, expected: list[str]) -> DataFrame:
    """U4: missing and extra columns as a small table (driver-side sets)."""
    have = set(df.columns)
    rows = [(c, "missing") for c in expected if c not in have] + \
           [(c, "extra") for c in df.columns if c not in set(expected)]
    return spark.createDataFrame(rows, "column string, kind string")


def melt(df: DataFrame, ids, values, var: str = "metric", val: str = "value") -> DataFrame:
    """Wide → long (``unpivot``)."""
    return df.unpivot(as_list(ids), as_list(values), var, val)


def pivot_wide(df: DataFrame, ids, col: str, values: list, value: str, agg: str = "first") -> DataFrame:
    """Long → wide with a given value list (no extra job to find values)."""
    fn = getattr(F, agg)
    return df.groupBy(*as_list(ids)).pivot(col, list(values)).agg(fn(value))
