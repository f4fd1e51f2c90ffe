"""Readers and writers between stages.

Stages meet through Parquet (CSV / JSON only at the edge). Schemas are given
explicitly: inferring a schema reads the whole input once more.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlane.operators._util import as_list


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None, header: bool = True) -> DataFrame:
    """Read Parquet, CSV (with header) or JSON with an explicit schema."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "json" if path.endswith(".json") else "parquet")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", str(header).lower()).option("mode", "PERMISSIVE").csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


def read_head(df: DataFrame, n: int, order_by) -> DataFrame:
    """First ``n`` rows by a key (a bare ``limit`` is not repeatable).

    Planned as TakeOrderedAndProject: each task keeps its own top n, so only
    tasks × n rows reach the final merge.
    """
    return df.orderBy(*as_list(order_by)).limit(n)


def row_count(df: DataFrame) -> DataFrame:
    """S3: row count as a one-row table (Parquet answers it from footers)."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None,
                fmt: str = "parquet") -> None:
    """Write a stage table, optionally partitioned (e.g. by ``run_ts``)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*as_list(partition_by))
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def summary_json(df: DataFrame) -> DataFrame:
    """A one-row result as a JSON document column ``summary``."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("summary"))


def write_summary(df: DataFrame, path: str, run_ts: dt.datetime | None = None) -> None:
    """Write a one-row run summary as JSON, stamped with the run time."""
    stamp = run_ts or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    summary_json(df.withColumn("run_ts", F.lit(stamp))).coalesce(1).write.mode("append").text(path)


def latest_run(df: DataFrame, run_col: str = "run_ts", key=None) -> DataFrame:
    """Rows of the newest run (overall, or per ``key``).

    Overall: a scalar sub-query on ``max(run_col)``; on a table partitioned by
    ``run_col`` this becomes dynamic partition pruning.
    """
    keys = as_list(key)
    if not keys:
        return df.where(F.col(run_col) == df.agg(F.max(run_col)).scalar())
    w = Window.partitionBy(*keys)
    return df.withColumn("_mx", F.max(run_col).over(w)).where(F.col(run_col) == F.col("_mx")).drop("_mx")


def prepare_batch(df: DataFrame, label_from: str = "action_taken", label: str = "target",
                  threshold: float = 0.4, keep=(), order_by: str | None = None,
                  partition_by: str | None = None) -> DataFrame:
    """Standardise names → drop sparse columns → fill gaps → keep labelled.

    The chain the reference's batch path intends (its own version passes a
    table where a path is expected). Gap filling needs an order and a
    partition key (W1); it is skipped when none is given.
    """
    from fairlane.operators.columns import derive_label, drop_sparse_columns, keep_labelled, standardize_columns
    from fairlane.operators.windows import fill_gaps
    from fairlane.session import written

    out = standardize_columns(df)
    if label not in out.columns and label_from in out.columns:
        out = derive_label(out, label_from, label)
    out = drop_sparse_columns(written(out, "batch"), threshold, keep=list(keep) + [label])
    if order_by and partition_by:
        cols = [c for c in out.columns if c not in (order_by, partition_by, label)]
        out = fill_gaps(out, cols, order_by, partition_by, stored=True)
    return keep_labelled(out, label)


TEMPLATE_SCHEMA = T.StructType([
    T.StructField("loan_amount", T.DoubleType()), T.StructField("property_value", T.DoubleType()),
    T.StructField("income", T.DoubleType()), T.StructField("interest_rate", T.DoubleType()),
    T.StructField("loan_term", T.IntegerType()), T.StructField("is_fha_loan", T.BooleanType()),
    T.StructField("is_va_loan", T.BooleanType()), T.StructField("has_coborrower", T.BooleanType()),
])

# The three sample rows of the batch upload template.
TEMPLATE_ROWS = [
    (300000.0, 400000.0, 100000.0, 6.5, 360, False, False, True),
    (250000.0, 300000.0, 85000.0, 7.0, 360, True, False, False),
    (450000.0, 600000.0, 150000.0, 6.25, 240, False, False, True),
]


def template_table(spark: SparkSession) -> DataFrame:
    """The sample rows of a batch upload template, with a schema."""
    return spark.createDataFrame(TEMPLATE_ROWS, TEMPLATE_SCHEMA)
