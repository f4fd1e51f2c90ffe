"""Join operators (SURVEY §2.3 J1, J2, J4, J6, J7, J9; J3 / J5 / J8 are in
:mod:`fairlane.operators.fairness`).

No join here is hinted blindly: per-key statistics tables are joined without a
hint and AQE turns the join into a broadcast when the runtime size of that
side is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``, keeping the
sort-merge plan (with skew splitting) when it is not. Fixed lookups are map
literals inside the projection, so they need no join at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlane.operators._util import as_list


def attach_group_stat(df: DataFrame, key, stats: DataFrame, how: str = "left") -> DataFrame:
    """Map a per-key statistic back onto rows; unknown keys get null."""
    return df.join(stats, as_list(key), how)


def group_stat(df: DataFrame, key: str, value: str, fn: str = "avg", out: str | None = None) -> DataFrame:
    """J1 statistic side: ``fn(value)`` per key (null keys left out)."""
    out = out or f"{key}_{fn}_{value}"
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(getattr(F, fn)(value).alias(out))


def decode(col: str | Column, lookup: dict, default=None) -> Column:
    """Fixed dictionary map with a default for unmapped values – a map
    literal evaluated in the projection (no join, stays in codegen)."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[x for k, v in lookup.items() for x in (F.lit(k), F.lit(v))])
    got = F.try_element_at(m, c)
    return got if default is None else F.coalesce(got, F.lit(default))


def attach_protected(preds: DataFrame, attrs: DataFrame, key: str = "application_id") -> DataFrame:
    """Align predictions with protected columns by key (not by position)."""
    return preds.join(attrs, key, "inner")


def split_overlap(splits: dict[str, DataFrame], key: str = "application_id") -> DataFrame:
    """Rows shared by each pair of splits (must all be 0): rows of the left
    one whose key the right one has. All pairs from one count per key and split."""
    names = list(splits)
    tagged = reduce(DataFrame.union, [splits[s].select(F.col(key).alias("_k"), F.lit(i).alias("_s")) for i, s in enumerate(names)])
    per = tagged.where(F.col("_k").isNotNull()).groupBy("_k").agg(*[F.count_if(F.col("_s") == i).alias(f"n{i}") for i in range(len(names))])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    row = per.agg(*[F.coalesce(F.sum(F.when(F.col(f"n{j}") > 0, F.col(f"n{i}"))), F.lit(0)).alias(f"p{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), F.col(f"p{i}_{j}").alias("shared")) for i, j in pairs]
    return row.select(F.inline(F.array(*cells)))


def what_if_grid(base: DataFrame, param: str, start: float, stop: float, step: float,
                 value_col: str = "value") -> DataFrame:
    """Every base row × a grid of one parameter.

    The grid is generated per row with ``explode(sequence(...))`` – a
    Generate in the same stage, no cross join and no shuffle; callers then
    recompute features and score on the result.
    """
    n = int(round((stop - start) / step))
    idx = F.explode(F.sequence(F.lit(0), F.lit(n)))
    return (base.select("*", idx.alias("_i"))
            .withColumn(value_col, F.round(F.lit(float(start)) + F.col("_i") * F.lit(float(step)), 10))
            .withColumn(param, F.col(value_col)).drop("_i"))
