"""Minority oversampling.

SMOTE on Spark without a pair explosion:

1. minority rows only, features standardised (one aggregate);
2. the exact ``k`` nearest of each by a distributed k-d partition
   (:mod:`fairlane.operators.knn`): a row asks its own cell, then only cells
   nearer than its k-th distance;
3. the number of synthetic rows is exact: every minority row makes
   ``need // n_min`` rows, and the first ``need % n_min`` rows in hash order
   (an exact rank by ordered prefix sums) make one more;
4. each synthetic row interpolates towards a neighbour picked by hash with a
   hash-drawn gap in [0, 1) – repeatable after a lost executor. A row without
   neighbours (a minority of one, or a null feature) is copied unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlane.operators.knn import nearest
from fairlane.operators.prefix import ordered_prefix_sums
from fairlane.session import written
from fairlane.sources.tables import hash_bucket

_U = 1 << 30


def _standardised(mino: DataFrame, features: list[str]):
    row = mino.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                   *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)],
                   F.count(F.lit(1)).alias("_n")).first()
    stats = {c: (float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 0.0) or 1.0) for i, c in enumerate(features)}
    return stats, int(row["_n"])


def neighbours(mino: DataFrame, features: list[str], key: str, k: int = 5, cell_rows: int = 2000) -> DataFrame:
    """The k nearest minority neighbours in standardised space: ``(key, nb, dist, rank)``."""
    stats, _ = _standardised(mino, features)
    z = mino.select(key, *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, (m, s) in stats.items()])
    return nearest(z, features, key, k, cell_rows)


def smote(df: DataFrame, features: list[str], label: str, key: str = "application_id", minority=None,
          k: int = 5, ratio: float = 1.0, seed: str = "smote", **nn_args) -> DataFrame:
    """M8: synthetic minority rows so that minority = ``ratio`` × majority;
    returns ONLY the synthetic rows ``(key = null, features…, label, synthetic)``
    – union them with the training rows. ``minority=None`` takes the smaller class."""
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    if minority is None:
        minority = min(counts, key=lambda c: (counts[c], c))
    n_min = counts.get(minority, 0)
    n_maj = sum(v for kk, v in counts.items() if kk != minority)
    need = int(round(ratio * n_maj)) - n_min
    mino = df.where(F.col(label) == F.lit(minority)).select(key, *features)
    if need <= 0 or n_min == 0:
        return mino.limit(0).select(F.lit(None).cast(df.schema[key].dataType).alias(key), *features,
                                    F.lit(minority).alias(label), F.lit(True).alias("synthetic"))
    base, extra = divmod(need, n_min)
    mino = written(mino, "smote-rows")                  # every pass below reads these, none works the features out again
    nb = neighbours(mino, features, key, k, **nn_args)
    nb_lists = nb.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "nb"))).alias("_nbs"))
    # Exact rank in hash order, without a single-task window.
    h = mino.select(key, hash_bucket(seed + "r", F.col(key), _U).alias("_h"))
    ranked = ordered_prefix_sums(h.groupBy("_h").agg(F.count(F.lit(1)).alias("_one")), [], "_h", ["_one"])
    # rows of one hash share its rank range: the key decides within it
    tie = F.row_number().over(Window.partitionBy("_h").orderBy(key))
    h = (h.withColumn("_tie", tie).join(ranked.select("_h", (F.col("cum__one") - F.col("_one")).alias("_before")), "_h")
         .withColumn("_rk", F.col("_before") + F.col("_tie")))
    gen = (mino.join(h.select(key, "_rk"), key).join(nb_lists, key, "left")
           .withColumn("_g", F.lit(base) + (F.col("_rk") <= F.lit(extra)).cast("int")))
    gen = gen.where(F.col("_g") > 0).select("*", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_s"))
    sk = F.concat_ws(":", F.col(key).cast("string"), F.col("_s").cast("string"))
    n_nb = F.coalesce(F.size("_nbs"), F.lit(0))
    pick = F.when(n_nb > 0, F.element_at("_nbs", (hash_bucket(seed + "n", sk, 1 << 20) % F.greatest(n_nb, F.lit(1)))
                                            .cast("int") + 1)["nb"])
    gen = gen.withColumn("_nb", pick).withColumn("_gap", hash_bucket(seed + "g", sk, _U) / F.lit(float(_U)))
    other = mino.select(F.col(key).alias("_nb"), *[F.col(c).alias(f"_o_{c}") for c in features])
    j = gen.join(other, "_nb", "left")
    out = [(F.col(c) + F.coalesce(F.col("_gap") * (F.col(f"_o_{c}") - F.col(c)), F.lit(0.0))).alias(c)
           for c in features]
    return j.select(F.lit(None).cast(df.schema[key].dataType).alias(key), *out,
                    F.lit(minority).alias(label), F.lit(True).alias("synthetic"))
