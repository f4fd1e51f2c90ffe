"""Explanations and post-processing (SURVEY §2.9 M21, M25, M26; §2.4 A39;
§2.5 W5; §2.3 J4).

Contributions are a long table ``(id, feature, contribution)``:

* linear models: exact ``w · (x − mean)`` – a projection plus one ``stack``,
  no shuffle; contributions sum to the score minus the base value;
* any other model: sampled Shapley values by permutation. Each row is
  expanded to ``n_samples × (features + 1)`` rows (a Generate in the same
  stage), a background row is picked per sample by hash from a small,
  size-checked broadcast table, the whole expanded table is scored by ONE
  batch ``transform``, and marginal gains are sums of scored steps with signs:
  rows are spread by id before the expansion, so that their steps are added up
  where they are made and only the rows themselves are shuffled. Cost grows as
  rows × samples × features, chosen by the caller.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlane.operators._util import as_list
from fairlane.operators.quantiles import exact_quantiles
from fairlane.sources.tables import hash_bucket

MAX_BACKGROUND_ROWS = 1000


def linear_contributions(df: DataFrame, coefs: dict[str, float], intercept: float = 0.0,
                         key: str = "application_id", means: dict[str, float] | None = None) -> DataFrame:
    """M21 (linear): ``(key, feature, value, contribution)`` and the base value
    ``intercept + Σ w · mean`` as column ``base``. Means default to the data's
    own (one aggregate)."""
    feats = list(coefs)
    if means is None:
        row = df.agg(*[F.avg(c).alias(c) for c in feats]).first()
        means = {c: float(row[c] or 0.0) for c in feats}
    base = intercept + sum(coefs[c] * means[c] for c in feats)
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                      (F.lit(float(coefs[c])) * (F.coalesce(F.col(c).cast("double"), F.lit(means[c]))
                                                 - F.lit(means[c]))).alias("contribution"))
             for c in feats]
    return df.select(key, F.inline(F.array(*cells))).withColumn("base", F.lit(float(base)))


def contribution_array(coefs: dict[str, float], means: dict[str, float]):
    """M21 (linear) as one ``array<struct<feature, value>>`` column per row –
    the input of W5 without any grouping."""
    return F.array(*[F.struct(F.lit(c).alias("feature"),
                              (F.lit(float(w)) * (F.coalesce(F.col(c).cast("double"), F.lit(means[c]))
                                                  - F.lit(means[c]))).alias("value"))
                     for c, w in coefs.items()])


def column_means(df: DataFrame, cols) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: float(row[c] or 0.0) for c in cols}


def mean_abs_importance(contrib: DataFrame, by=None) -> DataFrame:
    """Mean absolute contribution per feature, ranked."""
    by = as_list(by)
    g = contrib.groupBy(*by, "feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    w = Window.partitionBy(*by).orderBy(F.col("importance").desc(), "feature")
    return g.withColumn("rank", F.row_number().over(w))


def factor_arrays(contrib: DataFrame, key: str = "application_id") -> DataFrame:
    """Long contributions → one ``array<struct<feature, value>>`` per row
    (grouped by key; each group holds one row's features only)."""
    return contrib.groupBy(key).agg(
        F.collect_list(F.struct(F.col("feature"), F.col("contribution").alias("value"))).alias("contributions"))


def combine_importances(a: DataFrame, b: DataFrame, key: str = "feature") -> DataFrame:
    """J4 + M25: inner join of two importance tables, each one's share of its
    total, and the correlation of the two shares as a column."""
    a = a.select(key, F.col("importance").alias("importance_a"))
    b = b.select(key, F.col("importance").alias("importance_b"))
    j = a.join(b, key, "inner")
    w = Window.partitionBy()
    j = j.select(key, "importance_a", "importance_b",
                 (F.col("importance_a") / F.sum("importance_a").over(w)).alias("share_a"),
                 (F.col("importance_b") / F.sum("importance_b").over(w)).alias("share_b"))
    return j.withColumn("agreement", F.corr("share_a", "share_b").over(w))


def sampled_contributions(model: PipelineModel, df: DataFrame, features: list[str], background: DataFrame,
                          n_samples: int = 16, key: str = "application_id", seed: str = "shap") -> DataFrame:
    """M21 (any model): permutation-sampled Shapley values of the class-1
    probability, ``(key, feature, contribution)`` plus ``base`` (mean score
    of the backgrounds drawn for that row) and ``score``.

    Per row and sample: a permutation of the features (sorted by a hash of
    (key, sample, feature)) and one background row; step k takes the first k
    permuted features from the row and the rest from the background. The
    gain of step k is credited to the k-th feature. Σ contributions =
    score − base exactly, for every row.
    """
    n_bg = background.count()
    if n_bg > MAX_BACKGROUND_ROWS:
        raise ValueError(f"background has {n_bg} rows; sample it to at most {MAX_BACKGROUND_ROWS} first")
    nf = len(features)
    bg = background.select(*[F.col(c).alias(f"_bg_{c}") for c in features]).withColumn(
        "_bgi", F.row_number().over(Window.orderBy(*[f"_bg_{c}" for c in features])) - 1)
    # spread by key before the steps are made: they are scored and added up where their row is
    rows = df.select(key, *features).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    t = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("_s"))
    sk = F.concat_ws(":", F.col(key).cast("string"), F.col("_s").cast("string"))
    t = t.withColumn("_bgi", hash_bucket(seed + "bg", sk, n_bg).cast("int"))
    # Position of each feature in this sample's permutation: rank of its hash.
    hs = F.array(*[F.struct(hash_bucket(seed, F.concat_ws(":", sk, F.lit(c)), 1 << 30).alias("h"),
                            F.lit(i).alias("i")) for i, c in enumerate(features)])
    order = F.transform(F.array_sort(hs), lambda x: x["i"])          # feature index at each position
    t = t.withColumn("_perm", order).join(F.broadcast(bg), "_bgi")
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(nf))).alias("_k"))
    pos = {c: F.array_position(F.col("_perm"), F.lit(i)) - 1 for i, c in enumerate(features)}
    mixed = t.select(key, "_s", "_k", "_perm",
                     *[F.when(pos[c] < F.col("_k"), F.col(c)).otherwise(F.col(f"_bg_{c}")).alias(c) for c in features])
    scored = model.transform(mixed).select(key, "_s", "_k", "_perm",
                                           vector_to_array(F.col("probability"))[1].alias("_p"))
    # step k gains its score for the k-th feature and takes it from the next one's
    came, goes = F.get("_perm", F.col("_k") - 1), F.get("_perm", F.col("_k"))
    drawn = F.count_if(F.col("_k") == 0)                  # samples, times the rows that share the key: a step between copies gains nothing
    gain = [F.sum(F.when(came == i, F.col("_p")).when(goes == i, -F.col("_p"))) / drawn * (n_samples / drawn) for i in range(nf)]
    sums = scored.groupBy(key).agg(*[g.alias(f"_g{i}") for i, g in enumerate(gain)],
                                   F.avg(F.when(F.col("_k") == 0, F.col("_p"))).alias("base"),
                                   F.max(F.when(F.col("_k") == nf, F.col("_p"))).alias("score"))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_g{i}").alias("contribution")) for i, c in enumerate(features)])
    return sums.select(key, F.inline(cells), "base", "score")


def group_thresholds(preds: DataFrame, group: str, target_rate: float | None = None, score: str = "score",
                     by="model", approx: bool = False) -> DataFrame:
    """Per group, the score cut that makes the group's positive rate equal
    ``target_rate`` (default: each model's own overall positive rate), then
    ``pred = score >= cut``.

    One count per (model, group, score) gives the quantiles at all the models'
    target rates at once; each row of the small cut table then picks its model's.
    ``approx=True`` keeps bounded memory for very large groups.
    """
    by = as_list(by)
    base = preds.where(F.col(group).isNotNull())
    if target_rate is None:
        rates = [(tuple(r[b] for b in by), float(r["_rate"])) for r in
                 base.groupBy(*by).agg(F.avg("pred").alias("_rate")).collect()]
    else:
        rates = [((), float(target_rate))]
    ps = sorted({round(1.0 - r, 12) for _, r in rates})
    cuts = (base.groupBy(*by, group).agg(F.percentile_approx(score, ps, 10000).alias("_qs")) if approx
            else exact_quantiles(base, [*by, group], score, ps, "_qs"))
    pick = None
    for key, r in rates:
        idx = F.lit(ps.index(round(1.0 - r, 12)) + 1)
        cond = F.lit(True)
        for b, v in zip(by, key):
            cond = cond & (F.col(b) == F.lit(v))
        val = F.element_at("_qs", idx)
        pick = F.when(cond, val) if pick is None else pick.when(cond, val)
    cuts = cuts.select(*by, group, pick.alias("cut") if target_rate is None else
                       F.element_at("_qs", F.lit(1)).alias("cut"))
    j = preds.join(cuts, [*by, group], "left")
    return j.withColumn("pred", F.coalesce((F.col(score) >= F.col("cut")).cast("int"), F.col("pred")))
