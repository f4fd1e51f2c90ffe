"""Fit / transform encoders.

A fit is ONE aggregate action whose result is a handful of constants
(medians, means, label lists, fold statistics stay in Spark as tables); the
transform is a projection, or a join with a per-key table that AQE
broadcasts when its runtime size is small and sort-merges (with skew
splitting) when it is not. Nothing row-level comes back to the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlane.operators._util import as_list, safe_div, with_constants
from fairlane.operators.prefix import ordered_prefix_sums
from fairlane.operators.quantiles import fitted_quantiles
from fairlane.session import written
from fairlane.sources.tables import hash_bucket


# --- M1: median imputer ------------------------------------------------------------

@dataclass
class ImputerModel:
    values: dict[str, float]
    skipped: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items() if c in df.columns}
        return df.withColumns(out) if out else df

    def to_df(self, spark):
        return spark.createDataFrame([(c, float(v)) for c, v in self.values.items()], "column string, value double")


def fit_median_imputer(train: DataFrame, cols, max_null_share: float | None = 0.4, keep=(),
                       approx: bool = False) -> ImputerModel:
    """M1: medians of the training rows; an all-null column gets 0; a column
    above ``max_null_share`` nulls is skipped unless in ``keep``."""
    cols = as_list(cols)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.count(F.col(c)).alias(f"_c{i}"))
        if approx:
            aggs.append(F.percentile_approx(F.col(c).cast("double"), 0.5, 10000).alias(f"_m{i}"))
    row = train.agg(*aggs).first()
    medians = {c: [row[f"_m{i}"]] for i, c in enumerate(cols)} if approx else fitted_quantiles(train, cols, [0.5])
    values, skipped = {}, []
    for i, c in enumerate(cols):
        n, nn = row["_n"], row[f"_c{i}"]
        share = (n - nn) / n if n else 1.0
        if max_null_share is not None and share > max_null_share and c not in keep:
            skipped.append(c)
            continue
        m = next(iter(medians[c]), None)
        values[c] = float(m) if m is not None else 0.0
    return ImputerModel(values, skipped)


# --- M2 / M10: one-hot over sorted labels ------------------------------------------

@dataclass
class OneHotModel:
    labels: dict[str, list[str]]
    drop_first: bool = True

    def columns(self) -> list[Column]:
        out = []
        for c, labs in self.labels.items():
            for lab in (labs[1:] if self.drop_first else labs):
                out.append(F.coalesce(F.col(c).cast("string") == F.lit(lab), F.lit(False)).cast("int")
                           .alias(f"{c}_{lab}"))
        return out

    def transform(self, df: DataFrame, drop_source: bool = True) -> DataFrame:
        keep = [c for c in df.columns if not (drop_source and c in self.labels)]
        return df.select(*keep, *self.columns())


def fit_one_hot(train: DataFrame, cols, max_labels: int = 10, drop_first: bool = True) -> OneHotModel:
    """M2: columns with at most ``max_labels`` non-null labels get one 0/1
    column per label (sorted; the smallest is dropped with ``drop_first``;
    null → all zeros). Distinct labels come from a long-form distinct, and
    only label lists of qualifying columns (≤ max_labels each) are collected."""
    cols = as_list(cols)
    long = (train.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "column", "value").where(F.col("value").isNotNull()).distinct())
    small = long.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= max_labels)
    rows = (long.join(small.select("column"), "column", "left_semi")
            .groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("labels")).collect())
    got = {r["column"]: list(r["labels"]) for r in rows}
    return OneHotModel({c: got[c] for c in cols if c in got}, drop_first)


def fit_quantile_one_hot(train: DataFrame, col: str, n_bins: int = 4, approx: bool = False):
    """``n_bins`` quantile bins (edges from one aggregate), one 0/1 column per bin."""
    ps = [i / n_bins for i in range(1, n_bins)]
    if approx:
        return QuantileBins(col, [float(v) for v in train.agg(F.percentile_approx(col, ps, 10000)).first()[0] or []])
    return QuantileBins(col, fitted_quantiles(train, col, ps)[col])


@dataclass
class QuantileBins:
    col: str
    edges: list[float]        # inner cut points; bin i holds (edges[i-1], edges[i]]

    def bin_index(self) -> Column:
        x = F.col(self.col)
        expr = None
        for i, e in enumerate(self.edges):
            expr = F.when(x <= F.lit(e), F.lit(i)) if expr is None else expr.when(x <= F.lit(e), F.lit(i))
        if expr is None:        # a column of nulls has no edges
            return F.when(x.isNotNull(), F.lit(0))
        return F.when(x.isNull(), None).otherwise(expr.otherwise(F.lit(len(self.edges))))

    def transform(self, df: DataFrame) -> DataFrame:
        b = self.bin_index()
        return df.select("*", *[F.coalesce(b == F.lit(i), F.lit(False)).cast("int").alias(f"{self.col}_q{i}")
                                for i in range(len(self.edges) + 1)])


# --- M3 / M4: target and frequency encoding ----------------------------------------

def target_encode_out_of_fold(train: DataFrame, key: str, label: str = "target", folds: int = 5,
                              smoothing: float = 10.0, id_col: str = "application_id",
                              out: str | None = None, seed: str = "fold") -> DataFrame:
    """M3 (out-of-fold): each training row gets the smoothed label mean of its
    key computed WITHOUT its own fold, so its own label never leaks in.

    One grouped pass per (key, fold), pre-aggregated map-side; the folds of a
    key become one map in its row, so that all rows are joined once, on the
    key. The fold totals of the out-of-fold prior are constants.
    """
    out = out or f"{key}_te"
    t = train.withColumn("_fold", hash_bucket(seed, F.col(id_col), folds).cast("int"))
    g = written(t.where(F.col(label).isNotNull()).groupBy(key, "_fold").agg(F.sum(label).alias("_s"), F.count(label).alias("_c")), "folds")
    totals = {r["_fold"]: (r["s"], r["c"]) for r in g.groupBy("_fold").agg(F.sum("_s").alias("s"), F.sum("_c").alias("c")).collect()}
    s_all, c_all = sum(s for s, _ in totals.values()), sum(c for _, c in totals.values())
    # The prior is out-of-fold too: all labels less those of the row's fold.
    p = F.lit(None).cast("double")
    for fold in range(folds):
        s, c = totals.get(fold, (0, 0))
        p = F.when(F.col("_fold") == fold, F.lit(float(s_all - s) / float(c_all - c) if c_all > c else None).cast("double")).otherwise(p)
    per = g.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"),
        F.map_from_entries(F.collect_list(F.struct("_fold", F.struct("_s", "_c")))).alias("_own"))
    own = F.try_element_at("_own", F.col("_fold"))
    m = F.lit(float(smoothing))
    s_out = F.col("_ts") - F.coalesce(own["_s"], F.lit(0))
    c_out = F.col("_tc") - F.coalesce(own["_c"], F.lit(0))
    val = F.coalesce(safe_div(s_out + p * m, c_out + m), p)
    return t.join(per, key, "left").select(*train.columns, val.alias(out))


def fit_target_encoder(train: DataFrame, key: str, label: str = "target", smoothing: float = 10.0) -> DataFrame:
    """M3 (apply form): per-key smoothed mean over all training rows, to join
    onto validation / test / scoring rows (unknown keys get the prior)."""
    lab = train.where(F.col(label).isNotNull())
    prior = lab.agg(F.avg(label).alias("p")).select("p").scalar()
    g = lab.groupBy(key).agg(F.sum(label).alias("_s"), F.count(label).alias("_c"))
    m = F.lit(float(smoothing))
    return g.select(key, ((F.col("_s") + prior * m) / (F.col("_c") + m)).alias(f"{key}_te"),
                    prior.alias("_prior"))


def apply_target_encoder(df: DataFrame, enc: DataFrame, key: str) -> DataFrame:
    prior = enc.agg(F.first("_prior")).scalar()
    j = df.join(enc.drop("_prior"), key, "left")
    return j.withColumn(f"{key}_te", F.coalesce(F.col(f"{key}_te"), prior))


def frequency_encode(df: DataFrame, key: str, out: str | None = None) -> DataFrame:
    """M4: key → number of rows with that key (null key → null)."""
    out = out or f"{key}_frequency"
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return df.join(g, key, "left")


# --- M5: signed hashing -------------------------------------------------------------

def hash_index(col, n: int, salt: str = "h") -> Column:
    """Bucket of a value: first 8 hex digits of md5(salt || value) mod n."""
    c = F.col(col) if isinstance(col, str) else col
    return hash_bucket(salt, c, n).cast("int")


def hash_sign(col, salt: str = "s") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(hash_bucket(salt, c, 2) == 0, F.lit(1)).otherwise(F.lit(-1))


def hash_encode(df: DataFrame, col: str, n: int, prefix: str | None = None) -> DataFrame:
    """M5: signed one-token bucket vector as ``n`` integer columns (the bucket
    vector is kept, not its row sum); null → all zeros."""
    prefix = prefix or f"{col}_h"
    idx, sgn = hash_index(col, n), hash_sign(col)
    return df.select("*", *[F.when(idx == F.lit(i), sgn).otherwise(F.lit(0)).alias(f"{prefix}{i}")
                            for i in range(n)])


# --- M6: standard scaling -------------------------------------------------------------

@dataclass
class ScalerModel:
    mean: dict[str, float]
    std: dict[str, float]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        out = {}
        for c in self.mean:
            s = self.std[c] if self.std[c] else 1.0           # zero variance: divide by 1
            out[c + suffix] = (F.col(c).cast("double") - F.lit(self.mean[c])) / F.lit(s)
        return df.withColumns(out)


def fit_standard_scaler(train: DataFrame, cols, ddof: int = 0) -> ScalerModel:
    """M6: mean and standard deviation of the training rows (divisor n by
    default, as the reference's scaler; ``ddof=1`` for n − 1)."""
    cols = as_list(cols)
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = train.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
                    *[sd(c).alias(f"_s{i}") for i, c in enumerate(cols)]).first()
    return ScalerModel({c: float(row[f"_m{i}"] or 0.0) for i, c in enumerate(cols)},
                       {c: float(row[f"_s{i}"] or 0.0) for i, c in enumerate(cols)})


# --- M9: class and group weights -----------------------------------------------------

def class_weights(df: DataFrame, label: str = "target", group: str | None = None, out: str = "weight") -> DataFrame:
    """M9: ``balanced`` weight n / (k · n_c) per class; with ``group`` the
    reweighing weight p(a) · p(y) / p(a, y). Counts come from one grouped
    pass on a tiny table joined back."""
    lab = df.where(F.col(label).isNotNull())
    if group is None:
        g, n, k = with_constants(lab.groupBy(label).agg(F.count(F.lit(1)).alias("_nc")), F.sum("_nc"), F.count(F.lit(1)))
        g = g.select(label, (F.lit(float(n or 0)) / (F.lit(float(k)) * F.col("_nc"))).alias(out))
        return df.join(g, label, "left")
    lab = lab.where(F.col(group).isNotNull())
    g, n = with_constants(lab.groupBy(group, label).agg(F.count(F.lit(1)).alias("_nay")), F.sum("_nay"))
    g = (g.withColumn("_n", F.lit(n))
          .withColumn("_na", F.sum("_nay").over(Window.partitionBy(group)))
          .withColumn("_ny", F.sum("_nay").over(Window.partitionBy(label))))
    g = g.select(group, label, (F.col("_na").cast("double") * F.col("_ny") / (F.col("_n").cast("double") * F.col("_nay"))).alias(out))
    return df.join(g, [group, label], "left")


# --- M11: label index -------------------------------------------------------------------

def label_index(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Label → 0-based alphabetical index over the distinct labels
    (a prefix sum over the distinct labels, joined back)."""
    out = out or f"{col}_idx"
    labels = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_one", F.lit(1))
    idx = ordered_prefix_sums(labels, [], col, ["_one"]).select(col, (F.col("cum__one") - 1).cast("int").alias(out))
    return df.join(idx, col, "left")


# --- saving and loading fits ------------------------------------------------------------

def save_fit(spark, fit, path: str) -> str:
    """Write a fitted imputer, one-hot, quantile-bin or scaler model as one JSON row; an older one there is replaced."""
    row = [(type(fit).__name__, json.dumps(asdict(fit)))]
    spark.createDataFrame(row, "kind string, fit string").coalesce(1).write.mode("overwrite").json(path)
    return path


def load_fit(spark, path: str):
    """The model that ``save_fit`` wrote."""
    kinds = {c.__name__: c for c in (ImputerModel, OneHotModel, QuantileBins, ScalerModel)}
    r = spark.read.schema("kind string, fit string").json(path).first()
    return kinds[r["kind"]](**json.loads(r["fit"]))
