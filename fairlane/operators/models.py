"""Model jobs on Spark ML.

Training is distributed by Spark ML itself (tree statistics and gradient
aggregates are computed per partition and reduced); scoring is one
``PipelineModel.transform`` per model, a projection over the feature table,
unioned into ONE long prediction table ``(id, model, y_true, score, pred)``
that every metric and fairness operator reads.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassificationModel,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlane.operators import forest, network
from fairlane.operators._util import as_list
from fairlane.operators.encode import class_weights
from fairlane.session import checkpoint_dir, written

# Reference settings per model kind (trees, depth, rates, layers).
KINDS = {
    "logistic": dict(regParam=0.01, elasticNetParam=0.0, maxIter=100),
    "logistic_c05": dict(regParam=0.02, elasticNetParam=0.0, maxIter=100),
    "sparse_logistic": dict(regParam=0.01, elasticNetParam=1.0, maxIter=100),
    "gbt": dict(maxIter=200, maxDepth=6, stepSize=0.1, subsamplingRate=0.8),
    "forest": dict(numTrees=200, maxDepth=15, featureSubsetStrategy="sqrt", maxMemoryInMB=1024),
    "mlp": dict(layers=(128, 64, 32), maxIter=100),
    "tree": dict(maxDepth=5),
}


def _classifier(kind: str, label: str, weight: str | None, params: dict, n_features: int):
    p = {**KINDS.get(kind, {}), **params}
    common = dict(featuresCol="features", labelCol=label)
    if kind.startswith("logistic") or kind == "sparse_logistic":
        return LogisticRegression(**common, **({"weightCol": weight} if weight else {}), **p)
    if kind == "gbt":
        return GBTClassifier(**common, **({"weightCol": weight} if weight else {}), seed=42, **p)
    if kind == "forest":
        return RandomForestClassifier(**common, **({"weightCol": weight} if weight else {}), seed=42, **p)
    if kind == "tree":
        return DecisionTreeClassifier(**common, **({"weightCol": weight} if weight else {}), seed=42, **p)
    if kind == "mlp":
        layers = [n_features, *p.pop("layers"), 2]
        return MultilayerPerceptronClassifier(**common, layers=layers, seed=42, **p)
    raise ValueError(f"unknown model kind {kind}")


ROWS_PER_TASK = 10_000          # training rows worth a task of their own in each of a fit's passes


def train(train_df: DataFrame, features: list[str], kind: str = "logistic", label: str = "label",
          weight: str | None = None, scale: bool = True, validation: str | None = None, **params) -> PipelineModel:
    """Assemble (nulls must be imputed first), scale, fit one classifier.

    ``weight="balanced"`` weighs the classes alike (M9). ``validation`` names a
    boolean column whose rows are not learnt from: boosted trees and networks
    stop when those rows get no better, other kinds leave them out.
    """
    rows, *nulls = train_df.agg(F.count(F.lit(1)), *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in features]).first()
    missing = [c for c, n in zip(features, nulls) if n]
    if missing:
        raise ValueError(f"nulls in {', '.join(missing)}: impute first")
    held = F.lit(False) if validation is None else F.coalesce(F.col(validation), F.lit(False))
    if weight == "balanced" and kind != "mlp":
        # weights of the rows learnt from; held rows carry their class's weight
        learnt = class_weights(train_df.where(~held), label, out="_weight").groupBy(label).agg(F.first("_weight").alias("_weight"))
        train_df, weight = train_df.join(learnt, label), "_weight"
    elif weight == "balanced":
        weight = None           # the network has no weights
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="error")]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    else:
        stages[0].setOutputCol("features")
    prepared = Pipeline(stages=stages).fit(train_df.where(~held))
    # the scaled table, written once: every pass of a fit reads it, with a task on every core if there are rows enough
    table = prepared.transform(train_df).select("features", label, held.alias("_held"), *([weight] if weight else []))
    tasks = min(train_df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_PER_TASK)
    if tasks > 1 and len(train_df.inputFiles()) < tasks:
        table = table.repartition(tasks)
    table = written(table, "training")
    params = dict(params)
    if kind == "mlp" and validation:
        fitted = _stopped_network(table, label, params, len(features))
    elif kind == "gbt" and validation:
        fitted = _classifier(kind, label, weight, {"validationTol": VALIDATION_TOL, **params, "validationIndicatorCol": "_held"}, len(features)).fit(table)
    elif kind == "mlp":
        fitted = _network(_classifier(kind, label, None, params, len(features)), table.where("NOT _held"))
    elif kind == "forest" and rows // ROWS_PER_TASK > 1:        # rows for one task are Spark ML's, with its draws
        fitted = forest.fit(_classifier(kind, label, weight, params, len(features)), table.where("NOT _held"), weight)
    else:
        fitted = _classifier(kind, label, weight, params, len(features)).fit(table.where("NOT _held"))
    return PipelineModel(stages=[*prepared.stages, fitted])


# Boosting stops when the validation loss falls by less than this
# share; a network is looked at every STEPS steps and stops after PATIENCE looks without a fall.
VALIDATION_TOL, STEPS, PATIENCE = 0.001, 10, 3


def log_loss(model, df: DataFrame, label: str = "label") -> float:
    """Mean of −log of the probability of the true class."""
    p = F.element_at(vector_to_array(F.col("probability")), F.col(label).cast("int") + 1)
    return model.transform(df).agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15))))).first()[0]


def _stopped_network(table: DataFrame, label: str, params: dict, n_features: int):
    """A network fitted in short runs, each from the last one's weights,
    until the held rows' loss has not fallen for ``PATIENCE`` runs. The best
    network so far is saved in the checkpoint folder and is the one returned."""
    most = params.pop("maxIter", KINDS["mlp"]["maxIter"])
    learn, held = table.where("NOT _held"), table.where("_held")
    path = f"{checkpoint_dir(table.sparkSession).rstrip('/')}/network-{uuid.uuid4().hex}"
    rows = _network_rows(_classifier("mlp", label, None, params, n_features), learn)
    best, since, weights, taken = None, 0, None, 0
    while taken < most and since < PATIENCE:
        steps = min(STEPS, most - taken)
        fit = _classifier("mlp", label, None, {**params, "maxIter": steps}, n_features)
        if weights is not None:
            fit.setInitialWeights(weights)
        model = _network(fit, learn, rows)
        weights, taken = model.weights, taken + steps
        loss = log_loss(model, held, label)
        if best is None or loss < best:
            best, since = loss, 0
            model.write().overwrite().save(path)
        else:
            since += 1
    if rows:
        rows.done()
    return MultilayerPerceptronClassificationModel.load(path)


def _network_rows(fit, learn: DataFrame):
    """The rows learnt from as the network's passes read them; None for a solver that Spark ML runs itself."""
    return network.Rows(learn, "features", fit.getLabelCol(), fit.getLayers(), fit.getBlockSize()) if fit.getSolver() == "l-bfgs" else None


def _network(fit, learn: DataFrame, rows=None):
    """One fit of a network, over ``rows`` if they are there already."""
    given = rows or _network_rows(fit, learn)
    if given is None:
        return fit.fit(learn)
    model = network.fit(fit, given, learn.sparkSession)
    if rows is None:
        given.done()
    return model


def rounds(model: PipelineModel) -> int:
    """Trees of an ensemble, or layers of weights of a network."""
    last = model.stages[-1]
    return last.getNumTrees if hasattr(last, "getNumTrees") else len(last.getLayers()) - 1


def score(model: PipelineModel, df: DataFrame, name: str, key: str = "application_id",
          label: str | None = "label", threshold: float = 0.5, keep=()) -> DataFrame:
    """M19 (one model): probability of class 1 as ``score`` and ``pred``."""
    out = model.transform(df)
    prob = vector_to_array(F.col("probability"))[1]
    cols = [F.col(key), F.lit(name).alias("model")]
    cols.append(F.col(label).cast("int").alias("y_true") if label else F.lit(None).cast("int").alias("y_true"))
    cols += [prob.alias("score"), (prob >= F.lit(threshold)).cast("int").alias("pred"), *[F.col(c) for c in keep]]
    return out.select(*cols)


def score_batch(models: dict[str, PipelineModel], df: DataFrame, key: str = "application_id",
                label: str | None = "label", keep=()) -> DataFrame:
    """Every model on one table, as one long prediction table: one pass
    over the rows, each model's probability added to the row, then unpivoted."""
    wide = _probabilities(models, df)
    parts = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_p{i}").alias("score")) for i, n in enumerate(models)])
    y = F.col(label).cast("int") if label else F.lit(None).cast("int")
    out = wide.select(F.col(key), y.alias("y_true"), *[F.col(c) for c in keep], F.inline(parts))
    return out.select(key, "model", "y_true", "score", (F.col("score") >= F.lit(0.5)).cast("int").alias("pred"), *keep)


def _probabilities(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """The rows with the class-1 probability of the i-th model as ``_p{i}``: one pass."""
    for i, model in enumerate(models.values()):
        df = model.transform(df).withColumn(f"_p{i}", vector_to_array(F.col("probability"))[1])
        df = df.drop("raw_features", "features", "rawPrediction", "probability", "prediction")
    return df


def vote_batch(models: dict[str, PipelineModel], df: DataFrame, key: str = "application_id", label: str | None = "label",
               name: str = "vote") -> DataFrame:
    """M18 over rows scored here: the mean of the models' probabilities, row by row, without a shuffle of rows × models."""
    if not models:
        raise ValueError("a vote needs models")
    mean = sum((F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0)) / F.lit(float(len(models)))
    y = F.col(label).cast("int") if label else F.lit(None).cast("int")
    return _probabilities(models, df).select(key, F.lit(name).alias("model"), y.alias("y_true"), mean.alias("score"),
                                             (mean > F.lit(0.5)).cast("int").alias("pred"))


def save_model(model: PipelineModel, path: str) -> str:
    """Write a fitted pipeline, its scaler included; an older one there is replaced."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def soft_vote(preds: DataFrame, min_models: int = 3, key: str = "application_id", name: str = "vote") -> DataFrame:
    """Mean probability per row over the models, positive above 0.5;
    rows scored by fewer than ``min_models`` models get no vote."""
    g = preds.groupBy(key).agg(F.avg("score").alias("score"), F.max("y_true").alias("y_true"),
                               F.count(F.lit(1)).alias("_k"))
    g = g.where(F.col("_k") >= min_models)
    return g.select(key, F.lit(name).alias("model"), "y_true", "score",
                    (F.col("score") > F.lit(0.5)).cast("int").alias("pred"))


def model_importance(model: PipelineModel, features: list[str], top: int | None = 20) -> DataFrame:
    """Tree importances or absolute weights as ``(feature, importance, rank)``."""
    clf = model.stages[-1]
    if hasattr(clf, "featureImportances"):
        vals = clf.featureImportances.toArray().tolist()
    elif hasattr(clf, "coefficients"):
        vals = [abs(v) for v in clf.coefficients.toArray().tolist()]
    else:
        raise ValueError("model has no importances")
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    t = spark.createDataFrame(list(zip(features, [float(v) for v in vals])), "feature string, importance double")
    t = t.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))
    return t.where(F.col("rank") <= top) if top else t


def nonzero_weights(model: PipelineModel) -> int:
    """Number of non-zero weights of a sparse logistic model."""
    return int(sum(1 for v in model.stages[-1].coefficients.toArray() if v != 0.0))


def tree_text(model: PipelineModel) -> str:
    """Readable rules of a small tree."""
    return model.stages[-1].toDebugString


def example_cases(preds: DataFrame, k: int = 3, key: str = "application_id", order=None) -> DataFrame:
    """The first ``k`` rows (by ``order``) of each case type: right
    approvals, right denials, borderline (0.4-0.6), false positives, false negatives."""
    s, y, p = F.col("score"), F.col("y_true"), F.col("pred")
    case = (F.when((s >= 0.4) & (s <= 0.6), F.lit("borderline"))
            .when((y == 1) & (p == 1), F.lit("correct_approval"))
            .when((y == 0) & (p == 0), F.lit("correct_denial"))
            .when((y == 0) & (p == 1), F.lit("false_positive"))
            .when((y == 1) & (p == 0), F.lit("false_negative")))
    by = ["model"] if "model" in preds.columns else []
    t = preds.withColumn("case_type", case).where(F.col("case_type").isNotNull())
    w = Window.partitionBy(*by, "case_type").orderBy(*[F.col(c) for c in (as_list(order) or [key])])
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def batch_summary(preds: DataFrame, by="model") -> DataFrame:
    """Total, approved, denied, high-risk count and the share of each
    risk level, per model – one aggregate pass."""
    from fairlane.functions.features import decide
    by = as_list(by)
    lvl = decide("score")["risk_level"]
    g = preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("pred") == 1).alias("approved"),
        F.count_if(F.col("pred") == 0).alias("denied"), F.count_if(lvl == "High Risk").alias("high_risk"),
        F.count_if(lvl == "Moderate Risk").alias("_mod"), F.count_if(lvl == "Low Risk").alias("_low"))
    t = F.col("total")
    return g.select(*by, "total", "approved", "denied", "high_risk",
                    (F.col("approved") / t * 100.0).alias("approval_pct"),
                    (F.col("high_risk") / t * 100.0).alias("high_risk_pct"),
                    (F.col("_mod") / t * 100.0).alias("moderate_risk_pct"),
                    (F.col("_low") / t * 100.0).alias("low_risk_pct"))
