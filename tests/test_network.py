"""Networks fitted by matrix products: the same steps as Spark ML's own fit,
odd block sizes, several tasks, no pass by Spark ML over the rows learnt from."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from fairlane.operators import models, network


def table_of(spark, n, parts, classes=2):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (n, 3))
    y = np.minimum((x.sum(1) + rng.normal(0, 0.5, n) > 0).astype(int) + (x[:, 0] > 1), classes - 1)
    return spark.createDataFrame([(Vectors.dense(a.tolist()), float(b)) for a, b in zip(x, y)], ["features", "label"]).coalesce(parts)


@pytest.mark.parametrize("n,parts,block,classes", [(500, 1, 128, 2), (301, 2, 32, 3), (64, 1, 128, 2)])
def test_steps_are_sparks_steps(spark, monkeypatch, n, parts, block, classes):
    monkeypatch.setattr(network, "CHUNK", 2)
    monkeypatch.setattr(network, "ROWS", 50)
    t = table_of(spark, n, parts, classes)
    e = MultilayerPerceptronClassifier(layers=[3, 6, 4, classes], seed=42, maxIter=25, blockSize=block)
    want = e.fit(t)
    rows = network.Rows(t, "features", "label", [3, 6, 4, classes], block)
    start = network.model_of(e, spark).weights.toArray()
    got, losses = network.steps_of(rows, start, 25, e.getTol())
    history = want.summary().objectiveHistory
    assert len(losses) == len(history) and np.allclose(losses, history, rtol=1e-7)
    assert np.allclose(got, want.weights.toArray(), atol=1e-4)
    again = network.fit(e.copy().setInitialWeights(Vectors.dense(got)).setMaxIter(0), rows, spark)
    assert np.array_equal(again.weights.toArray(), got) and again.getLayers() == [3, 6, 4, classes]
    rows.done()


def test_spark_ml_itself_never_passes_over_the_rows(spark, monkeypatch):
    seen, plain = [], MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, t, *a: seen.append(t.count()) or plain(self, t, *a))
    x = np.random.default_rng(1).normal(0, 1, (600, 2))
    t = spark.createDataFrame([(float(a), float(b), float(a * b > 0), i % 4 == 0) for i, (a, b) in enumerate(x)], "x double, y double, label double, held boolean")
    m = models.train(t, ["x", "y"], "mlp", weight="balanced", validation="held", layers=(8,), maxIter=40)
    assert m.transform(t).where("prediction = label").count() > 540
    models.train(t, ["x", "y"], "mlp", layers=(4,), maxIter=5)
    assert seen and max(seen) == 1


def test_labels_beyond_the_classes_and_no_rows_are_refused(spark):
    t = table_of(spark, 40, 1, 3)
    with pytest.raises(Exception, match="labels other than 0 to 1"):
        network.Rows(t, "features", "label", [3, 2], 128)
    with pytest.raises(ValueError, match="no rows"):
        network.Rows(t.where("label > 9"), "features", "label", [3, 3], 128)


def test_a_solver_of_sparks_is_left_to_spark(spark):
    t = spark.createDataFrame([(float(i % 7), float(i % 7 > 3)) for i in range(100)], "x double, label double")
    m = models.train(t, ["x"], "mlp", layers=(3,), maxIter=3, solver="gd")
    assert models.rounds(m) == 2
