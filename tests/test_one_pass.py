"""Work that grows with the table once: model inputs written once, sampled
contributions without a shuffle of steps, looked-up tree patterns, short ranges
in few tasks, training rows spread over the cores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from fairlane.catalog.q_models import FEATURES, model_table
from fairlane.operators import explain, models, prefix, tree_shapley, windows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_table_reads_written_inputs_only(spark):
    t = model_table(spark, SMALL)
    assert "Join" not in plan(t) and not any("lineitem" in f or "orders" in f for f in t.inputFiles())
    assert set(FEATURES) | {"application_id", "split", "label"} <= set(t.columns)


def test_sampled_steps_are_added_up_without_a_shuffle(spark):
    rows = [(i, float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(200)]
    t = spark.createDataFrame(rows, "application_id long, x double, y double, label double")
    m = models.train(t, ["x", "y"], "tree", maxDepth=3)
    c = explain.sampled_contributions(m, t, ["x", "y"], t.limit(5).select("x", "y"), n_samples=3)
    steps = plan(c).split("Generate")
    assert "Window" not in steps[0] and not any("Exchange" in s for s in steps[:3])
    # rows that share a key, all alike: one row per feature, as base and score
    one = {(r["application_id"], r["feature"]): r for r in c.collect()}
    assert len(one) == 400
    twice = {(r["application_id"], r["feature"]): r for r in
             explain.sampled_contributions(m, t.unionByName(t), ["x", "y"], t.limit(5).select("x", "y"), n_samples=3).collect()}
    for k, r in twice.items():
        assert (r["base"], r["score"]) == (pytest.approx(one[k]["base"]), one[k]["score"])
        assert r["contribution"] == pytest.approx(one[k]["contribution"] / 2)


def test_looked_up_patterns_equal_the_integral(monkeypatch):
    inf = np.inf
    paths = [(2.0, [(0, -inf, 1.0, 0.3), (1, 0.0, 2.0, 0.5)]), (-1.0, [(2, 0.5, inf, 0.7)]),
             (0.5, [(1, -inf, 0.0, 0.2), (0, 1.0, inf, 0.9), (2, -inf, 0.5, 0.4)])]
    blocks = tree_shapley.leaf_arrays(paths)
    x = np.random.default_rng(1).integers(-2, 4, (500, 3)) / 2.0
    got = tree_shapley.shapley(x, blocks, 3)
    monkeypatch.setattr(tree_shapley, "PATTERN_PLACES", 0)
    assert np.allclose(got, tree_shapley.shapley(x, blocks, 3), atol=1e-12)


def test_short_ranges_need_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "TASKS", 4)
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").alias("k"), F.col("id").alias("v"),
                                  F.when(F.col("id") % 40 == 7, F.col("id")).alias("x")).repartition(3)
    t, several = prefix.ordered_ranges(df, "k", "v", 10)
    assert several and len(t.inputFiles()) <= 4
    sizes = [r["count"] for r in t.groupBy("_b").count().collect()]
    assert len(sizes) >= 300 and max(sizes) <= 10
    spans = t.groupBy("k", "_b").agg(F.min("v").alias("a"), F.max("v").alias("z")).orderBy("k", "_b").collect()
    assert all(p["z"] < q["a"] for p, q in zip(spans, spans[1:]) if p["k"] == q["k"])
    short, plain = windows.fill_gaps(df, "x", "v", "k", rows_per_range=10), windows.fill_gaps(df, "x", "v", "k")
    assert sorted(short.collect(), key=lambda r: r["v"]) == sorted(plain.collect(), key=lambda r: r["v"])


def test_training_rows_are_spread_over_the_cores(spark, monkeypatch):
    made = []
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(models, "written", lambda df, name, w=models.written: made.append(w(df, name)) or made[-1])
    t = spark.createDataFrame([(float(i % 7), float(i % 7 > 3)) for i in range(450)], "x double, label double").coalesce(1)
    m = models.train(t, ["x"], "tree", maxDepth=2)
    assert len(made[0].inputFiles()) == min(4, spark.sparkContext.defaultParallelism) and made[0].count() == 450
    assert m.transform(t).where("prediction <> label").count() == 0
    with pytest.raises(ValueError, match="nulls in x"):
        models.train(t.unionByName(spark.createDataFrame([(None, 1.0)], "x double, label double")), ["x"], "tree")
