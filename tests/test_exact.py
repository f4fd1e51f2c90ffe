"""Exact neighbours, tree-path Shapley values, skyline, pairwise moments,
saturating label counts and early stopping, each against a plain version."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from fairlane.catalog.q_models import FEATURES, model_table
from fairlane.operators import balance, columns, fairness, knn, models, profile, stats, tree_shapley


def brute_neighbours(points, k):
    out = {}
    for i, p in points.items():
        d = sorted((float(sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(p, q))), j) for j, q in points.items() if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def found_neighbours(df):
    got = {}
    for r in df.orderBy("rank").collect():
        got.setdefault(r["id"], []).append(r["nb"])
    return got


@pytest.mark.parametrize("cell_rows", [10, 100, 10**6])
def test_neighbours_equal_brute_force(spark, cell_rows):
    """Clusters, a line of ties on a grid, and one vector that a third of the rows share."""
    rng = np.random.default_rng(4)
    pts = [tuple(x) for x in rng.normal(0, 1, (150, 3))] + [(float(i % 6), float(i // 6 % 6), 0.0) for i in range(100)] + [(0.5, 0.5, 0.5)] * 120
    points = {i: tuple(map(float, p)) for i, p in enumerate(pts)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, x double, y double, z double").repartition(4)
    assert found_neighbours(knn.nearest(df, ["x", "y", "z"], "id", 5, cell_rows)) == brute_neighbours(points, 5)


def test_neighbours_of_few_rows_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("d", float("nan"))], "id string, x double")
    assert found_neighbours(knn.nearest(df, ["x"], "id", 5)) == {"a": ["b"], "b": ["a"]}
    assert knn.nearest(df.limit(0), ["x"], "id", 5).count() == 0


def test_smote_neighbours_have_recall_one_on_all_features(spark):
    t = model_table(spark, SMALL).where("label = 1").select("application_id", *FEATURES)
    x = t.toPandas()
    z = x[FEATURES].to_numpy(float)
    z = (z - z.mean(0)) / np.where(z.std(0) == 0, 1, z.std(0))
    d = ((z[:, None] - z[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    far = np.sqrt(np.sort(d, axis=1)[:, :5])
    got = balance.neighbours(t, FEATURES, "application_id", 5, cell_rows=60).toPandas()
    by = got.sort_values("rank").groupby("application_id")["dist"].apply(list)
    assert np.allclose(np.array([by[i] for i in x["application_id"]]), far, atol=1e-9)


def expected(nodes, i, x, known):
    value, weight, left, right, feature, threshold = nodes[i]
    if left < 0:
        return value
    if feature in known:
        return expected(nodes, left if x[feature] <= threshold else right, x, known)
    return sum(nodes[c][1] / weight * expected(nodes, c, x, known) for c in (left, right))


@pytest.mark.parametrize("kind,params", [("tree", {"maxDepth": 6}), ("forest", {"numTrees": 3, "maxDepth": 5}), ("gbt", {"maxIter": 3, "maxDepth": 4})])
def test_tree_shapley_equals_all_subsets(spark, kind, params):
    from math import factorial
    six = FEATURES[:6]
    t = model_table(spark, SMALL).select("application_id", "label", *six)
    m = models.train(t, six, kind, **params)
    trees = tree_shapley.tree_nodes(m.stages[-1], spark)
    some = t.orderBy("application_id").limit(6)
    rows = m.transform(some).select("application_id", "features").collect()
    got = {}
    for r in tree_shapley.tree_contributions(m, some, six).collect():
        got[r["application_id"], r["feature"]] = r["contribution"]
        got[r["application_id"]] = (r["base"], r["score"])
    for r in rows:
        x, total = r["features"].toArray(), 0.0
        for i, name in enumerate(six):
            rest, phi = [j for j in range(6) if j != i], 0.0
            for size in range(6):
                for s in itertools.combinations(rest, size):
                    gain = sum(w * (expected(n, 0, x, {*s, i}) - expected(n, 0, x, set(s))) for w, n in trees)
                    phi += factorial(size) * factorial(5 - size) / factorial(6) * gain
            assert got[r["application_id"], name] == pytest.approx(phi, abs=1e-9)
            total += phi
        base, score = got[r["application_id"]]
        assert total == pytest.approx(score - base, abs=1e-9)


def test_skyline_equals_pairwise_comparison(spark):
    rng = random.Random(6)
    rows = [(i, *(float(rng.randrange(12)) for _ in range(3))) for i in range(400)] + [(900, None, 1.0, 1.0), (901, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "model long, x double, y double, z double").repartition(7)
    known = [r for r in rows if r[1] is not None and r[1] == r[1]]
    beaten = {a[0] for a in known for b in known if all(v >= u for u, v in zip(a[1:], b[1:])) and a[1:] != b[1:]}
    front = fairness.pareto_front(df, ["x", "y", "z"], merge=2)
    assert {r["model"] for r in front.collect()} == {r[0] for r in rows} - beaten
    assert "NestedLoop" not in front._jdf.queryExecution().executedPlan().toString()
    assert fairness.pareto_front(df.limit(0), ["x", "y"]).count() == 0


def test_correlations_of_a_hundred_columns_in_one_pass(spark):
    import pandas as pd
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 3, (300, 100)) + rng.normal(0, 2, (300, 1))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 9] = 5.0, np.nan
    pdf = pd.DataFrame(x, columns=[f"c {i}" for i in range(100)])
    df = spark.createDataFrame([[None if v != v else v for v in r] for r in x.tolist()], ", ".join(f"`{c}` double" for c in pdf)).repartition(3)
    want = pdf.corr()
    got = stats.corr_pairs(df, list(pdf)).collect()
    assert len(got) == 99 * 98 // 2                     # pairs with the empty column have no rows
    for r in got:
        if r["a"] == "c 7" or r["b"] == "c 7":
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-6)


def test_labels_are_counted_up_to_the_limit(spark):
    rows = [(str(i), str(i % 50), "only" if i % 2 else None, None) for i in range(5000)]
    df = spark.createDataFrame(rows, "wide string, edge string, one string, none string").repartition(6)
    got = {r["column"]: (r["n_distinct"], r["dropped"]) for r in columns.wide_category_plan(df, 50).collect()}
    assert got == {"wide": (51, True), "edge": (50, False), "one": (1, False), "none": (0, False)}
    assert columns.drop_wide_categories(df, 49, keep=("wide",)).columns == ["wide", "one", "none"]
    assert columns.wide_category_plan(df.limit(0), 50).where("dropped").count() == 0


def test_distinct_counts_of_types_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.5, "a", [1], True), (1, None, "b", [2], None), (2, 1.5, None, [1], True)],
                               "i long, d double, s string, a array<int>, b boolean")
    assert {r[0]: r[1] for r in profile.distinct_counts(df).collect()} == {"i": 2, "d": 1, "s": 2, "a": 2, "b": 1}
    assert {r[0]: r[1] for r in profile.distinct_counts(df, dropna=False).collect()} == {"i": 2, "d": 2, "s": 3, "a": 2, "b": 2}


def test_early_stop_of_trees_and_network(spark):
    t = model_table(spark, SMALL).select("label", *FEATURES, (F.col("split") == "validation").alias("held"))
    boosted = models.train(t, FEATURES, "gbt", validation="held", maxIter=60, maxDepth=3)
    assert 1 <= models.rounds(boosted) < 60
    net = models.train(t, FEATURES, "mlp", validation="held", layers=(8,), maxIter=60)
    held = net.transform(t.where("held")).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert models.rounds(net) == 2 and held > 0.6
