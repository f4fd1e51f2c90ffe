"""Neighbours by matrix products: equal to the plain search, values far from
zero and infinite ones included; cells reached by the box around their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlane.operators import balance, knn


def plain(a, b, keys, k, far=None):
    dists, names = [], []
    for r, x in enumerate(a):
        with np.errstate(all="ignore"):
            d = np.zeros(len(b))
            for c in range(len(x)):
                d += (x[c] - b[:, c]) ** 2
        last = np.partition(d, k - 1)[k - 1] if len(b) > k else np.inf
        last = last if far is None else min(last, far[r])
        found = sorted((d[i], key) for i in np.flatnonzero(d <= last) for key in keys[i])[:k]
        dists.append([x for x, _ in found])
        names.append([y for _, y in found])
    return dists, names


@pytest.mark.parametrize("kind", ["usual", "ties", "far away", "infinite", "few", "words"])
def test_best_equals_the_plain_search(monkeypatch, kind):
    monkeypatch.setattr(knn, "CELLS", 1000)
    rng = np.random.default_rng(8)
    b = rng.normal(0, 1, (4 if kind == "few" else 150, 9))
    if kind == "ties":
        b = rng.integers(0, 3, (150, 9)).astype(float)
    elif kind == "far away":
        b = 1e7 + 1e-3 * b
    elif kind == "infinite":
        b[3, 2], b[7, 1] = np.inf, 1e200
    a = np.concatenate([b, b[:3] + 1e-9])
    keys = [[n * 3 + m for m in range(rng.integers(1, 4))] for n in rng.permutation(len(b)).tolist()]
    if kind == "words":
        keys = [[f"k{x}" for x in ks] for ks in keys]
    for far in (None, np.quantile(np.abs(rng.normal(0, 8, len(a))), rng.random(len(a))), np.full(len(a), np.inf)):
        got, want = knn._best(a, b, keys, 6, far), plain(a, b, keys, 6, far)
        assert got[1] == want[1] and got[0] == want[0]


def test_cells_reached_are_those_within_the_distance():
    rng = np.random.default_rng(2)
    p = rng.normal(0, 1, (4000, 5))
    tree = knn.KdTree(p, 60, 7)
    at = tree.cell(p)
    cells = np.unique(at)
    wide = [r.size for r in tree.reached(p[:700], np.full(700, 0.2))]
    tree.bounded(cells, np.array([p[at == c].min(0) for c in cells]), np.array([p[at == c].max(0) for c in cells]))
    far = rng.random(700) * 0.4
    far[5] = np.inf
    for i, r in enumerate(tree.reached(p[:700], far)):
        gap = (np.maximum(np.maximum(tree.low - p[i], p[i] - tree.high), 0) ** 2).sum(1)
        assert r.tolist() == np.flatnonzero(gap <= far[i]).tolist() and at[i] in r
    assert sum(r.size for r in tree.reached(p[:700], np.full(700, 0.2))) < sum(wide)



def test_oversampling_works_features_out_once(spark, monkeypatch):
    made, plain_written = [], balance.written
    monkeypatch.setattr(balance, "written", lambda df, name: made.append(name) or plain_written(df, name))
    rows = [(i, float(i % 11), float(i % 5), float(i % 3 == 0)) for i in range(90)]
    t = spark.createDataFrame(rows, "application_id long, x double, y double, label double").withColumn("y", F.sqrt("y"))
    syn = balance.smote(t, ["x", "y"], "label")
    assert made == ["smote-rows"] and syn.count() == 30
    assert "SQRT" not in syn._jdf.queryExecution().executedPlan().toString()
