import itertools

import numpy as np
from helpers import Groups

from fairlane.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    ok = {}
    for i, v, label in rows:
        a = np.array([np.nan if c is None else c for c in v or ()], float)
        if label is not None and len(a) and np.isfinite(a).all() and a.any():
            ok[i] = (a / np.linalg.norm(a), label)
    g, n = Groups([r[0] for r in rows]), {r[0]: 0 for r in rows}
    for a, b in itertools.combinations(ok, 2):
        if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= cosine:
            g.join(a, b)
            n[a] += 1
            n[b] += 1
    return {(i, n[i], g.find(i), g.find(i) == i) for i in n}


def corpus(seed=0, many=60):
    rng = np.random.default_rng(seed)
    rows = []

    def add(v, label):
        rows.append((len(rows), [float(x) for x in v.astype(np.float32)], label))

    for k in range(60):
        base, label = rng.normal(size=24), int(rng.integers(3))
        for _ in range(many if k == 0 else rng.integers(1, 5)):
            add(base / np.linalg.norm(base) + rng.normal(size=24) * 0.04, label)
        if k % 7 == 0:
            add(base, label)
            add(base * 2, label)
            rows.append((len(rows), rows[-1][1], label))
    rows.append((len(rows), None, 1))
    rows.append((len(rows), [], 1))
    rows.append((len(rows), [0.0] * 24, 1))
    rows.append((len(rows), [None] + [1.0] * 23, 1))
    rows.append((len(rows), [float("nan")] + [1.0] * 23, 1))
    rows.append((len(rows), [float("inf")] + [1.0] * 23, 1))
    rows.append((len(rows), rows[0][1], None))
    rows.append((len(rows), [1.0, 2.0], 1))
    rows.append((len(rows), [1.0, 2.0], 1))
    return rows


def test_links_and_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4, "vec_id")
    for block in (pivots.BLOCK, 16):        # small blocks: lists are cut
        got = {tuple(r) for r in pivots.near_duplicates(df, block=block, shared=1, nearest=12).collect()}
        assert got == brute(rows)


def test_recall_with_production_parameters(spark):
    rows = corpus(3, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "copies", "v", "dim", "pivot", "links"):
        df = df.withColumn(c, df["vec_id"])
    found = sum(r["n_links"] for r in pivots.near_duplicates(df).collect())
    true = sum(n for _, n, _, _ in brute(rows))
    assert 0.9 * true <= found <= true


def test_empty_table_and_null_id(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [2.0, 0.0], 1)], SCHEMA)
    got = {tuple(r) for r in pivots.near_duplicates(df).collect()}
    assert got == {(None, 0, None, False), (4, 1, 4, True), (5, 1, 4, False)}
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_one_node(spark):
    """Two vectors of id 5 join what each of them links with; links stay those of the vector."""
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = [0.01, 1.0, 0.0]
    df = spark.createDataFrame([(3, v, 1), (5, v, 1), (5, w, 1), (7, near, 1), (9, [0.0, 0.0, 1.0], 1), (5, w, 2)], SCHEMA)
    got = sorted(tuple(r)[:3] for r in pivots.near_duplicates(df).collect())
    assert got == [(3, 1, 3), (5, 0, 3), (5, 1, 3), (5, 1, 3), (7, 1, 3), (9, 0, 9)]
