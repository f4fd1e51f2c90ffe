"""Prefix sums and quantiles: the ranged plan equals the plain one, hot, rare
and null keys, and a plan for very many keys without their cut points."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlane.operators import prefix, windows
from fairlane.operators.quantiles import column_quantiles, exact_quantiles, fitted_quantiles


@pytest.mark.parametrize("per_range", [None, 50])
@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_equal_a_plain_loop(spark, per_range, descending):
    rng = random.Random(3)
    rows = [("hot", v, rng.randrange(9)) for v in range(700)] + [(k, v, rng.randrange(9)) for k in ("a", None, "b") for v in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "k string, v int, c long")
    got = prefix.ordered_prefix_sums(df, "k", "v", ["c"], descending, totals=True, rows_per_range=per_range)
    want = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=descending)
        run = np.cumsum([r[2] for r in mine])
        want += [(*r, int(s), int(run[-1])) for r, s in zip(mine, run)]
    key = (lambda r: (r[0] is None, r[0] or "", r[1]))
    assert sorted((tuple(r) for r in got.select("k", "v", "c", "cum_c", "tot_c").collect()), key=key) == sorted(want, key=key)
    assert prefix.ordered_prefix_sums(df.limit(0), "k", "v", ["c"], rows_per_range=per_range).count() == 0


def test_ranges_follow_the_row_count_and_split_a_hot_key(spark):
    df = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    t, several = prefix.ordered_ranges(df, "k", "v", 100)
    assert several and t.select("_b").distinct().count() > 10 and t.groupBy("_b").count().agg(F.max("count")).first()[0] < 400
    assert not prefix.ordered_ranges(spark.range(2000).select(F.col("id").alias("k"), F.lit(1).alias("v")), "k", "v", 100)[1]


@pytest.mark.parametrize("per_range", [None, 60])
def test_quantiles_equal_numpy(spark, per_range, monkeypatch):
    if per_range:
        monkeypatch.setattr(prefix, "ROWS_PER_RANGE", per_range)
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 3}", float(v), float(round(v))) for i, v in enumerate(rng.normal(0, 9, 900))] + [("empty", None, None), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {(r["g"], r["column"]): r["quantiles"] for r in column_quantiles(df, ["v", "w"], ps, "g").collect()}
    for g in ("g0", "g1", "g2", None):
        for j, c in ((1, "v"), (2, "w")):
            x = [r[j] for r in rows if r[0] == g and r[j] is not None]
            assert got[g, c] == ([pytest.approx(q) for q in np.quantile(x, ps)] if x else [None] * len(ps))
    assert got["empty", "v"] == [None] * len(ps)
    assert fitted_quantiles(df.where("g = 'empty'"), ["v"], [0.5]) == {"v": []}


def test_hundred_thousand_keys(spark):
    df = spark.range(400_000).select((F.col("id") % 100_000).alias("g"), (F.col("id") / 7.0).alias("v"))
    t0 = time.perf_counter()
    q = exact_quantiles(df, "g", "v", [0.5], "m")
    planned = time.perf_counter() - t0
    assert planned < 60 and len(q._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert q.agg(F.count("*"), F.count("m")).first()[:] == (100_000, 100_000)
    assert q.where("g = 5").first()["m"][0] == pytest.approx((5 / 7 + 300_005 / 7) / 2)


@pytest.mark.parametrize("per_range", [None, 40])
def test_fill_gaps_over_ranges(spark, per_range):
    rng = random.Random(8)
    rows = [(k, i, rng.choice([None, None, None, float(i)])) for k in ("hot", "b", None) for i in range(300 if k == "hot" else 9)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    got = {(r["k"], r["t"]): r["x"] for r in windows.fill_gaps(df, "x", "t", "k", rows_per_range=per_range).collect()}
    for k in ("hot", "b", None):
        mine = [r[2] for r in rows if r[0] == k]
        for i, v in enumerate(mine):
            before = [x for x in mine[:i + 1] if x is not None]
            after = [x for x in mine[i:] if x is not None]
            assert got[k, i] == (before[-1] if before else after[0] if after else None)
