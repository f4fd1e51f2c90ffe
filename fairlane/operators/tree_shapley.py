"""Exact Shapley values of tree models from the trees' own paths.

The game of a row: the value of a set of features is the model's expectation
when only they are known, a split on another feature being followed both ways
by the shares of training weight below it. A leaf's part of that value is a
product over the features of its path: ``one`` (1 if the row meets all of the
path's conditions on the feature, else 0) if the feature is known, ``zero``
(the product of its splits' shares) if not. The Shapley value of a product
game is an integral over the chance t that any other feature is known,

    leaf value · (one_i − zero_i) · ∫ Π_{j≠i} (zero_j + (one_j − zero_j) t) dt,

a polynomial in t of one degree less than the path has features: Gauss-Legendre
points half as many as features give it without error. Contributions add up
to score − base, where base is the expectation without any feature.

The trees go to the tasks as arrays of leaves (checked against ``MAX_LEAVES``);
rows are explained where they are: no sampling, no background table, no
explosion into samples, no shuffle. A leaf whose path has few features has its
contributions worked out once for every pattern of met conditions; a row only
looks its patterns up. Work is rows × leaves × path length.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlane.session import checkpoint_dir

MAX_LEAVES = 2_000_000
LEAF_BLOCK = 2048               # leaves looked at together
CELLS = 1 << 20                 # rows × leaves held at once in a task
PATTERN_PLACES = 8              # path features up to which a leaf's patterns are worked out beforehand


def tree_nodes(classifier, spark) -> list[tuple[float, dict[int, tuple]]]:
    """(weight, nodes) of each tree of a fitted Spark tree, forest or boosted model, read from its saved form.

    A node is (value, training weight, left, right, feature, threshold); leaves
    have no children (-1). Values are class-1 probabilities for trees and
    forests (forests average them), and for boosted trees twice the margin:
    contributions are then to the log-odds.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    classifier.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    several = "nodeData" in data.columns
    rows = data.select("treeID", "nodeData.*") if several else data.withColumn("treeID", F.lit(0))
    if rows.count() > 2 * MAX_LEAVES:
        raise ValueError(f"the model has more than {MAX_LEAVES} leaves")
    boosted = type(classifier).__name__.startswith("GBT")
    weights = classifier.treeWeights if several else [1.0]
    scale = [2.0 * w for w in weights] if boosted else [w / sum(weights) for w in weights]
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows.collect():
        stats = r["impurityStats"]
        weight = float(stats[0]) if boosted else float(sum(stats))
        value = float(r["prediction"]) if boosted else float(stats[1]) / weight
        split = r["split"]
        if r["leftChild"] >= 0 and split["numCategories"] != -1:
            raise ValueError("splits on categories are not supported")
        at = split["leftCategoriesOrThreshold"]
        trees.setdefault(r["treeID"], {})[r["id"]] = (value, weight, r["leftChild"], r["rightChild"], split["featureIndex"], at[0] if at else 0.0)
    return [(scale[t], trees[t]) for t in sorted(trees)]


def leaf_table(trees) -> tuple[list, float]:
    """(paths, base): per leaf its value and, per feature of its path, (feature, over, up to, share); and the expectation."""
    paths, base = [], 0.0
    for scale, nodes in trees:
        stack = [(0, {}, 1.0)]
        while stack:
            i, known, reach = stack.pop()
            value, weight, left, right, feature, threshold = nodes[i]
            if left < 0:
                base += scale * value * reach
                paths.append((scale * value, [(f, *k) for f, k in known.items()]))
                continue
            for child, below in ((left, True), (right, False)):
                over, upto, zero = known.get(feature, (-np.inf, np.inf, 1.0))
                share = nodes[child][1] / weight
                now = (over, min(upto, threshold), zero * share) if below else (max(over, threshold), upto, zero * share)
                stack.append((child, {**known, feature: now}, reach * share))
    return paths, base


def leaf_arrays(paths: list) -> list[tuple]:
    """Blocks of leaves of like path length: value, feature, over, up to, share (a missing place changes nothing)."""
    if len(paths) > MAX_LEAVES:
        raise ValueError(f"the model has more than {MAX_LEAVES} leaves")
    paths = sorted((p for p in paths if p[1]), key=lambda p: len(p[1]))
    blocks = []
    for at in range(0, len(paths), LEAF_BLOCK):
        part = paths[at:at + LEAF_BLOCK]
        d = len(part[-1][1])
        feature = np.zeros((d, len(part)), np.int64)
        over, upto, zero = np.full((d, len(part)), -np.inf), np.full((d, len(part)), np.inf), np.ones((d, len(part)))
        for leaf, (_, known) in enumerate(part):
            for k, (f, a, b, z) in enumerate(known):
                feature[k, leaf], over[k, leaf], upto[k, leaf], zero[k, leaf] = f, a, b, z
        blocks.append((np.array([p[0] for p in part]), feature, over, upto, zero))
    return blocks


def _gains(one: np.ndarray, value: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Contributions (rows × places × leaves) of the places of leaves whose conditions are met or not as ``one`` says."""
    points, weights = np.polynomial.legendre.leggauss((zero.shape[0] + 1) // 2)
    gain = np.zeros_like(one)
    for t, w in zip((points + 1) / 2, weights / 2):
        factor = zero + (one - zero) * t                                    # over 0, as t is under 1 and shares are over 0
        gain += w * factor.prod(axis=1, keepdims=True) / factor
    return gain * ((one - zero) * value)


def pattern_tables(block: tuple) -> tuple[np.ndarray, list]:
    """For a block of leaves: each leaf's first place among all patterns; and per feature the cuts, per interval between
    them (the last row: not a number) the bits that a value there sets in the leaves' patterns, the feature's leaves and
    the contributions by leaf and pattern."""
    value, feature, over, upto, zero = block
    d, n = feature.shape
    one = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)[:, :, None]
    gain = _gains(np.broadcast_to(one, (1 << d, d, n)), value, zero)
    asks = (over > -np.inf) | (upto < np.inf)
    first = (np.arange(n) << d) + (~asks << np.arange(d)[:, None]).sum(axis=0)          # a missing place is always met
    lists = []
    for f in np.unique(feature):
        place, leaf = np.nonzero((feature == f) & asks)
        if not len(leaf):
            continue
        ends = np.concatenate([over[place, leaf], upto[place, leaf]])
        cuts = np.unique(ends[np.isfinite(ends)])
        inside = np.concatenate([cuts, [np.inf, np.nan]])[:, None]
        met = np.zeros((len(inside), n), np.int64)
        met[:, leaf] = ((inside > over[place, leaf]) & (inside <= upto[place, leaf])) << place
        table = np.zeros((n, 1 << d))
        table[leaf] = gain[:, place, leaf].T
        lists.append((f, cuts, met, leaf, table.ravel()))
    return first, lists


def shapley(x: np.ndarray, blocks: list[tuple], n_features: int) -> np.ndarray:
    """Contributions (rows × features) of rows ``x`` to the sum of the leaves' game."""
    out = np.zeros((len(x), n_features))
    for block in blocks:
        value, feature, over, upto, zero = block
        d, n = feature.shape
        step = max(1, CELLS // n)
        if d <= PATTERN_PLACES and len(x) * n > n << d:
            first, lists = pattern_tables(block)
            where = []
            for f, cuts, *_ in lists:
                at = np.searchsorted(cuts, x[:, f])
                at[np.isnan(x[:, f])] = len(cuts) + 1
                where.append(at)
            step = max(1, step // 32)                                       # what is looked up stays near the processor
            for at in range(0, len(x), step):
                pattern = sum((met[w[at:at + step]] for w, (_, _, met, _, _) in zip(where, lists)), first).T.copy()
                for f, _, _, leaf, table in lists:
                    out[at:at + step, f] += table.take(pattern[leaf]).sum(axis=0)
            continue
        for at in range(0, len(x), step):
            part = x[at:at + step]
            v = part[:, feature]                                            # rows × places × leaves
            one = ((v > over) & (v <= upto)).astype(float)
            gain = _gains(one, value, zero)
            for k in range(d):
                for f in np.unique(feature[k]):
                    out[at:at + step, f] += gain[:, k, feature[k] == f].sum(axis=1)
    return out


def tree_contributions(model: PipelineModel, df: DataFrame, features: list[str], key: str = "application_id") -> DataFrame:
    """M21 (tree models): exact ``(key, feature, contribution, base, score)`` for every row and feature.

    ``score`` is what is explained: the class-1 probability of a tree or
    forest, the log-odds of boosted trees. Σ contributions = score − base.
    """
    classifier = model.stages[-1]
    paths, base = leaf_table(tree_nodes(classifier, df.sparkSession))
    blocks = df.sparkSession.sparkContext.broadcast(leaf_arrays(paths))
    boosted = type(classifier).__name__.startswith("GBT")
    score = vector_to_array(F.col("rawPrediction"))[1] * 2.0 if boosted else vector_to_array(F.col("probability"))[1]
    rows = model.transform(df).select(F.col(key), vector_to_array("features").alias("x"), score.alias("score"))

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(features))
            phi = shapley(x, blocks.value, len(features))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(features), pa.int32()), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists, batch.column("score")], [key, "phi", "score"])

    id_type = rows.schema[key].dataType.simpleString()
    explained = rows.mapInArrow(run, f"`{key}` {id_type}, phi array<double>, score double")
    cells = F.arrays_zip(F.array(*[F.lit(c) for c in features]).alias("feature"), F.col("phi").alias("contribution"))
    return explained.select(key, F.inline(cells), F.lit(float(base)).alias("base"), "score").toDF(key, "feature", "contribution", "base", "score")
