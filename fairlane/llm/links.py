"""Exact clusters of near-duplicates from posting lists, without all pairs of a list.

``cluster`` takes posting lists (key, id): two items may be linked only if
they share a key. In each of the first rounds every list names one hub, and
only the hub is verified against the list's members of other clusters;
verified links merge clusters. Members that a hub has joined are never
compared with each other, since their cluster is already known. What is left
are lists of several clusters: their pairs of different clusters are held
against an upper bound of their similarity inside the tasks (long lists as
pairs of blocks), and only pairs that the bound leaves are emitted and
verified. No link between different clusters is lost.

The bound: an item's ``sketch`` counts its tokens in ``SKETCH`` hash buckets;
two items share at most the sum of the smaller counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlane.llm.common import U64, keep, mix, parts_for

HUB_ROUNDS = 3
SKETCH = 256
BLOCK = 256             # members of a long list that meet in one task
ROWS_PER_TASK = 8000


def sketch(tokens: np.ndarray) -> bytes:
    """Counts of an item's tokens in hash buckets; empty (no bound) if a count does not fit."""
    c = np.bincount((mix(tokens.view(U64)) % U64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return c.astype(np.uint8).tobytes() if c.max(initial=0) < 256 else b""


def sketches(tokens: np.ndarray, own: np.ndarray, n: int) -> list[bytes]:
    """``sketch`` of each of ``n`` items at once: ``own`` is the item of each token."""
    out = []
    bucket = (mix(tokens.view(U64)) % U64(SKETCH)).astype(np.int64)
    for at in range(0, n, 4096):
        here = (own >= at) & (own < at + 4096)
        c = np.bincount((own[here] - at) * SKETCH + bucket[here], minlength=min(4096, n - at) * SKETCH).reshape(-1, SKETCH)
        fits = c.max(axis=1) < 256
        rows = c.astype(np.uint8)
        out += [rows[i].tobytes() if fits[i] else b"" for i in range(len(rows))]
    return out


def components(edges: DataFrame, name: str = "cc") -> DataFrame | None:
    """(node, root) of every node of the undirected ``edges`` (u, v); root is the component's smallest node.

    Each round hooks every node to its smallest neighbour, shortens the
    chains, and contracts the edges to the roots. None if there are no edges.
    """
    maps: list[DataFrame] = []
    e = edges.filter("u <> v").select("u", "v")
    while True:
        e = keep(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges")
        if e.isEmpty():
            break
        both = e.union(e.select("v", "u"))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        for _ in range(2):
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            hook = hook.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
        hook = keep(hook, f"{name}-hooks")
        maps.append(hook)
        a = hook.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = hook.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        e = e.join(a, "u").join(b, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")).filter("u <> v")
    if not maps:
        return None
    out = maps[0]
    for m in maps[1:]:
        up = m.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        out = out.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
    return keep(out, f"{name}-roots")


def _merge(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels after merging the clusters that ``links`` (x, y) join."""
    lx = labels.select(F.col("id").alias("x"), F.col("comp").alias("u"))
    ly = labels.select(F.col("id").alias("y"), F.col("comp").alias("v"))
    roots = components(links.join(lx, "x").join(ly, "y").select("u", "v"), name)
    if roots is None:
        return labels
    return keep(labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), f"{name}-labels")


def _pairs(percent: int):
    """Task: pairs (x, y) of different clusters in its lists and blocks that the bound leaves."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def find(table: pa.Table) -> pa.Table:
        key, a, b, own, ids, comp, n = (np.asarray(table.column(c)) for c in ("key", "a", "b", "own", "id", "comp", "n"))
        raw = table.column("sketch").to_pylist()
        free = np.array([not r for r in raw])
        bags = np.frombuffer(b"".join(r or bytes(SKETCH) for r in raw), np.uint8).reshape(-1, SKETCH)
        order = np.lexsort((own, b, a, key))
        cut = np.flatnonzero(np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in (key, a, b)], axis=0))))
        found = []
        for s, e in zip(cut, np.append(cut[1:], len(order))):
            rows = order[s:e]
            first = rows[own[rows] == a[rows[0]]]
            second = rows[own[rows] == b[rows[0]]]
            least = -(-percent * (n[first][:, None] + n[second][None, :]) // (100 + percent))
            ok = comp[first][:, None] != comp[second][None, :]
            if a[rows[0]] == b[rows[0]]:
                ok &= ids[first][:, None] < ids[second][None, :]
            i, j = np.nonzero(ok & (np.minimum(n[first][:, None], n[second][None, :]) >= least))
            if not len(i):
                continue
            i, j = first[i], second[j]
            bound = np.concatenate([np.minimum(bags[i[k:k + 4096]], bags[j[k:k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(i), 4096)])
            good = (bound >= -(-percent * (n[i] + n[j]) // (100 + percent))) | free[i] | free[j]
            if good.any():
                x, y = ids[i[good]], ids[j[good]]
                found.append(np.stack((np.minimum(x, y), np.maximum(x, y)), 1))
        if not found:
            return schema.empty_table()
        both = np.unique(np.concatenate(found), axis=0)
        return pa.Table.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], schema=schema)

    return find


def _rest(marked: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different clusters within the lists ``marked`` (key, id, comp) that the bound leaves."""
    cuts = marked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"))
    rows = marked.join(cuts, "key").join(items, "id").withColumn("own", F.pmod(F.xxhash64("id", F.lit(9)), F.col("cuts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = rows.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    tasks = parts_for(marked.count(), ROWS_PER_TASK)
    rows = rows.withColumn("task", F.pmod(F.xxhash64("key", "a", "b"), F.lit(tasks)).cast("int"))
    rows = rows.select("task", "key", "a", "b", "own", "id", "comp", "n", "sketch")
    return rows.groupBy("task").applyInArrow(_pairs(percent), "x long, y long")


def cluster(postings: DataFrame, items: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int, name: str,
            stored: bool = False, linked: DataFrame | None = None) -> DataFrame | None:
    """(id, comp) of the ids in lists of two or more or in ``linked``; comp is the smallest linked id.

    ``postings`` has (key, id), both long, without repeats; ``items`` has (id,
    n, sketch) with the number of an item's tokens; ``verify`` takes distinct
    pairs (x, y) and returns those of Jaccard similarity ``percent`` / 100 or
    more. ``stored`` tells that ``postings`` is a written table of lists of two or more. ``linked`` has
    links (x, y) that are known beforehand. None if no list has two ids and no link is known.
    """
    if stored:
        lists = postings
    else:
        postings = keep(postings, f"{name}-postings")
        shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
        lists = keep(postings.join(shared, "key"), f"{name}-lists")
    ids = lists.select("id")
    if linked is not None:
        ids = ids.union(linked.select("x")).union(linked.select("y"))
    if ids.isEmpty():
        return None
    labels = keep(ids.distinct().withColumn("comp", F.col("id")), f"{name}-labels")
    if linked is not None:
        labels = _merge(labels, linked, f"{name}-linked")
    for turn in range(HUB_ROUNDS + 1):
        marked = lists.join(labels, "id")
        if turn or linked is not None:        # lists of several clusters stay open
            still = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
            marked = keep(marked.join(still, "key").select("key", "id", "comp"), f"{name}-open")
            if marked.isEmpty():
                break
            lists = marked.select("key", "id")
        if turn < HUB_ROUNDS:
            hub = marked.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "comp")).alias("hub"))
            found = marked.join(hub, "key").filter("comp <> hub.comp").select(F.least("id", "hub.id").alias("x"), F.greatest("id", "hub.id").alias("y"))
        else:
            found = _rest(marked, items, percent)
        links = keep(verify(found.distinct()), f"{name}-links")
        labels = _merge(labels, links, f"{name}-{turn}")
    return labels
