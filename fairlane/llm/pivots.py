"""Near-duplicate embeddings by a pivot-permutation index.

``PIVOTS`` reference vectors are chosen from a sample of ``SAMPLE`` vectors
drawn by hash (documented bounds), none of which is nearer than ``APART`` to
another, so that a crowded group does not fill the list. Every vector is described by its ``NEAREST`` nearest pivots in order;
inverted lists (label, pivot) hold the vectors that have the pivot among them.
Within a list, vectors that share at least ``SHARED`` pivots are candidates,
counted by products of 0/1 pivot rows, and verified by their cosine in double
precision. A pair is taken in the list of its smallest shared pivot only, so
it counts once.

Equal vectors are one class with a count, so copies don't multiply. A list of
more than ``BLOCK`` classes is cut into blocks by hash and worked off as pairs
of blocks, each a task's matrix product; nothing but counts and spanning
edges leaves a block, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlane.llm.common import keep, prepare
from fairlane.llm.links import components

PIVOTS, NEAREST, SHARED = 256, 8, 2
SAMPLE, APART = 2048, 0.7
BLOCK = 1024
COSINE = 0.93


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _coded(vectors: DataFrame) -> DataFrame:
    """Adds v: the vector as packed doubles, null if it is null, empty, zero or has a null or non-finite component."""
    def code(batches):
        for batch in batches:
            out = []
            for x in batch.column("embedding").to_pylist():
                a = np.array([np.nan if c is None else c for c in x or ()], "<f8")
                out.append(a.tobytes() if len(a) and np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "v"])

    return vectors.mapInArrow(code, "vec_id long, label string, v binary")


def _choose(vectors: np.ndarray, pivots: int) -> np.ndarray:
    """The first vectors of which none is nearer than ``APART`` to an earlier one."""
    chosen: list[int] = []
    for i in range(len(vectors)):
        if len(chosen) == pivots:
            break
        if not chosen or (vectors[chosen] @ vectors[i]).max() < APART:
            chosen.append(i)
    return vectors[chosen]


def _lists(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """(label, dim, pivot, id, copies, v, perm): each class in the lists of its nearest pivots."""
    def place(batches):
        for batch in batches:
            rows = batch.to_pydict()
            dims = np.array(rows["dim"])
            out: dict[str, list] = {f: [] for f in ("label", "dim", "pivot", "id", "copies", "v", "perm")}
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                p = pivots.get(int(d))
                sims = _units([rows["v"][i] for i in at], d) @ p.T if p is not None else np.zeros((len(at), 1))
                k = min(nearest, sims.shape[1])
                near = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                for i, perm in zip(at, near):
                    for pivot in perm:
                        for f, x in zip(out, (rows["label"][i], int(d), int(pivot), rows["id"][i], rows["copies"][i], rows["v"][i], perm.tolist())):
                            out[f].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=LISTS)

    return classes.mapInArrow(place, "label string, dim int, pivot int, id long, copies long, v binary, perm array<int>")


LISTS = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("pivot", pa.int32()), ("id", pa.int64()), ("copies", pa.int64()),
                   ("v", pa.binary()), ("perm", pa.list_(pa.int32()))])
FOUND = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _block(table: pa.Table, shared: int, cosine: float) -> pa.Table:
    """For each class of the two blocks: copies it links with, and the smallest id that links within the blocks reach."""
    rows = table.to_pydict()
    a, b = rows["a"][0], rows["b"][0]
    own, dim, pivot = np.array(rows["own"]), rows["dim"][0], rows["pivot"][0]
    ids, copies = np.array(rows["id"]), np.array(rows["copies"])
    order = np.argsort(ids, kind="stable")
    x, y = order[own[order] == a], order[own[order] == b]
    v = _units(rows["v"], dim)
    link = v[x] @ v[y].T >= cosine
    if a == b:
        np.fill_diagonal(link, False)
    if link.any():
        used, cols = np.unique(np.concatenate(rows["perm"]), return_inverse=True)
        has = np.zeros((len(ids), len(used)), np.float32)
        has[np.repeat(np.arange(len(ids)), [len(p) for p in rows["perm"]]), cols] = 1
        lower = has[:, used < pivot]
        link &= (has[x] @ has[y].T >= min(shared, max(map(len, rows["perm"])))) & (lower[x] @ lower[y].T == 0)
    if not link.any():
        return FOUND.empty_table()
    links = np.zeros(len(ids), np.int64)
    root = ids.copy()
    np.add.at(links, x, link @ copies[y])
    if a != b:
        np.add.at(links, y, copies[x] @ link)
    big = np.iinfo(np.int64).max
    while True:
        was = root.copy()
        root[x] = np.minimum(root[x], np.where(link, root[y][None, :], big).min(1))
        root[y] = np.minimum(root[y], np.where(link, root[x][:, None], big).min(0))
        if (was == root).all():
            break
    some = links > 0
    return pa.Table.from_arrays([pa.array(ids[some]), pa.array(root[some]), pa.array(links[some])], schema=FOUND)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK,
                    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal length link when their cosine
    is ``cosine`` or more. A vector that is null, empty or zero or holds a
    null or non-finite component, or has a null label or id, links with
    nothing and is its own component. Rows that repeat a vector link with each
    other and with all that the vector links with; rows that repeat an id are
    one node of the components. Other columns are not read; an empty table
    gives an empty result.
    """
    prepare(vectors.sparkSession)
    rows = _coded(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("embedding")))
    rows = keep(rows.withColumn("h1", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64("v"))).withColumn(
        "h2", F.xxhash64(F.lit(1), "v")).withColumn("dim", (F.octet_length("v") / 8).cast("int")), "pivot-vectors")
    usable = rows.filter("v IS NOT NULL AND h1 IS NOT NULL")
    classes = keep(usable.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("v").alias("v"))
                   .withColumn("id", F.monotonically_increasing_id()), "pivot-classes")      # numbers of their own: an id may have several vectors
    placed = keep(rows.join(classes.select("label", "dim", "h1", "h2", "id"), ["label", "dim", "h1", "h2"], "left").select("vec_id", "id"), "pivot-placed")
    chosen: dict[int, list[bytes]] = {}
    for r in classes.select("dim", "v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect():
        chosen.setdefault(r["dim"], []).append(r["v"])
    table = {d: _choose(_units(raw, d), pivots) for d, raw in chosen.items()}
    lists = keep(_lists(classes.select("label", "dim", "id", "copies", "v"), table, nearest), "pivot-lists")
    cuts = lists.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").withColumn("cuts", F.ceil(F.col("c") / block).cast("int")).drop("c")
    dealt = lists.join(cuts, ["label", "dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    found = keep(dealt.groupBy("label", "dim", "pivot", "a", "b").applyInArrow(lambda t: _block(t, shared, cosine), "id long, root long, links long"), "pivot-found")
    # classes that share a vector id are one node
    nodes = placed.filter("id IS NOT NULL").distinct()
    low = nodes.groupBy("vec_id").agg(F.min("id").alias("u"), F.max("id").alias("top")).filter("u < top").drop("top")
    same = nodes.join(low, "vec_id").filter("id <> u").select("u", F.col("id").alias("v"))
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(same), "pivot")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = classes.select("id", "first", "copies").join(linked, "id", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    if roots is not None:
        classes = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        classes = classes.join(classes.groupBy("root").agg(F.min("first").alias("component")), "root")
    else:
        classes = classes.withColumn("component", F.col("first"))
    out = placed.join(classes.select("id", "n_links", "component"), "id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
