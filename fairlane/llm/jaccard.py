"""N-gram Jaccard join by prefix filters under several global token orders.

Every document is its set of distinct 5-word shingles; documents link when
``100 * |intersection| >= 80 * |union|``.

1. Signatures: one row per document with the size and a 64-bit hash of its
   set. Documents with equal sets are one class from here on, so copies never
   meet again, however many they are.
2. Document frequencies: tasks send (token, class) entries, packed into
   binary blocks per token bucket; a bucket returns the tokens that occur in
   two classes or more, with their frequency class (cut off at 63; tokens
   above are ordered by hash alone).
3. Orders: rare tokens first, ties broken by the token's hash (order 1) or by
   one of two other hashes (orders 2 and 3). A linked pair shares at least
   ``ceil(0.8 n)`` tokens, so each of its documents has a shared token among
   the first ``n - ceil(0.8 n) + 1`` of EVERY order. Tokens of one class only
   come first and match nothing; a document of which more than a fifth is
   unique has no prefix left and leaves here.
4. Candidates share a prefix token under order 1; the prefixes under orders 2
   and 3 must overlap too before the exact check of the two token sets.
   ``links.cluster`` does this from hubs, without all pairs of a list.

Tokens are bucket and 36 more hash bits within 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlane.llm.common import U64, bytes_of, chunks, keep, long, mix, parts_for, prepare, set_hash, shingles, text_bytes, word_hashes, word_spans
from fairlane.llm.links import cluster, sketch

WORDS = 5
BUCKET_BYTES = 16 << 20         # text whose tokens one bucket gets; less takes less memory and sends more
FP_BITS, BUCKET_BITS = 36, 22   # of a token; 6 bits for the frequency class lie above
CLASSES = 63
ORDER_SEEDS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)


def _sets(chunk, k: int):
    data, off = bytes_of(chunk.column("text"))
    start, end, owner = word_spans(data, off)
    return shingles(word_hashes(data, start, end), owner, chunk.num_rows, k)


def signatures(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, s1): size and 64-bit hash of each document's shingle set."""
    def sign(batches):
        for chunk in chunks(batches):
            sh, off = _sets(chunk, k)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(np.diff(off)), long(set_hash(sh, off, 1))], ["doc_id", "n_shingles", "s1"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, s1 long")


def _entries(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """(bucket, block): the tokens of a chunk's classes that fall in the bucket."""
    def pack(batches):
        for chunk in chunks(batches):
            sh, off = _sets(chunk, k)
            ids = set_hash(sh, off, 1)
            _, one = np.unique(ids, return_index=True)
            one = one[np.diff(off)[one] > 0]
            if not len(one):
                continue
            size = np.diff(off)[one]
            at = np.repeat(off[:-1][one] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            sh, own = sh[at], np.repeat(np.arange(len(one)), size)
            b = ((sh >> U64(FP_BITS)) % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(b, kind="stable")
            b, own, fp = b[order], own[order], sh[order] & U64((1 << FP_BITS) - 1)
            cut = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (own[1:] != own[:-1]))))
            runs = np.diff(np.append(cut, len(b)))
            rb = b[cut]
            edge = np.flatnonzero(np.concatenate(([True], rb[1:] != rb[:-1])))
            low, high = fp.astype(np.uint32), (fp >> U64(32)).astype(np.uint8)
            who, n = ids[one][own[cut]], size[own[cut]].astype(np.uint32)
            out_b, out = [], []
            for i, j in zip(edge, np.append(edge[1:], len(cut))):
                s, e = cut[i], cut[j] if j < len(cut) else len(b)
                out_b.append(int(rb[i]))
                out.append(b"".join((np.array([j - i, e - s], np.uint32).tobytes(), who[i:j].tobytes(), n[i:j].tobytes(),
                                     runs[i:j].astype(np.uint32).tobytes(), low[s:e].tobytes(), high[s:e].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out, pa.binary())], ["bucket", "block"])

    return docs.select("text").mapInArrow(pack, "bucket int, block binary")


def _unpack(blocks: list[bytes]):
    who, n, runs, fp = [], [], [], []
    for raw in blocks:
        m, e = np.frombuffer(raw, np.uint32, 2)
        at = 8
        who.append(np.frombuffer(raw, U64, m, at))
        n.append(np.frombuffer(raw, np.uint32, m, at + 8 * m))
        runs.append(np.frombuffer(raw, np.uint32, m, at + 12 * m))
        at += 16 * int(m)
        fp.append(np.frombuffer(raw, np.uint32, e, at).astype(U64) | (np.frombuffer(raw, np.uint8, e, at + 4 * int(e)).astype(U64) << U64(32)))
    return np.concatenate(who), np.concatenate(n), np.concatenate(runs).astype(np.int64), np.concatenate(fp)


def _shared_tokens(entries: DataFrame, parts: int) -> DataFrame:
    """(part, block): each class's tokens that another class has too, with their frequency class, packed by class."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary())])

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        who, n, runs, fp = _unpack(table.column("block").to_pylist())
        _, one = np.unique(who, return_index=True)          # a class that several chunks sent counts once
        first = np.zeros(len(who), bool)
        first[one] = True
        fp, own = fp[np.repeat(first, runs)], np.repeat(np.flatnonzero(first), runs[first])
        order = np.argsort(fp, kind="stable")
        s = fp[order]
        cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        df = np.repeat(np.diff(np.append(cut, len(s))), np.diff(np.append(cut, len(s))))
        many = df > 1
        own = own[order][many]
        tok = (np.minimum(df[many], CLASSES).astype(U64) << U64(58)) | (U64(bucket) << U64(FP_BITS)) | s[many]
        part = (who[own] % U64(parts)).astype(np.int64)
        order = np.lexsort((own, part))
        own, tok, part = own[order], tok[order], part[order]
        if not len(own):
            return schema.empty_table()
        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        runs = np.diff(np.append(cut, len(own))).astype(np.uint32)
        ids, size, p = who[own[cut]], n[own[cut]].astype(np.uint32), part[cut]
        edge = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        out = []
        for i, j in zip(edge, np.append(edge[1:], len(cut))):
            s, e = cut[i], cut[j] if j < len(cut) else len(tok)
            out.append(b"".join((np.array([j - i, e - s], np.uint32).tobytes(), ids[i:j].tobytes(), size[i:j].tobytes(), runs[i:j].tobytes(), tok[s:e].tobytes())))
        return pa.Table.from_arrays([pa.array(p[edge].astype(np.int32)), pa.array(out, pa.binary())], schema=schema)

    return entries.groupBy("bucket").applyInArrow(count, "part int, block binary")


def _prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(id, n, sketch, toks, p1, p2, p3) of the classes whose prefixes are not empty."""
    arr = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("toks", arr), ("p1", arr), ("p2", arr), ("p3", arr)])

    def order(table: pa.Table) -> pa.Table:
        ids, sizes, runs, tok = [], [], [], []
        for raw in table.column("block").to_pylist():
            m, e = np.frombuffer(raw, np.uint32, 2)
            ids.append(np.frombuffer(raw, np.int64, m, 8))
            sizes.append(np.frombuffer(raw, np.uint32, m, 8 + 8 * int(m)))
            runs.append(np.frombuffer(raw, np.uint32, m, 8 + 12 * int(m)))
            tok.append(np.frombuffer(raw, U64, e, 8 + 16 * int(m)))
        ids, runs, tok = np.concatenate(ids), np.concatenate(runs).astype(np.int64), np.concatenate(tok)
        u, inv = np.unique(ids, return_inverse=True)
        n = np.zeros(len(u), np.int64)
        n[inv] = np.concatenate(sizes)
        tok = tok[np.argsort(np.repeat(inv, runs), kind="stable")]
        off = np.concatenate(([0], np.cumsum(np.bincount(inv, weights=runs, minlength=len(u)).astype(np.int64))))
        need = -(-percent * n // 100)
        out = {f: [] for f in schema.names}
        for i in np.flatnonzero(np.diff(off) >= need):
            t = np.sort(tok[off[i]:off[i + 1]])
            p = len(t) - need[i] + 1
            out["id"].append(u[i])
            out["n"].append(n[i])
            out["sketch"].append(sketch(t))
            out["toks"].append(t.view(np.int64))
            out["p1"].append(t[:p].view(np.int64))
            for f, seed in zip(("p2", "p3"), ORDER_SEEDS):
                out[f].append(t[np.lexsort((mix(t ^ U64(seed)), t >> U64(58)))[:p]].view(np.int64))
        return pa.Table.from_pydict(out, schema=schema)

    return shared.groupBy("part").applyInArrow(order, "id long, n int, sketch binary, toks array<long>, p1 array<long>, p2 array<long>, p3 array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose prefixes overlap under the other orders and whose sets are similar enough."""
    x = sets.select(*[F.col(c).alias(f"x_{c}") for c in ("id", "n", "toks", "p2", "p3")])
    y = sets.select(*[F.col(c).alias(f"y_{c}") for c in ("id", "n", "toks", "p2", "p3")])
    both = pairs.join(y, F.col("y") == F.col("y_id")).join(x, F.col("x") == F.col("x_id"))
    both = both.filter(
        (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent)
        & F.arrays_overlap("x_p2", "y_p2") & F.arrays_overlap("x_p3", "y_p3"))
    shared = F.size(F.array_intersect("x_toks", "y_toks"))
    return both.filter(shared * 100 >= (F.col("x_n") + F.col("y_n") - shared) * percent).select("x", "y")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = 80,
                       bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``.

    component_id is the smallest id reachable by links of Jaccard similarity
    ``percent`` / 100 or more; null and empty texts (no words) have an empty
    set and are their own component. Rows that repeat an id or a text, ties
    and a null id are allowed: equal texts always share a component, and null
    ids are ignored when the smallest is taken (a component of null ids only
    has a null component_id). Other columns are not read. An empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = text_bytes(docs)
    buckets = parts_for(size, bucket_bytes, 1 << BUCKET_BITS)
    sigs = keep(signatures(docs, k), "jaccard-sigs")
    shared = _shared_tokens(_entries(docs, k, buckets), buckets)
    sets = keep(_prefixes(shared, percent), "jaccard-sets")
    comps = cluster(sets.select(F.explode("p1").alias("key"), "id").distinct(), sets.select("id", "n", "sketch"),
                    lambda pairs: _verified(pairs, sets, percent), percent, "jaccard")
    full, empty = sigs.filter("n_shingles > 0"), sigs.filter("n_shingles = 0")
    if comps is None:
        full = full.withColumn("comp", F.col("s1"))
    else:
        full = full.join(comps.withColumnRenamed("id", "s1"), "s1", "left").withColumn("comp", F.coalesce("comp", "s1"))
    least = full.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return full.join(least, "comp").select("doc_id", "n_shingles", "component_id").union(
        empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_per_group(docs: DataFrame, bucket_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) whose id is their component's smallest; rows with a null id stay.

    Smaller buckets than the join's own, for workers that other stages used before.
    """
    keepers = jaccard_components(docs, bucket_bytes=bucket_bytes).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.filter("doc_id IS NULL").unionByName(docs.join(keepers, "doc_id", "left_semi"))
