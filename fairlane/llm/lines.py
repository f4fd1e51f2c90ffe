"""Line dedup by a deletion-neighbourhood join.

Two lines match when deleting at most one word from each makes them equal: a
word more, less, changed or moved. Equivalently they share a variant, where
the variants of a line are itself and all that have one word deleted. As
matching is sharing a variant, the earliest line of a variant matches every
other line of it, and one look at that line per variant finds, for every line,
whether an earlier line matches: no pairs within a variant are needed.

Variants meet by their longest word (ties: greatest hash). Every variant of a
line has the line's longest word, except the one that lacks it, which has the
second longest. So a line travels at most twice, and its variants are hashed
and sorted by the task that holds the word's bucket. Equal lines of one batch
travel once, by their earliest place; a line of which the corpus is full
reaches a bucket once per batch.

Lines of fewer than ``MIN_WORDS`` words have no variants but themselves: on
request they take part in the match of equal lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlane.llm.common import U64, binaries, bytes_of, chunks, keep, long, mix, parts_for, prepare, text_bytes, word_hashes, word_spans

MIN_WORDS = 6                   # shorter lines say too little to be judged by one word
BUCKET_BYTES = 5 << 20
_C = U64(0xC2B2AE3D27D4EB4F)
_C_INV = U64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


class _Lines:
    """Words of many lines: hashes, and for each line its first and last+1 word, its longest word and the next."""

    def __init__(self, data: np.ndarray, off: np.ndarray, line_of=None):
        start, end, owner = word_spans(data, off)
        line = owner if line_of is None else line_of(start, owner)
        self.hash = word_hashes(data, start, end)
        self.lo = _runs(line)
        self.hi = np.append(self.lo[1:], len(line))
        self.line, self.start, self.end = line[self.lo], start, end
        self.n = self.hi - self.lo
        key = (np.minimum(end - start, 0xFFFF).astype(U64) << U64(48)) | (self.hash >> U64(16))
        if len(self.lo):
            self.first = np.maximum.reduceat(key, self.lo)
            is_first = key == np.repeat(self.first, self.n)
            self.often = np.add.reduceat(is_first.astype(np.int64), self.lo)
            self.where = self.lo + np.maximum.reduceat(np.where(is_first, np.arange(len(key)) - np.repeat(self.lo, self.n), 0), self.lo)
            self.second = np.maximum.reduceat(np.where(is_first & (np.repeat(self.often, self.n) == 1), U64(0), key), self.lo)
        else:
            self.first = self.second = np.zeros(0, U64)
            self.often = self.where = np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            m = len(key)
            p = np.ones(m + 1, U64)
            q = np.ones(m + 1, U64)
            p[1:], q[1:] = np.cumprod(np.full(m, _C)), np.cumprod(np.full(m, _C_INV))
            self.inv = q
            self.sum = np.concatenate((np.zeros(1, U64), np.cumsum(self.hash * p[:m])))

    def whole(self, seed: int = 0) -> np.ndarray:
        """Hash of each line's words; another one for another ``seed``."""
        if not len(self.lo):
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            if seed:
                place = self.inv[np.arange(len(self.hash)) - np.repeat(self.lo, self.n)]
                return mix(np.add.reduceat(mix(self.hash ^ U64(seed)) * place, self.lo) + self.n.astype(U64))
            return mix((self.sum[self.hi] - self.sum[self.lo]) * self.inv[self.lo] + self.n.astype(U64) * U64(0x9E3779B1))

    def without(self, words: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Hash of each line with one of its words deleted."""
        lo, hi = self.lo[lines], self.hi[lines]
        with np.errstate(over="ignore"):
            rest = (self.sum[words] - self.sum[lo]) + (self.sum[hi] - self.sum[words + 1]) * _C_INV
            return mix(rest * self.inv[lo] + (hi - lo - 1).astype(U64) * U64(0x9E3779B1))


def _batch_lines(chunk, least: int = MIN_WORDS) -> tuple[_Lines, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of ``least`` words or more: (lines, text number, line number, selected, bytes)."""
    data, off = bytes_of(chunk.column("text"))
    feed = np.flatnonzero(data == 10)
    # a line's number over the whole chunk: texts and line feeds before it
    ln = _Lines(data, off, lambda start, owner: np.searchsorted(feed, start, "right") + owner)
    text = np.searchsorted(off[1:], ln.start[ln.lo], "right") if len(ln.lo) else np.zeros(0, np.int64)
    number = ln.line - text - np.searchsorted(feed, off[:-1][text], "left")
    return ln, text, number, np.flatnonzero(ln.n >= least), data


def _places(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, line_no, h1, h2) of every line that takes part."""
    def place(batches):
        for chunk in chunks(batches):
            ln, text, number, sel, _ = _batch_lines(chunk, least)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id").take(pa.array(text[sel])), pa.array(number[sel].astype(np.int32)), long(ln.whole()[sel]), long(ln.whole(7)[sel])],
                ["doc_id", "line_no", "h1", "h2"])

    return docs.mapInArrow(place, "doc_id long, line_no int, h1 long, h2 long")


def _travel(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, doc_id, line_no, longest, line): each distinct line of a batch for its longest and its second longest word."""
    def send(batches):
        for chunk in chunks(batches):
            ln, text, number, sel, data = _batch_lines(chunk)
            if not len(sel):
                continue
            doc = np.array([np.iinfo(np.int64).min if d is None else d for d in chunk.column("doc_id").to_pylist()])
            whole = ln.whole()
            order = sel[np.lexsort((number[sel], doc[text[sel]], whole[sel]))]
            one = order[_runs(whole[order])]
            two = one[ln.second[one] != ln.first[one]]
            pick = np.concatenate((one, two))
            key = np.concatenate((ln.first[one], ln.second[two]))
            s, e = ln.start[ln.lo[pick]], ln.end[ln.hi[pick] - 1]
            size = e - s
            off = np.concatenate(([0], np.cumsum(size)))
            body = data[np.repeat(s - off[:-1], size) + np.arange(off[-1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array((mix(key) % U64(buckets)).astype(np.int32)), chunk.column("doc_id").take(pa.array(text[pick])),
                 pa.array(number[pick].astype(np.int32)), pa.array(np.arange(len(pick)) < len(one)), binaries(body, off)],
                ["bucket", "doc_id", "line_no", "longest", "line"])

    return docs.mapInArrow(send, "bucket int, doc_id long, line_no int, longest boolean, line binary")


NEAR = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int32())])


def _join_variants(table: pa.Table) -> pa.Table:
    """(h1, h2, doc_id, line_no): lines of the bucket that an earlier, different line matches, with that line's place."""
    table = table.combine_chunks()
    doc = np.array([np.iinfo(np.int64).min if d is None else d for d in table.column("doc_id").to_pylist()])
    number = np.asarray(table.column("line_no"))
    longest = table.column("longest").to_numpy(zero_copy_only=False)
    data, off = bytes_of(table.column("line").chunk(0) if table.column("line").num_chunks else pa.array([], pa.binary()))
    ln = _Lines(data, off)
    whole, other = ln.whole(), ln.whole(7)
    # the earliest place of each content, for each of its two words
    order = np.lexsort((number, doc, longest, whole))
    w, t = whole[order], longest[order]
    order = order[np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (t[1:] != t[:-1]))))]
    place = np.lexsort((number, doc))
    rank = np.empty(len(doc), np.int64)
    rank[place] = np.arange(len(doc))
    tops, seconds = order[longest[order]], order[~longest[order]]
    lines = np.repeat(tops, ln.n[tops])
    words = np.concatenate([np.arange(a, b) for a, b in zip(ln.lo[tops], ln.hi[tops])]) if len(tops) else np.zeros(0, np.int64)
    stays = (words != ln.where[lines]) | (ln.often[lines] > 1)      # the longest word is still there
    lines, words = np.concatenate((lines[stays], seconds)), np.concatenate((words[stays], ln.where[seconds]))
    v = np.concatenate((whole[tops], ln.without(words, lines)))
    lines, words = np.concatenate((tops, lines)), np.concatenate((np.full(len(tops), -1), words))
    seq = np.lexsort((rank[lines], v))
    v, lines, words = v[seq], lines[seq], words[seq]
    cut = _runs(v)
    hub = np.repeat(cut, np.diff(np.append(cut, len(v))))
    cand = np.flatnonzero(whole[lines] != whole[lines[hub]])
    out = {f: [] for f in NEAR.names}
    for i in cand:
        x, y, a, b = lines[hub[i]], lines[i], words[hub[i]], words[i]
        left = [w for k, w in enumerate(ln.hash[ln.lo[x]:ln.hi[x]].tolist()) if k + ln.lo[x] != a]
        right = [w for k, w in enumerate(ln.hash[ln.lo[y]:ln.hi[y]].tolist()) if k + ln.lo[y] != b]
        if left == right:
            for f, z in zip(out, (whole[y].view(np.int64), other[y].view(np.int64), doc[x], number[x])):
                out[f].append(int(z))
    out["doc_id"] = [None if d == np.iinfo(np.int64).min else d for d in out["doc_id"]]
    return pa.Table.from_pydict(out, schema=NEAR)


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """One row per dropped line: doc_id, line_no (from 0), kept_doc_id, kept_line_no, near.

    Lines are cut at line feeds; words at ASCII white space, A-Z as a-z. A
    line of ``MIN_WORDS`` words or more is dropped when an earlier line, by
    (doc_id, line_no), matches it; the earliest matching line found is given,
    and near tells that the two differ. With ``short`` a line of fewer words
    (one at least) is dropped when an earlier line equals it. A null id counts as the smallest; rows
    that repeat an id are the same document, so lines of equal number in them
    don't drop each other. Null and empty texts have no lines; other columns
    are not read; an empty table gives no row.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = parts_for(2 * text_bytes(docs), BUCKET_BYTES)
    near = _travel(docs, buckets).groupBy("bucket").applyInArrow(_join_variants, "h1 long, h2 long, doc_id long, line_no int")
    near = keep(near.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("near")), "lines-near")
    places = keep(_places(docs, 1 if short else MIN_WORDS), "lines-places")
    first = places.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("c"))
    first = first.join(near, ["h1", "h2"], "left").filter("c > 1 OR near IS NOT NULL")
    hit = places.join(first, ["h1", "h2"]).withColumn("here", F.struct("doc_id", "line_no"))
    hit = hit.filter(F.col("near").isNotNull() | ~F.col("here").eqNullSafe(F.col("first")))
    kept = F.coalesce("near", "first")
    return hit.select("doc_id", "line_no", kept["doc_id"].alias("kept_doc_id"), kept["line_no"].alias("kept_line_no"), F.col("near").isNotNull().alias("near"))


def without_duplicate_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, n_chars, ...) without the dropped lines; a document that loses all its words goes.

    Null and empty texts have no lines and stay as they are, as do rows with a
    null id unless an earlier line matches theirs; rows that repeat an id lose
    the same lines. Other columns come through under any name; an empty table
    gives an empty one.
    """
    found = duplicate_lines(docs, short=short).groupBy(F.col("doc_id").alias("key")).agg(F.collect_set("line_no").alias("lines"))
    rows = docs.select(F.struct("*").alias("row"))          # so that no column of the table meets a name of this operator
    rows = rows.join(found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("key")), "left")
    text = F.col("row.text")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("lines", i)), "\n")
    rows = rows.withColumn("left", F.when(F.col("lines").isNull(), text).otherwise(left))
    rows = rows.filter(F.col("lines").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    of = {"text": F.col("left"), "n_chars": F.length("left")}
    return rows.select(*[(of[c].cast(docs.schema[c].dataType) if c in of else F.col("row").getField(c)).alias(c) for c in docs.columns])
