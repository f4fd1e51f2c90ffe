"""Sequence packing: concatenate all documents' tokens and cut fixed windows.

Pass 1 tokenises each partition and writes its documents' ids with their
offsets inside the partition. The partitions' token totals (one row per
partition) give each partition's global offset by a prefix sum. Pass 2 adds
the two offsets and cuts every document at the multiples of the window: a
document that crosses a boundary leaves one piece per window. Only the last
window can be short.

Token ids of a text are those of its parts, cut at white space and where an
ASCII letter or digit meets an ASCII mark, since the tokenizer cuts there too
and lower-cases first. A worker tries this on ``PROBES`` when it loads a
tokenizer; one that does otherwise encodes whole texts. Parts repeat, so a worker encodes each part once and
keeps a bounded table of parts by their 64-bit hash; texts are then put
together by array look-ups.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlane.llm.common import binaries, bytes_of, chunks, keep, prepare, word_hashes, word_spans

TABLE_PARTS = 1_500_000      # parts a worker remembers: about 30 bytes each
ENCODE_AT_ONCE = 5000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_KIND = np.zeros(256, np.uint8)     # 1: letter or digit, 2: mark that joins nothing; ' < | > belong to contractions and special tokens
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = 2
PROBES = ("The quick,brown fox-1a's 2nd (A/B) \"x\" e.g. don't!", "a\tb\nc  d\r\n e", "x=1;y_2|z<end>;<|endoftext|>#", "ÀÉ naïve 漢字 42km 3.14",
          "ALL CAPS&mixed-Case...", "--a--b==c", "we'll they've I'm", "", " lead and trail ", "user@mail.org/path?q=1&r=2")
_loaded: dict[str, "_Encoder"] = {}


class _Encoder:
    """A worker's tokenizer with the parts it has encoded: sorted hashes, and where their ids lie."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            bare = json.load(f) | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))    # does the same for lower-case ASCII letters, in half the time
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self._clear()
        self.by_parts = True
        raw = [p.encode() for p in PROBES]
        got, off = self.texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 0)
        self.by_parts = all(got[a:b - 1].tolist() == self.tok.encode(p, add_special_tokens=False).ids for p, a, b in zip(PROBES, off, off[1:]))

    def _whole(self, data: np.ndarray, off: np.ndarray, eos: int) -> tuple[np.ndarray, np.ndarray]:
        """``texts`` of a tokenizer that does not cut where the parts do."""
        raw = data.tobytes()
        ids = [[*e.ids, eos] for e in self.tok.encode_batch([raw[s:e].decode("utf-8", "replace") for s, e in zip(off.tolist(), off[1:].tolist())], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], self.kind), np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))

    def _clear(self):
        self.hash, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def _learn(self, parts: list[str], hashes: np.ndarray):
        plain = np.array([p.isascii() and p.isalpha() for p in parts], bool)
        order = np.argsort(~plain, kind="stable")
        hashes, edge = hashes[order], int(plain.sum())
        parts = [parts[i].lower() if k < edge else parts[i] for k, i in enumerate(order.tolist())]
        got, n = [], []
        for tok, some in ((self.bare, parts[:edge]), (self.tok, parts[edge:])):
            for i in range(0, len(some), ENCODE_AT_ONCE):
                for e in tok.encode_batch(some[i:i + ENCODE_AT_ONCE], add_special_tokens=False):
                    ids = e.ids
                    got += ids
                    n.append(len(ids))
        n = np.array(n, np.int32)
        at = len(self.ids) + np.concatenate(([0], np.cumsum(n, dtype=np.int64)[:-1]))
        self.ids = np.concatenate((self.ids, np.array(got, self.kind)))
        order = np.argsort(both := np.concatenate((self.hash, hashes)), kind="stable")
        self.hash, self.at, self.n = both[order], np.concatenate((self.at, at))[order], np.concatenate((self.n, n))[order]

    def texts(self, data: np.ndarray, off: np.ndarray, eos: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with ``eos`` after each, and the texts' offsets in them."""
        if not self.by_parts:
            return self._whole(data, off, eos)
        start, end, text = word_spans(data, off, _BLANK, _KIND)
        h = word_hashes(data, start, end)
        special = data == 60            # '<' can begin a special token, whose case counts
        if special.any():
            count = np.concatenate(([0], np.cumsum(special)))
            odd = np.flatnonzero(count[end] > count[start])
            h[odd] = ~word_hashes(data, start[odd], end[odd], fold=False)
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) + len(uniq) > TABLE_PARTS:
            self._clear()
        at = np.searchsorted(self.hash, uniq)
        new = np.ones(len(uniq), bool)
        old = at < len(self.hash)
        new[old] = self.hash[at[old]] != uniq[old]
        if new.any():
            raw = data.tobytes()
            self._learn([raw[s:e].decode("utf-8", "replace") for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())], uniq[new])
            at = np.searchsorted(self.hash, uniq)
        n = self.n[at][inv].astype(np.int64)
        done = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.at[at][inv] - done[:-1], n) + np.arange(done[-1])]
        ends = done[np.searchsorted(text, np.arange(len(off) - 1), "right")]
        return np.insert(ids, ends, eos), np.concatenate(([0], ends + np.arange(1, len(off))))


def _encoder(path: str) -> _Encoder:
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    return _loaded[path]


def tokenize(docs: DataFrame, tokenizer: str, eos: int) -> DataFrame:
    """(part, at, doc_id, doc_tokens, ids): packed ids with ``eos`` at the end; at counts the partition's ids before."""
    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer)
        for chunk in chunks(batches):
            ids, off = encoder.texts(*bytes_of(chunk.column("text")), eos)
            n = np.diff(off)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(at + off[:-1]), chunk.column("doc_id"), pa.array(n), binaries(ids, off)],
                ["part", "at", "doc_id", "doc_tokens", "ids"])
            at += int(off[-1])

    return docs.mapInArrow(encode, "part int, at long, doc_id long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, eos: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids holds the piece's token ids as little-endian unsigned 32-bit numbers.
    start counts the document's ids before the piece, offset those of the
    sequence. Sequences are numbered from 0 and have ``window`` ids, but for
    the last. Null and empty texts are one ``eos``. Every row is packed, also
    rows that repeat an id or have none; other columns are not read. An empty
    table gives no piece.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    done = keep(tokenize(docs, tokenizer, eos), "pack-ids")
    totals = done.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    # one row per partition of the input
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = keep(totals.select("part", before.alias("base")), "pack-bases")
    placed = done.join(bases, "part").select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("at")).alias("at"))

    def cut(batches):
        for batch in batches:
            out = {f: [] for f in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "at")))
            for doc, n, raw, at in rows:
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                s = 0
                while s < n:
                    room = window - (at + s) % window
                    e = min(n, s + room)
                    for f, v in zip(out, (doc, s, e - s, ids[s:e].tobytes(), n, (at + s) // window, (at + s) % window)):
                        out[f].append(v)
                    s = e
            yield pa.RecordBatch.from_pydict(out, schema=PIECES)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the pieces of each sequence put together."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
