"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

A sequence of pieces is what byte-pair merging makes of its text if and only
if each pair of neighbours is *compatible*: merging the pair's own text gives
back just these two. (Take the first merge that would cross a border. Up to
then each side has merged on its own, in the order it has in the pair's text,
so the same merge would cross there.) So every prefix of a text has one last
piece, the one that ends there and is compatible with the last piece of the
prefix before it. The table of last pieces is filled left to right: an
Aho-Corasick automaton over the vocabulary names the pieces that end at a
place, a pair test picks the one. The ids are then read off backwards.

Where two characters follow each other in no piece, no merge can cross; each
stretch between such borders (a word, mostly) has a table of its own, and a
worker remembers the ids of words (up to ``WORDS``) and the outcomes of pair
tests (up to ``PAIRS``). Work is linear in the text and local to a row:
no shuffle, and a hot source or group of copies has no task of its own.

Null texts are empty texts and have no ids; a text of spaces has the ids of
its marks. Very long texts are cut into words as they are read. Repeated rows
and rows with the same id are encoded one by one; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

import re
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlane.llm.common import chunks, prepare

MARK = "▁"
WORDS = 1 << 19
WORD_CHARS = 40                 # longer words are not remembered
PAIRS = 1 << 20
LONG_TEXT = 1 << 20             # characters; beyond, words are not listed at once
PROBE = "A b  Ａ ﬁ é\tİ▁ x\n "
_models: dict[str, "PieceTable"] = {}


class PieceTable(dict):
    """Word -> its ids as little-endian 32-bit integers, worked out when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score, self.ids, self.pairs = {}, {}, {}
        for i in range(sp.get_piece_size()):
            if sp.is_unused(i):
                raise ValueError("a model with unused pieces is not supported")
            if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
                self.ids[sp.id_to_piece(i)] = np.array([i], "<i4").tobytes()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, self.byte_ids)) or sp.normalize(PROBE) != self.marked(PROBE):
            raise ValueError("only models with byte fallback, a leading mark and no other normalisation are supported")
        if not set("".join(self.score)) <= set(self.score):
            raise ValueError("a character of a piece is no piece of its own")
        self.chars = frozenset("".join(self.score))
        self.word = self._borders()
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()

    def _borders(self) -> re.Pattern:
        """Pattern of the stretches that no piece leaves, read off the vocabulary.

        A border lies before a mark that follows another character, around a
        character that stands in no longer piece, and before a punctuation
        mark that follows a character which no piece has before one.
        """
        long = [p for p in self.score if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):
            return re.compile("(?s:.+)")
        joined = set("".join(long))
        signs = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} & joined
        before = {x for p in long for x, y in zip(p, p[1:]) if y in signs} | signs
        alone, signs, before = ("".join(re.escape(c) for c in sorted(cs)) for cs in ({chr(c) for c in range(128)} - joined, signs, before))
        rest = f"[^{MARK}{alone}{signs}]"
        ways = [f"[{alone}]"] if alone else []
        if signs:
            more = f"(?:(?<=[{before}])[{signs}]+{rest}*)*"
            ways += [f"{MARK}*[{signs}]+{rest}*{more}", f"{MARK}*{rest}+{more}"]
        else:
            ways.append(f"{MARK}*{rest}+")
        return re.compile("|".join([*ways, MARK + "+"]))

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the definition: join the best-scored pair, the leftmost of equals."""
        out = list(text)
        while True:
            best, at = None, 0
            for i in range(len(out) - 1):
                s = self.score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return out
            out[at:at + 2] = [out[at] + out[at + 1]]

    def compatible(self, before: str, piece: str) -> bool:
        """Whether ``piece`` stays a piece right after ``before`` ("" at the start)."""
        key = before, piece
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.merged(before + piece) == ([before, piece] if before else [piece])
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def last_pieces(self, word: str) -> list[str]:
        """Entry i: the last piece of the word up to and with its character i; the entry after them is empty."""
        last = [""] * (len(word) + 1)
        if not self.chars.issuperset(word):                 # characters outside the vocabulary stand for themselves
            last = [c if c not in self.chars else "" for c in word] + [""]
        pairs = self.pairs
        for end, (piece, n) in self.automaton.iter(word):  # the longest piece of a place first
            if not last[end]:
                before = last[end - n]                      # -1, the start: the empty entry
                ok = pairs.get((before, piece))
                if self.compatible(before, piece) if ok is None else ok:
                    last[end] = piece
        return last

    def __missing__(self, word: str) -> bytes:
        last, at, out, known = self.last_pieces(word), len(word) - 1, [], self.ids
        while at >= 0:
            piece = last[at]
            out.append(known[piece] if piece in known else np.array([self.byte_ids[b] for b in piece.encode()], "<i4").tobytes())
            at -= len(piece)
        out.reverse()
        ids = b"".join(out)
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        marked = self.marked(text or "")
        words = self.word.findall(marked) if len(marked) <= LONG_TEXT else (m.group() for m in self.word.finditer(marked))
        return b"".join(map(self.__getitem__, words))


def _table(name: str) -> PieceTable:
    if name not in _models:
        _models[name] = PieceTable(SparkFiles.get(name))
    return _models[name]


def _ship(docs: DataFrame, model: str) -> str:
    """Send the model file to the executors; returns its name there."""
    prepare(docs.sparkSession)
    name = Path(model).name
    if name not in {Path(f).name for f in docs.sparkSession.sparkContext.listFiles}:
        docs.sparkSession.sparkContext.addFile(model)
    return name


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every text, as the library encodes it without begin and end ids.

    ``with_decoded`` adds ``decoded``, the library's decoding of those ids, in the same pass.
    """
    name = _ship(docs, model)

    def run(batches):
        table = _table(name)
        for batch in chunks(batches):
            ids = [table.encode(t) for t in batch.column("text").to_pylist()]
            off = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=off[1:])
            cols = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(ids), "<i4")))]
            if with_decoded:
                cols.append(pa.array([table.model.decode(np.frombuffer(x, "<i4").tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][:len(cols)])

    schema = "doc_id long, ids array<int>" + ", decoded string" * with_decoded
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids and no ids are an empty text."""
    name = _ship(encoded, model)

    def run(batches):
        table = _table(name)
        for batch in batches:
            texts = [table.model.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids, decoded)."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
