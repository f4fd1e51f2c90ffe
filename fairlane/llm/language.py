"""Language identification by a blended-spectrum string kernel.

The kernel of two texts counts the n-grams (2 to 5 bytes of UTF-8, A-Z folded)
present in both, divided by the root of the product of their numbers. N-grams
are told apart by a hash of ``BITS`` bits. Kernel ridge regression, one
against the rest for each language, is fitted with Nystroem landmarks on a
bounded sample: at most ``PER_LANG`` rows of each language, of which
``LANDMARKS`` in all are landmarks. As the kernel is linear in the presence
vectors, landmarks and weights multiply to one matrix (n-grams x languages);
tasks score batches by products of presence rows with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlane.llm.common import U64, bytes_of, chunks, prepare

PER_LANG = 300
LANGUAGES, ROWS_IN_ALL = 1000, 20_000
LANDMARKS = 256
BITS = 16
GRAMS = (2, 3, 4, 5)
RIDGE = 1e-2
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += U64(32)


def present(data: np.ndarray) -> np.ndarray:
    """Sorted hashes of the n-grams in the bytes of one text."""
    mark = np.zeros(1 << BITS, bool)
    x = _FOLD[data] + U64(1)
    with np.errstate(over="ignore"):
        g = x
        for n in range(2, max(GRAMS) + 1):
            if len(x) < n:
                break
            g = g[:-1] * U64(0x100000001B3) + x[n - 1:]
            if n in GRAMS:
                mark[((g + U64(n)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)] = True
    return np.flatnonzero(mark)


def _texts(batches):
    for chunk in chunks(batches, size=8 << 20):
        data, off = bytes_of(chunk.column("text"))
        yield chunk, [present(data[s:e]) for s, e in zip(off[:-1], off[1:])]


@dataclass
class Kernel:
    langs: list[str]
    weights: np.ndarray     # n-grams x languages
    bias: np.ndarray

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """Texts x languages: one batched product of the presence rows with the weights."""
        size = np.array([len(g) for g in grams])
        out = np.zeros((len(grams), len(self.langs)))
        some = np.flatnonzero(size)
        if len(some):
            at = np.concatenate(([0], np.cumsum(size[some])[:-1]))
            out[some] = np.add.reduceat(self.weights[np.concatenate([grams[i] for i in some])], at) / np.sqrt(size[some])[:, None]
        return out + self.bias


def fit(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS, languages: int = LANGUAGES, rows_in_all: int = ROWS_IN_ALL) -> Kernel | None:
    """Fit on at most ``per_lang`` rows (doc_id, text, lang) of each language; None without any row.

    The sample is bounded: the ``languages`` most frequent ones are learnt,
    and with many of them fewer rows of each, ``rows_in_all`` in sum.
    """
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    per_lang = max(1, min(per_lang, rows_in_all // len(langs)))
    rows = rows.filter(F.col("lang").isin(langs))
    # by hash of the id about half as many again as are wanted of each language come, then the first of them count
    share = F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(min(1.0, (1.5 * per_lang + 30) / counts[l])))])
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    rows = rows.select("lang", "text", h.alias("h")).filter(F.col("h") < share[F.col("lang")] * float(1 << 40))

    def code(batches):
        for chunk, grams in _texts(batches):
            yield pa.RecordBatch.from_arrays([chunk.column("lang"), chunk.column("h"), pa.array([g.astype(np.uint16).tobytes() for g in grams], pa.binary())], ["lang", "h", "g"])

    got: dict[str, list] = {l: [] for l in langs}
    for r in rows.mapInArrow(code, "lang string, h long, g binary").orderBy("h", "g").collect():
        if len(got[r["lang"]]) < per_lang and len(r["g"]):
            got[r["lang"]].append(np.frombuffer(r["g"], np.uint16))
    langs = [l for l in langs if got[l]]
    if not langs:
        return None
    each = max(1, landmarks // len(langs))
    lm = [g for l in langs for g in got[l][:each]]
    x = [g for l in langs for g in got[l]]
    y = np.array([i for i, l in enumerate(langs) for _ in got[l]])

    def rows_of(sets):
        p = np.zeros((len(sets), 1 << BITS), np.float32)
        for i, g in enumerate(sets):
            p[i, g] = 1 / np.sqrt(len(g))
        return p

    pl = rows_of(lm)
    values, vectors = np.linalg.eigh((pl @ pl.T).astype(float))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])          # W^(-1/2) of the landmarks' kernel
    z = np.concatenate([(rows_of(x[i:i + 256]) @ pl.T).astype(float) for i in range(0, len(x), 256)]) @ root
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    share_of = np.bincount(y, minlength=len(langs))
    w = (1 / share_of)[y][:, None]                           # every language weighs the same
    mean_z, mean_t = (z * w).sum(0) / w.sum(), (target * w).sum(0) / w.sum()
    zc = z - mean_z
    beta = np.linalg.solve((zc * w).T @ zc + RIDGE * w.sum() / len(w) * np.eye(z.shape[1]), (zc * w).T @ (target - mean_t))
    return Kernel(langs, (pl.T.astype(float) @ (root @ beta)), mean_t - mean_z @ beta)


def identify(docs: DataFrame, kernel: Kernel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every whole text.

    A null text and one without a letter are ``und`` with score 0, and so is
    every text when there is no kernel. Rows that repeat an id or a text get
    the same language; other columns are not read.
    """
    prepare(docs.sparkSession)
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if kernel is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        names = np.array(kernel.langs, object)
        for chunk, grams in _texts(batches):
            s = kernel.scores(grams)
            best = s.argmax(1)
            ok = chunk.column("letters").to_numpy(zero_copy_only=False)
            score = np.where(ok, np.clip(0.5 + 0.5 * s[np.arange(len(s)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(np.where(ok, names[best], "und"), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
