"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents, not for tokens, so tokens are labelled
weakly: a lexicon of words and word starts and ends that are significantly
commoner in toxic documents is drawn from a bounded sample of labelled rows;
a token of a toxic document that has such a feature is labelled 1, all others
0 (every token of a clean document is 0, so features that clean documents
have too lose their weight). The field has two states, transition weights
and one weight per strength of the token's strongest feature, fitted by
gradient ascent on the sample's windows. Forward-backward marginals of a whole
text give its score (a logistic function of the largest marginal and of their
sum, fitted on the sample with the classes' true shares) and the offending
spans. Tokens without a feature ("plain") all have one transition matrix, so
runs of them are a matrix power in closed form; the marginals are exact.

Bounds of the fit: ``SAMPLE`` labelled rows of each class, ``LEXICON``
features, ``WINDOWS`` training windows of ``WINDOW`` tokens.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlane.llm.common import keep, prepare

SAMPLE = 5000
LEXICON = 5000
WINDOWS, WINDOW, STEPS = 3000, 256, 150
SIGNIFICANT = 18.0              # likelihood ratio of a feature's counts in the two classes
EDGES = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0)    # of the strengths (log odds)
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 300_000            # words whose strength a worker remembers


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(word: str) -> set[str]:
    n = len(word)
    return {word} | {"^" + word[:k] for k in range(3, min(6, n) + 1)} | {word[-k:] + "$" for k in range(3, min(5, n) + 1)}


def _words(text: str) -> list[str]:
    """The text's words in lower case; where that changes a length, words are found before, so that offsets hold."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, text) of at most ``limit`` labelled rows of each class that are not held out; the classes' true counts.

    Copies and most near-copies (texts whose three smallest word hashes are
    equal) count once, lest the words of a toxic text seem toxic because the
    text is repeated.
    """
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picks = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for c in (0, 1)]
    # at most 2 * limit rows of 12 bytes
    rows = docs.join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    hashes = F.array_sort(F.transform(F.array_distinct(F.split(F.lower("text"), r"\s+")), lambda w: F.xxhash64(w)))
    rows = rows.groupBy(F.slice(hashes, 1, 3).alias("same")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return keep(rows.select("toxic", "text"), "toxicity-sample"), counts


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Strength (log odds) of the significant features; counts are per document."""
    def count(batches):
        for batch in batches:
            seen: tuple[dict, dict] = ({}, {})
            rows = [0, 0]
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                rows[toxic] += 1
                for f in set().union(*map(_features, set(_words(text or "")))):
                    seen[toxic][f] = seen[toxic].get(f, 0) + 1
            names = ["", *set(seen[0]).union(seen[1])]
            clean, bad = ([rows[c], *(seen[c].get(f, 0) for f in names[1:])] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(clean, pa.int64()), pa.array(bad, pa.int64())], ["f", "clean", "bad"])

    total = sample.mapInArrow(count, "f string, clean long, bad long").groupBy("f").agg(F.sum("clean").alias("a"), F.sum("bad").alias("b"))
    top = total.orderBy(F.col("f") != "").first()
    if top is None or top["f"] != "" or not top["a"] or not top["b"]:
        return {}
    n0, n1 = float(top["a"]), float(top["b"])
    share = n1 / (n0 + n1)
    a, b = F.col("a"), F.col("b")
    ratio = 2 * (F.when(b > 0, b * F.log(b / ((a + b) * share))).otherwise(0.0) + F.when(a > 0, a * F.log(a / ((a + b) * (1 - share)))).otherwise(0.0))
    odds = F.log((b + 0.5) / (n1 + 1)) - F.log((a + 0.5) / (n0 + 1))
    best = total.filter(F.col("f") != "").select("f", odds.alias("odds"), ratio.alias("ratio"))
    best = best.filter((F.col("odds") > EDGES[0]) & (F.col("ratio") >= SIGNIFICANT)).orderBy(F.desc("ratio"), "f").limit(LEXICON)
    return {r["f"]: r["odds"] for r in best.collect()}


@dataclass
class Field:
    """Fitted weights: ``step`` [3, K + 1] adds up a token's log potential; see ``_potentials``."""

    lexicon: dict[str, float]
    node: np.ndarray        # weight of state 1 for each strength, 0: plain
    move: np.ndarray        # 2 x 2 transition weights
    score: np.ndarray       # intercept, weight of the largest marginal, of the log of their sum


class Tagger:
    """Forward-backward over whole texts with the fitted field."""

    def __init__(self, field: Field):
        self.f, self.known = field, {}
        m = np.exp(field.move)
        self.steps = [[[float(m[i, 0]), float(m[i, 1] * math.exp(w))] for i in (0, 1)] for w in field.node]
        values, vectors = np.linalg.eig(np.array(self.steps[0]))
        order = np.argsort(-values.real)
        values, self.v = values.real[order], vectors.real[:, order]
        self.back, self.shrink = np.linalg.inv(self.v), float(values[1] / values[0])

    def strength(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            z = max((self.f.lexicon.get(x, 0.0) for x in _features(word)), default=0.0)
            got = self.known[word] = sum(z >= e for e in EDGES)
        return got

    def _plain(self, n: int):
        """The plain step to the power n, up to a factor."""
        if n == 0:
            return ((1.0, 0.0), (0.0, 1.0))
        a, b, r = self.v, self.back, self.shrink ** n
        return tuple(tuple(float(a[i, 0] * b[0, j] + r * a[i, 1] * b[1, j]) for j in (0, 1)) for i in (0, 1))

    def marginals(self, words: list[str]) -> list[tuple[int, float]]:
        """(number, probability of state 1) of each word that has a feature."""
        found = [(i, s) for i, s in enumerate(map(self.strength, words)) if s]
        if not found:
            return []
        forward, gaps, p, at = [], [], (1.0, 0.0), -1       # the chain starts in state 0
        for i, s in found:
            g, m = self._plain(i - at - 1), self.steps[s]
            gaps.append(g)
            q = (p[0] * g[0][0] + p[1] * g[1][0], p[0] * g[0][1] + p[1] * g[1][1])
            p = (q[0] * m[0][0] + q[1] * m[1][0], q[0] * m[0][1] + q[1] * m[1][1])
            t = p[0] + p[1]
            p = (p[0] / t, p[1] / t)
            forward.append(p)
            at = i
        g = self._plain(len(words) - at - 1)
        b = (g[0][0] + g[0][1], g[1][0] + g[1][1])
        out = []
        for k in range(len(found) - 1, -1, -1):
            i, s = found[k]
            x, y = forward[k][0] * b[0], forward[k][1] * b[1]
            out.append((i, y / (x + y)))
            m, g = self.steps[s], gaps[k]
            c = (m[0][0] * b[0] + m[0][1] * b[1], m[1][0] * b[0] + m[1][1] * b[1])
            b = (g[0][0] * c[0] + g[0][1] * c[1], g[1][0] * c[0] + g[1][1] * c[1])
            t = b[0] + b[1]
            b = (b[0] / t, b[1] / t)
        return out[::-1]

    def summary(self, marginals: list[tuple[int, float]]) -> tuple[float, float]:
        return max((p for _, p in marginals), default=0.0), math.log1p(sum(p for _, p in marginals))

    def score(self, marginals: list[tuple[int, float]]) -> float:
        a, b = self.summary(marginals)
        z = self.f.score[0] + self.f.score[1] * a + self.f.score[2] * b
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _fit_chain(x: np.ndarray, y: np.ndarray, length: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Node and transition weights of greatest likelihood for windows x (strengths) and y (states), by gradient ascent."""
    total = len(x)
    rows, often = np.unique(np.concatenate((x, y, length[:, None]), 1), axis=0, return_counts=True)     # equal windows count together
    x, y, length = rows[:, :x.shape[1]], rows[:, x.shape[1]:-1], rows[:, -1]
    n, t = x.shape
    many = often.astype(float)
    inside = np.arange(t)[None, :] < length[:, None]
    node, move = np.zeros(bins), np.zeros((2, 2))
    prev = np.concatenate((np.zeros((n, 1), int), y[:, :-1]), 1)
    each = np.repeat(many[:, None], t, 1)
    toxic = inside & (y == 1)
    seen_node = np.bincount(x[toxic], weights=each[toxic], minlength=bins)
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (prev[inside], y[inside]), each[inside])
    speed = [np.zeros(bins), np.zeros((2, 2))]
    square = [np.zeros(bins), np.zeros((2, 2))]
    for turn in range(1, STEPS + 1):
        m, w = np.exp(move), np.exp(node)[x]
        a = np.zeros((t, n, 2))
        p = np.tile([1.0, 0.0], (n, 1))
        for k in range(t):
            q = p @ m
            q[:, 1] *= w[:, k]
            q /= q.sum(1, keepdims=True)
            p = np.where(inside[:, k, None], q, p)
            a[k] = p
        b = np.ones((n, 2))
        want_node, want_move = np.zeros(bins), np.zeros((2, 2))
        for k in range(t - 1, -1, -1):
            live = inside[:, k]
            before = a[k - 1] if k else np.tile([1.0, 0.0], (n, 1))
            e = b.copy()
            e[:, 1] *= w[:, k]
            pair = before[:, :, None] * m[None] * e[:, None, :]
            pair *= (many / pair.sum((1, 2)))[:, None, None]
            want_move += pair[live].sum(0)
            want_node += np.bincount(x[live, k], weights=pair[live, :, 1].sum(1), minlength=bins)
            c = e @ m.T
            c /= c.sum(1, keepdims=True)
            b = np.where(live[:, None], c, b)
        for i, (v, g) in enumerate(((node, (seen_node - want_node) / total - 0.002 * node), (move, (seen_move - want_move) / total - 0.002 * move))):
            speed[i] = 0.9 * speed[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            v += 0.15 * (speed[i] / (1 - 0.9 ** turn)) / (np.sqrt(square[i] / (1 - 0.99 ** turn)) + 1e-8)
    return node, move


def _fit_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps (a little ridge)."""
    x = np.concatenate((np.ones((len(x), 1)), x), 1)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * b)
    return b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit the field on a bounded sample of labelled rows that are not held out.

    With no labelled rows, or rows of one class only, the lexicon is empty and
    every score is the share of toxic rows.
    """
    prepare(docs.sparkSession)
    rows, counts = _sample(docs, labels, sample)
    lexicon = _lexicon(rows)
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    field = Field(lexicon, np.zeros(len(EDGES) + 1), np.zeros((2, 2)), np.array([math.log(share / (1 - share)), 0.0, 0.0]))
    if not lexicon:
        return field

    def strengths(batches):
        tagger = Tagger(field)
        for batch in batches:
            out = [np.fromiter(map(tagger.strength, _words(t or "")), np.uint8).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(out, pa.binary())], ["toxic", "z"])

    coded = rows.mapInArrow(strengths, "toxic int, z binary")
    windows = coded.select("toxic", F.explode(F.expr(f"transform(sequence(0, greatest(octet_length(z) - 1, 0) div {WINDOW}), i -> substring(z, i * {WINDOW} + 1, {WINDOW}))")).alias("z"))
    windows = windows.filter("octet_length(z) > 0").orderBy(F.xxhash64("z", "toxic"), "z").limit(WINDOWS).collect()
    data = [(r["toxic"], np.frombuffer(r["z"], np.uint8)) for r in windows]
    x = np.zeros((len(data), WINDOW), int)
    y = np.zeros_like(x)
    length = np.array([len(z) for _, z in data])
    for i, (toxic, z) in enumerate(data):
        x[i, :len(z)] = z
        y[i, :len(z)] = toxic * (z > 0)
    field.node, field.move = _fit_chain(x, y, length, len(EDGES) + 1)

    def summaries(batches):
        tagger = Tagger(field)
        for batch in batches:
            s = [tagger.summary(tagger.marginals(_words(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array([a for a, _ in s], pa.float64()), pa.array([b for _, b in s], pa.float64())], ["toxic", "a", "b"])

    got = np.array([tuple(r) for r in rows.mapInArrow(summaries, "toxic int, a double, b double").collect()], float)
    of = {c: max(1, int((got[:, 0] == c).sum())) for c in (0, 1)}
    weight = np.where(got[:, 0] == 1, counts.get(1, 0) / of[1], counts.get(0, 0) / of[0])
    field.score = _fit_score(got[:, 1:], got[:, 0], weight * len(got) / weight.sum())
    return field


def tag(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), spans.

    spans are the (start, end) offsets in code points of the words whose
    marginal is 0.5 or more. Whole texts are tagged; null and empty texts have
    no span and the score of a text without toxic words. Rows that repeat an
    id or a text are scored alike; other columns are not read.
    """
    prepare(docs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        tagger = Tagger(field)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                got = tagger.marginals(_words(text or ""))
                scores.append(tagger.score(got))
                bad = {i for i, p in got if p >= 0.5}
                if bad:
                    low = text.lower()
                    where = low if len(low) == len(text) else text
                    spans.append([{"start": m.start(), "end": m.end()} for i, m in enumerate(WORD.finditer(where)) if i in bad])
                else:
                    spans.append([])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, span)], ["doc_id", "score", "spans"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score of ``THRESHOLD`` or more), n_spans."""
    scored = tag(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that score below ``THRESHOLD``; every row is scored where it lies."""
    field = fit(docs, labels)
    prepare(docs.sparkSession)
    schema = docs.schema

    def clean(batches):
        tagger = Tagger(field)
        for batch in batches:
            ok = [tagger.score(tagger.marginals(_words(t or ""))) < THRESHOLD for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(clean, schema)
