"""Fixtures shared by the operators' tests."""

from __future__ import annotations

import random
import string

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(string.ascii_lowercase, k=rng.randrange(3, 9))) for _ in range(n)]


def docs_of(spark, texts: dict, extra: bool = False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    df = spark.createDataFrame(rows, DOCS)
    if extra:       # names that the operators use themselves
        for c in ("id", "key", "n", "comp", "bucket", "label", "h1", "ids", "w", "pos", "x", "y"):
            df = df.withColumn(c, df["source"])
    return df


class Groups:
    """Union-find; a group's name is its smallest member."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
