import textwrap
from pathlib import Path

import duckdb
import pytest
from helpers import docs_of

from fairlane.llm import licenses

FOLDER = Path(licenses.__file__).parent / "license_texts"


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))


@pytest.fixture(scope="module")
def found(spark):
    """(wanted, got in Spark, got by the SQL) of each text."""
    texts, want = {}, {}

    def add(name, text):
        texts[len(texts)], want[len(want)] = text, name

    for file in sorted(FOLDER.glob("*.txt")):
        add(file.stem.split("_")[0], file.read_text())
    for name, text in (("MIT", licenses._MIT), ("ISC", licenses._ISC)):
        for width in range(60, 90):
            add(name, "Copyright (c) 2020 Some One <a@b.c>\n\n" + wrapped(text, width))
            add(name, "© Some One\n\n" + wrapped(text.upper(), width))
    bsd = (FOLDER / "BSD-3-Clause.txt").read_text()
    add("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright 2019, Some One\nAll rights reserved.\n\n" + bsd[bsd.index("Redistribution"):].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))
    add("Apache-2.0", (FOLDER / "Apache-2.0.txt").read_text().replace("[yyyy] [name of copyright owner]", "2021 Some One"))
    add(None, bsd + " and more")
    df = docs_of(spark, texts)
    got = {r["doc_id"]: (r["text_license"], r["text_sha256"]) for r in licenses.scan(df, licenses.known_digests(spark)).collect()}
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841
    by_sql = {r[0]: (r[2], r[1]) for r in duckdb.sql(licenses.sql()).fetchall()}
    return want, got, by_sql


def test_whole_texts_are_found_however_they_are_wrapped(found):
    want, got, _ = found
    assert {i: x[0] for i, x in got.items()} == want


def test_sql_finds_the_same(found):
    _, got, by_sql = found
    assert got == by_sql
