import textwrap

from helpers import docs_of

from fairlane.llm import licenses


def test_short_licences_are_found_in_every_line_wrapping(spark):
    texts, want = {}, {}
    for name, text in (("MIT", licenses._MIT), ("ISC", licenses._ISC)):
        for width in range(60, 90):
            for head in ("Copyright (c) 2020 Some One <a@b.c>", "Copyright 2020, Some One", "(C) 2020 Some One", "© Some One", "Copyright Some One. All rights reserved."):
                want[len(want)] = name
                texts[len(texts)] = head + "\n\n" + "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
    got = licenses.scan(docs_of(spark, texts), licenses.known_digests(spark)).collect()
    assert {r["doc_id"]: r["text_license"] for r in got} == want
