from helpers import docs_of
from test_lines import WORD, corpus, matches

from fairlane.llm import lines


def brute(texts):
    """Lines of any length that an earlier line matches; short lines match equal ones only."""
    all_lines = [(i, k, w) for i in sorted(texts) for k, line in enumerate((texts[i] or "").split("\n")) if (w := WORD.findall(line.lower()))]
    return {(i, k) for n, (i, k, w) in enumerate(all_lines)
            if any(w == v or min(len(w), len(v)) >= lines.MIN_WORDS and matches(w, v) for _, _, v in all_lines[:n])}


def test_short_lines_go_when_an_earlier_line_equals_them(spark):
    texts = corpus(5) | {100: "All rights reserved.\nx\na b c d e", 101: "ALL  rights reserved.\n\ny\na b c d f", 102: None, 103: "x", 104: "a b c d e f\n \n"}
    df = docs_of(spark, texts, extra=True).repartition(4, "doc_id")
    rows = lines.duplicate_lines(df, short=True).collect()
    want = brute(texts)
    assert {(101, 0), (103, 0)} <= want and not {(101, 3), (104, 0)} & want
    assert {(r["doc_id"], r["line_no"]) for r in rows} == want and len(rows) == len(want)
    left = {r["doc_id"]: r["text"] for r in lines.without_duplicate_lines(df, short=True).collect()}
    assert 103 not in left and left[101] == "\ny\na b c d f"
