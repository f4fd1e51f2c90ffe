from helpers import DOCS

from fairlane.llm import licenses


def test_whole_texts_and_lines(spark):
    mit = "Copyright (c) 2019 Some One\n\n" + dict(licenses.KNOWN)["ISC"].replace("\n\n", "\n  ")
    british = "Licenced under the   APACHE License,\tVersion 2.0"
    texts = {1: mit, 2: british, 3: "prose\nReleased under the MIT Licence!\nmore\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.",
             4: None, 5: "", 6: "\n\n", 7: "the MIT License is mentioned", 8: "x " * 100000}
    rows = [(i, t, None, None, 0) for i, t in texts.items()] + [(3, texts[3], None, None, 0), (None, british, None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("digest", "license_id", "line", "th", "text_license"):
        df = df.withColumn(c, df["source"])
    got = [(r["doc_id"], r["text_license"], r["line_licenses"], r["n_license_lines"]) for r in licenses.scan(df, licenses.known_digests(spark)).collect()]
    want = [(1, "ISC", "", 0), (2, "Apache-2.0", "Apache-2.0", 1), *[(3, None, "CC-BY-NC-4.0,MIT", 3)] * 2, (4, None, "", 0), (5, None, "", 0),
            (6, None, "", 0), (7, None, "", 0), (8, None, "", 0), (None, "Apache-2.0", "Apache-2.0", 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan(df.limit(0), licenses.known_digests(spark)).count() == 0
    plan = licenses.scan(df, licenses.known_digests(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
