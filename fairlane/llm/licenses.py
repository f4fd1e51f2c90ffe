"""Licence scan by canonical digests. Built-in functions only.

A text is brought to a canonical form: lines that state a copyright go, letters are
lower-cased, equivalent spellings are made one, and everything but letters and
digits becomes one blank. The digest of the whole canonical text is joined to
the digests of known licence texts and notices; the same is done for each
line, since most documents only carry a notice line.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, British to American and symbols to words, applied in this order.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub-license", "sublicense"),
    ("sub license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("organisation", "organization"), ("favour", "favor"), ("programme", "program"), ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"), ("https", "http"), ("version ", "v"), ("v. ", "v"), ("the gnu", "gnu"), ("&", "and"),
)

# Licence notices and short licence texts as their authors publish them.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE "
    "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
    "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)


def _whole_texts(folder: Path = Path(__file__).parent / "license_texts") -> tuple[tuple[str, str], ...]:
    """(licence, text) of the files ID.txt and ID_other.txt, as they are and in the forms in which they are usually given."""
    out = []
    for file in sorted(folder.glob("*.txt")):
        name, text = file.stem.split("_")[0], file.read_text(encoding="utf-8")
        forms = [text]
        end = re.search(r"END OF TERMS AND CONDITIONS", text)
        if end:         # without the advice on how to apply the licence
            forms += [text[:end.end()], text[:end.start()]]
        if name.startswith("BSD"):
            title = name.replace("-", " ", 1).replace("-Clause", "-Clause License")
            bare = text[text.index("Redistribution and use"):]
            bare = [f(x) for x in (bare, re.sub(r"(?m)^\d\. ", "* ", bare)) for f in (str, lambda x: x.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"))]
            forms = [h + r + x for x in bare for h in ("", f"{title}\n\n") for r in ("", "All rights reserved.\n\n")]
        if name == "Unlicense":
            forms += [text[:text.index("For more information")], text.replace("http://unlicense.org/", "https://unlicense.org")]
        if name == "Zlib":
            forms += ["zlib License\n\n" + text, "The zlib/libpng License\n\n" + text]
        out += [(name, x) for x in dict.fromkeys(forms)]
        out += [(as_name, text[text.index(a):text.index(b) + len(b)]) for as_name, of, a, b in _NOTICES if of == file.stem]
    return tuple(out)


# The notices that whole licence texts recommend: (licence of the notice, file, beginning, end).
_NOTICES = (
    ("Apache-2.0", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the", "limitations under the License."),
    ("GPL-2.0-or-later", "GPL-2.0", "This program is free software; you can redistribute", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-3.0-or-later", "GPL-3.0", "This program is free software: you can redistribute", "along with this program.  If not, see <https://www.gnu.org/licenses/>."),
)
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *_whole_texts(),
)

BROADCAST_ROWS = 100_000        # known digests: about 100 bytes each

#: A line that states a copyright: the word or (c) with a sign, a year, a place for one or all rights reserved, or the sign.
COPYRIGHT_LINE = (r"(?im)^[^\S\n]*(?:copyright[^\S\n]*[:,]?[^\S\n]*(?:\(c\)|©|&copy;|[\[<{]|[0-9]{4})|copyright[^\n]*all rights reserved|"
                  r"\(c\)[^\S\n]*(?:copyright|[\[<{]|[0-9]{4})|©)[^\n]*$")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """Canonical form of a text (null: empty)."""
    x = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, ""))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark: SparkSession, texts=KNOWN) -> DataFrame:
    """(digest, license_id) of the known texts, one row per digest."""
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in texts])
    known = spark.range(1).select(F.inline(rows)).select("license_id", canonical(F.col("text")).alias("c")).filter("c <> ''")
    return known.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_sha256 (of the canonical text), text_license, line_licenses, n_license_lines.

    text_license is the licence whose known text the whole document is (null
    if none); line_licenses are the distinct licences of its lines, sorted and
    comma-joined (empty if none), n_license_lines the number of such lines.
    Null and empty texts match nothing. Rows that repeat an id and a text are
    each returned; other columns are not read. ``known`` has a row per digest;
    it is broadcast up to ``BROADCAST_ROWS`` rows and joined by shuffle beyond.
    """
    known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    whole = d.select("doc_id", F.xxhash64("text").alias("th"), F.sha2(canonical(F.col("text")), 256).alias("text_sha256"))
    lines = d.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "raw"))
    lines = lines.select("doc_id", "th", F.sha2(canonical(F.col("raw")), 256).alias("digest"), (F.col("n") + 1).alias("line"))
    # a row that is repeated as a whole counts its lines once
    found = lines.join(known, "digest").select("doc_id", "th", "line", "license_id").distinct()
    per = found.groupBy("doc_id", "th").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"), F.count(F.lit(1)).alias("n_license_lines"))
    whole = whole.join(known.select(F.col("digest").alias("text_sha256"), F.col("license_id").alias("text_license")), "text_sha256", "left")
    per = per.select(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), "line_licenses", "n_license_lines")
    out = whole.join(per, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th")), "left")
    return out.select("doc_id", "text_sha256", "text_license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def _canonical_sql(x: str) -> str:
    out = f"lower(regexp_replace(coalesce({x}, ''), '{COPYRIGHT_LINE}', '', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def sql() -> str:
    """The same scan of ``documents`` in DuckDB."""
    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    return f"""
WITH known AS (
  SELECT c, min(license_id) AS license_id
  FROM (SELECT license_id, {_canonical_sql('text')} AS c FROM (VALUES {known}) AS k(license_id, text)) WHERE c <> '' GROUP BY c),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
found AS (SELECT doc_id, license_id FROM (SELECT doc_id, {_canonical_sql('raw')} AS c FROM lines) JOIN known USING (c)),
per AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses, count(*) AS n FROM found GROUP BY doc_id),
whole AS (SELECT doc_id, {_canonical_sql('text')} AS c FROM documents)
SELECT w.doc_id, sha256(w.c) AS text_sha256, k.license_id AS text_license, coalesce(p.line_licenses, '') AS line_licenses,
       CAST(coalesce(p.n, 0) AS BIGINT) AS n_license_lines
FROM whole w LEFT JOIN known k ON w.c = k.c LEFT JOIN per p ON w.doc_id = p.doc_id
"""
