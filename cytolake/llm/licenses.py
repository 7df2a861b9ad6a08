"""License scans: whole texts looked up by a canonical digest (native DataFrame operations only)."""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Public licence texts and notices, by SPDX name. More can be given to find_licenses().
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
]
#: Further licence lines.
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    *[(f"CC-{k}-4.0", f"{how} under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for how in ("Licensed", "Released", "This work is licensed")],
    *[(n, f"SPDX-License-Identifier: {n}") for n in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later")],
]
#: Title lines that the texts come with or without.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: Where a text starts behind its title and ends before its appendix.
_START = {"Apache-2.0": "TERMS AND CONDITIONS FOR USE", "MPL-2.0": "1. Definitions", "CC0-1.0": "Statement of Purpose", "GPL-1.0": "Everyone is permitted", "GPL-2.0": "Everyone is permitted", "GPL-3.0": "Everyone is permitted", "LGPL-2.0": "Everyone is permitted", "LGPL-2.1": "Everyone is permitted", "LGPL-3.0": "Everyone is permitted"}
_END = "END OF TERMS AND CONDITIONS"


@cache
def known_texts() -> list[tuple[str, str]]:
    """KNOWN, NOTICES and the texts in license_texts, each with and without its title lines, appendix and numbers."""
    files = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    found = KNOWN + NOTICES
    for name, text in [k for k in KNOWN[:3]] + files:
        cuts = [text]
        if name in _START:
            cuts.append(text[text.index(_START[name]) :])
        if _END in text:
            cuts += [t[: t.index(_END) + n] for t in cuts for n in (0, len(_END))]
        if name.startswith("BSD"):
            cuts.append(re.sub(r"(?m)^[0-9]\. ", "* ", text))
        found = found + [(name, head + t) for t in cuts for head in ("", *[f"{h}\n\n" for h in TITLES.get(name, [])])]
    return found


#: Spellings that count as the same, as words in lower case.
SPELLINGS = [("licence", "license"), ("sublicence", "sublicense"), ("licenced", "licensed"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"), ("per cent", "percent"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("https", "http")]


def canonical(text: Column) -> Column:
    """Lower case; no lines that state a copyright; words of letters and digits only, one space apart; one spelling."""
    def stated(t):
        lines = F.regexp_replace(t, r"(?md)^[^\n]{0,20}(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]{4})[^\n]*$|^[ \t]*all rights reserved\.?[ \t]*$", " ")
        return F.when(_any_of(t, "copyright", "(c)", "©", "all rights reserved"), lines).otherwise(t)  # most texts have none of these

    def spelled(t):
        words = F.concat(F.lit(" "), F.replace(t, F.lit(" "), F.lit("  ")), F.lit(" "))  # each word has spaces of its own
        for other, one in SPELLINGS:
            words = F.replace(words, F.lit(_spaced(other)), F.lit(_spaced(one)))
        return F.when(_any_of(t, *(other for other, _ in SPELLINGS)), F.trim(F.replace(words, F.lit("  "), F.lit(" ")))).otherwise(t)

    words = F.regexp_replace(_let(F.lower(F.coalesce(text, F.lit(""))), stated), r"[\x01-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’«»–—…\x{A0}]+", " ")
    return _let(F.trim(words), spelled)


def _let(value: Column, use) -> Column:
    """use(value), the value being worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _any_of(text: Column, *parts: str) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digests_of(texts: DataFrame, text_col: str = "text") -> Column:
    return F.sha2(canonical(F.col(text_col)), 256)


def _lookup(spark: SparkSession, known: list[tuple[str, str]] | None) -> DataFrame:
    table = spark.createDataFrame(known or known_texts(), "license string, text string")
    return table.select(digests_of(table).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def find_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest, license for every row of docs: the licence whose text the whole text is, else null.

    Null and empty texts have the digest of the empty text, which no licence has. The table of known texts is as large
    as the caller's list and is broadcast; of licences with one text the first by name is given. Repeated rows are looked
    up each, texts of any length whole; an empty table gives no rows, and columns besides doc_id and text are not read."""
    own = docs.select("doc_id", digests_of(docs).alias("digest"))
    return own.join(F.broadcast(_lookup(docs.sparkSession, known)), "digest", "left").select("doc_id", "digest", "license")


def find_license_lines(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, part, place, license: each line, and each paragraph of several lines, that is the text of a licence.

    place counts the document's lines or paragraphs from 0. A text of one paragraph that is a licence is found here too;
    one of several paragraphs only by find_licenses()."""
    named = lambda part, spans: F.transform(spans, lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("place"), x.alias("span")))
    paragraphs = F.filter(named("paragraph", F.split("text", r"\n[ \t\r]*\n")), lambda p: F.contains(p["span"], F.lit("\n")))
    spans = docs.select("doc_id", F.explode(F.concat(named("line", F.split("text", "\n")), paragraphs)).alias("s")).select("doc_id", "s.*")
    own = spans.select("doc_id", "part", "place", digests_of(spans, "span").alias("digest"))
    return own.join(F.broadcast(_lookup(docs.sparkSession, known)), "digest").select("doc_id", "part", "place", "license")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(read_table(spark, sf_dir, "documents"))


def op7_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_license_lines(read_table(spark, sf_dir, "documents"))


def _sql_canonical(t: str) -> str:
    t = f"lower(coalesce({t}, ''))"
    t = rf"regexp_replace({t}, '(?m)^[^\n]{{0,20}}(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]{{4}})[^\n]*$|^[ \t]*all rights reserved\.?[ \t]*$', ' ', 'g')"
    t = rf"regexp_replace({t}, '[\x01-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’«»–—…\x{{A0}}]+', ' ', 'g')"
    t = f"' ' || replace(trim({t}, ' '), ' ', '  ') || ' '"
    for other, one in SPELLINGS:
        t = f"replace({t}, '{_spaced(other)}', '{_spaced(one)}')"
    return f"trim(replace({t}, '  ', ' '), ' ')"


_VALUES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
OP7_SQL = f"""
WITH known AS (SELECT sha256({_sql_canonical('t')}) AS digest, min(n) AS license FROM (VALUES {_VALUES}) k(n, t) GROUP BY 1),
own AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents)
SELECT doc_id, own.digest, license FROM own LEFT JOIN known USING (digest)
"""

_ALL_VALUES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known_texts())
OP7_LINES_SQL = f"""
WITH known AS (SELECT sha256({_sql_canonical('t')}) AS digest, min(n) AS license FROM (VALUES {_ALL_VALUES}) k(n, t) GROUP BY 1),
lines AS (SELECT doc_id, 'line' AS part, string_split(text, chr(10)) AS spans FROM documents
UNION ALL SELECT doc_id, 'paragraph', string_split_regex(text, '\n[ \t\r]*\n') FROM documents),
parts AS (SELECT doc_id, part, unnest(range(len(spans)))::INTEGER AS place, unnest(spans) AS span FROM lines)
SELECT doc_id, part, place, license FROM (SELECT *, sha256({_sql_canonical('span')}) AS digest FROM parts WHERE part = 'line' OR contains(span, chr(10))) JOIN known USING (digest)
"""
