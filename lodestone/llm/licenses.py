"""Licence scans by canonical digest.

A text is canonical when it is lower-cased, without copyright lines, with everything but letters and digits turned into
single spaces and equivalent spellings made one, as whole words. The MD5 digests of whole documents are hash-joined to those
of the known licences: as they are, without a title, and without title, real notices and lines of `all rights reserved` only.
Lines are looked up among the one-line notices.

Null text counts as empty and matches nothing; repeated rows match alike. Columns other than doc_id and text are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import textwrap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.license_texts import FULL_TEXTS

#: Spellings that count as one, as whole words of canonical text, replaced in this order.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("per cent", "percent"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"), ("analogues", "analogs"),
    ("authorisation", "authorization"), ("authorisations", "authorizations"), ("organisation", "organization"), ("organisations", "organizations"),
]
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
#: Real notices: with a sign, year, `by` or a place to fill in, or at the head of a paragraph; not wrapped lines of a text.
NOTICES = [
    r"(?m)^[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by\b|[<\[{])|\(c\)[ \t]*(?:copyright|[0-9]{4})|©)[^\n]*$",
    r"(?:\A\s*|\n[ \t\r]*\n[ \t]*)copyright\b[^\n]*(?:\n[ \t]*copyright\b[^\n]*)*",
    r"(?m)^[ \t]*all rights reserved[. \t\r]*$",
]
#: Titles of short licences, in canonical text.
TITLE = r"^(?:the )?(?:mit(?: 0)?|mit no attribution|expat|isc|0bsd|bsd zero clause|zero clause bsd|(?:(?:new|modified|simplified|freebsd|revised) )?bsd(?: [23] clause)?(?: new or revised| new| revised| simplified| freebsd)?) license(?: mit| expat| isc| 0bsd| bsd [23] clause)? "
#: Runs that separate words, with and without line ends.
GAP = r"[^\p{L}\p{N}]+"
LINE_GAP = r"[^\p{L}\p{N}\n]+"
#: Where none of these is, no notice is.
NOTICE_HINT = r"copyright|\(c\)|©|all rights reserved"

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Whole texts of known licences (title and copyright lines aside) and one-line notices.
KNOWN = {
    "MIT": [
        f"{_MIT_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}",
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
    ],
    "MIT-0": [f"{_MIT_GRANT}.\n{_AS_IS}", "SPDX-License-Identifier: MIT-0"],
    "ISC": [
        f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_TAIL}",
        "SPDX-License-Identifier: ISC",
    ],
    "0BSD": [f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_TAIL}", "SPDX-License-Identifier: 0BSD"],
    "BSD-2-Clause": [f"{_BSD_HEAD}{_BSD_TAIL}", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        f"{_BSD_HEAD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_TAIL}",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
}


def padded(phrase: str) -> str:
    """A phrase among words that two spaces separate, with a space of its own at both ends."""
    return f" {phrase.replace(' ', '  ')} "


def plain_words(text: str) -> str:
    """What plain_column does, for the known texts."""
    text = f" {re.sub(r'[^\w]+|_+', '  ', text)} "
    for a, b in SPELLINGS:
        text = text.replace(padded(a), padded(b))
    return " ".join(text.split())


def canonical_text(text: str) -> str:
    return plain_words(re.sub(COPYRIGHT_LINE, "", text.lower()))


def bare_text(text: str) -> str:
    """Canonical text without title and real notices."""
    text = text.lower()
    for notice in NOTICES:
        text = re.sub(notice, "\n", text)
    return re.sub(TITLE, "", plain_words(text))


def unix_lines(pattern: str) -> str:
    """For Java: only line feeds end lines."""
    return pattern.replace("(?m)", "(?md)")


def spelled(text: Column) -> Column:
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(padded(a)), F.lit(padded(b)))
    return text


def plain_column(text: Column) -> Column:
    """Lower-cased text as words in one line, with one spelling."""
    out = spelled(F.concat(F.lit(" "), F.regexp_replace(text, GAP, "  "), F.lit(" ")))
    return F.btrim(F.regexp_replace(out, " +", " "))


def canonical_lines(text: Column) -> Column:
    """Lower-cased text as words with one spelling, in its lines."""
    out = F.replace(F.regexp_replace(text, LINE_GAP, "  "), F.lit("\n"), F.lit(" \n "))
    return F.regexp_replace(spelled(F.concat(F.lit(" "), out, F.lit(" "))), " +", " ")


def without_notices(text: Column) -> Column:
    for notice in NOTICES:
        text = F.regexp_replace(text, unix_lines(notice), "\n")
    return text


def whole_digests() -> dict[str, str]:
    """Digest of canonical or bare text to licence, of the known and the full texts; numbered conditions also without numbers."""
    texts = [(t, name) for name, known in KNOWN.items() for t in known]
    texts += [(re.sub(r"(?m)^[0-9]\. ", "", t), name) for t, name in texts]
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    own = {digest(form(t)): name for t, name in texts for form in (canonical_text, bare_text)}
    return own | {d: name for name, digests in FULL_TEXTS.items() for d in digests}


def known_digests(spark) -> DataFrame:
    """known, license_id: digests of the known whole texts, about a hundred rows."""
    return spark.createDataFrame(sorted(whole_digests().items()), "known string, license_id string")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, text_md5 (of the canonical text), whole_license, line_licenses (sorted, joined by a comma), n_license_lines."""
    known = F.broadcast(known_digests(docs.sparkSession))  # bounded by KNOWN and FULL_TEXTS
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.regexp_replace(low, unix_lines(COPYRIGHT_LINE), "")
    rows = docs.select("doc_id", low.alias("low"), text.alias("text"))
    md5 = lambda words: F.md5(words.cast("binary"))
    rows = rows.select("doc_id", "low", canonical_lines(F.col("text")).alias("body"), plain_column(F.col("text")).alias("words"))
    bare = F.when(F.col("low").rlike(NOTICE_HINT), F.regexp_replace(plain_column(without_notices(F.col("low"))), TITLE, ""))
    lines = F.transform(F.split("body", "\n", -1), lambda line: md5(F.btrim(line)))
    names = dict(known_rows())
    hits = F.filter(lines, lambda d: d.isin(sorted(names)))
    rows = rows.select("doc_id", md5(F.col("words")).alias("text_md5"), md5(F.regexp_replace("words", TITLE, "")).alias("untitled_md5"), md5(bare).alias("bare_md5"), hits.alias("hits"))
    forms = ("text_md5", "bare_md5", "untitled_md5")
    for form in forms:
        own = known.select(F.col("known").alias(f"known_{form}"), F.col("license_id").alias(f"license_{form}"))
        rows = rows.join(own, rows[form] == own[f"known_{form}"], "left")
    line_names = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values())))
    found = F.array_sort(F.array_distinct(F.transform("hits", lambda d: F.element_at(line_names, d))))
    whole = F.coalesce(*[F.col(f"license_{form}") for form in forms])
    return rows.select("doc_id", "text_md5", whole.alias("whole_license"), F.array_join(found, ",").alias("line_licenses"), F.size("hits").cast("long").alias("n_license_lines"))


def known_rows() -> list[tuple[str, str]]:
    """Digests of the known texts that are one line once they are canonical, with their licence."""
    return sorted({(hashlib.md5(canonical_text(t).encode()).hexdigest(), name) for name, texts in KNOWN.items() for t in texts})


def license_files() -> list[tuple[int, str]]:
    """doc_id (negative), text: a file of each known whole text, with title, notice and wrapped lines, and the text in capitals."""
    wholes = [(name, t) for name, known in KNOWN.items() for t in known if len(t) > 400]
    out = []
    for name, text in wholes:
        wrapped = "\n".join(line for paragraph in text.split("\n") for line in textwrap.wrap(paragraph, 72))
        title = {"Apache-2.0": ""}.get(name, f"{name} License\n\n")
        out += [f"{title}Copyright (c) 2024 Someone\n\n{wrapped}\n", text.upper().replace("LICENSE", "LICENCE")]
    return [(-1 - i, t) for i, t in enumerate(out)]


def oracle_sql() -> str:
    """DuckDB SQL of scan_licenses over documents and license_files."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def spelled_sql(text: str) -> str:
        text = f"concat(' ', {text}, ' ')"
        for a, b in SPELLINGS:
            text = f"replace({text}, {quote(padded(a))}, {quote(padded(b))})"
        return f"regexp_replace({text}, ' +', ' ', 'g')"

    plain = lambda text: f"trim({spelled_sql(f"regexp_replace({text}, {quote(GAP)}, '  ', 'g')")}, ' ')"
    bare = "low"
    for notice in NOTICES:
        bare = f"regexp_replace({bare}, {quote(notice)}, chr(10), 'g')"
    files = ", ".join(f"({i}, {quote(t)})" for i, t in license_files())
    values = lambda rows: ", ".join(f"({quote(d)}, {quote(n)})" for d, n in rows)
    line_gap = quote(LINE_GAP.replace("\\n", "\n"))
    lines = f"replace(regexp_replace(body, {line_gap}, '  ', 'g'), chr(10), ' ' || chr(10) || ' ')"
    return f"""
        WITH known(known, license_id) AS (VALUES {values(sorted(whole_digests().items()))}),
        notices(known, license_id) AS (VALUES {values(known_rows())}),
        a AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {files})),
        b AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM a),
        c AS (SELECT *, regexp_replace(low, {quote(COPYRIGHT_LINE)}, '', 'g') AS body FROM b),
        d AS (SELECT doc_id, {plain('body')} AS words, regexp_replace({plain(bare)}, {quote(TITLE)}, '') AS bare, string_split({spelled_sql(lines)}, chr(10)) AS lines FROM c),
        w AS (SELECT doc_id, md5(words) AS text_md5, md5(bare) AS bare_md5, md5(regexp_replace(words, {quote(TITLE)}, '')) AS untitled_md5, list_transform(lines, lambda x: md5(trim(x, ' '))) AS lines FROM d),
        l AS (SELECT doc_id, unnest(lines) AS h FROM w),
        h AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS names FROM l JOIN notices ON h = known GROUP BY doc_id)
        SELECT w.doc_id, w.text_md5, coalesce(k.license_id, m.license_id, n.license_id) AS whole_license, coalesce(h.names, '') AS line_licenses, coalesce(h.n, 0)::BIGINT AS n_license_lines
        FROM w LEFT JOIN known k ON w.text_md5 = k.known LEFT JOIN known m ON w.bare_md5 = m.known LEFT JOIN known n ON w.untitled_md5 = n.known LEFT JOIN h ON w.doc_id IS NOT DISTINCT FROM h.doc_id
    """
