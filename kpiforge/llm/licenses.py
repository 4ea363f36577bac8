"""License scan by canonical digest.

A text is brought to a canonical form (lower case, no copyright notices at its
head, no punctuation, one spelling for equivalent ones), digested whole, and the
digest is hash-joined to the digests of known licences. Column functions only.

A notice is 'copyright' followed by (c), a year or a holder, or a (c) sign with
a year. Only those at the head of a text go, each up to the end of its line or
to the first words of a known licence, so the form of a licence's body does not
depend on where its lines break. A licence's title goes if its first words
follow. 'All rights reserved' goes at the head and at the end of a text.

Special input: a null text has no digest and no licence; an empty text, or one
of notices only, has zero words and never matches; repeated rows are
looked up each; when several known licences share a canonical text, the
smallest name is reported; other columns pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm.common import UPPER, table

#: Distinct known digests that are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_DIGESTS = 100_000

# Punctuation outside ASCII that becomes a space, lines that the SQL
# takes for notices, and spellings that mean the same in a licence text.
WIDE_PUNCTUATION = "“”‘’„«»–—‐‑…©®™·• "
COPYRIGHT_LINE = r"(?m)^[^0-9a-z\n]*(copyright|\(c\)|©|all rights reserved|portions copyright)[^\n]*$"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPELLINGS = [
    (r" licence", " license"),
    (r" sub license", " sublicense"),
    (r" non commercial", " noncommercial"),
    (r" per cent ", " percent "),
    (r" (acknowledg|judg)ement", " $1ment"),
    (r" (author|organ|recogn|util|initial)is(e|ed|es|ing|ation) ", " $1iz$2 "),
    (r" (fav|hon|lab|col|behavi)our", " $1or"),
    (r" whilst ", " while "),
    (r" (fulfil|wil)l?(ment|ful) ", " $1$2 "),
    (r" https? ", " "),
]

# Texts of known licences (the copyright line is not part of the digest).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""
KNOWN_LICENSES = {
    "MIT": _MIT,
    "ISC": _ISC,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib": _ZLIB,
    "Apache-2.0 notice": _APACHE_NOTICE,
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
}

# The start of a notice (the holder of one without a sign or a year begins with a capital and is none of
# the words that follow 'copyright' in running text), titles, and the first words of the known texts. A notice that no
# known text follows is at most one line of 200 characters; repetitions are bounded or possessive.
_NO_HOLDER = (r"(?i:holders?|owners?|notices?|laws?|acts?|licen[cs]es?|licensing|and|or|in|is|of|for|as|on|to|the above|infringements?|"
              r"protections?|protected|statements?|claims?|policy|terms|office|status|information|disclaimer|rights?|"
              r"reform|permissions?|assignments?|issues?|material)\b")
_SIGNED = (r"(?:(?i:(?:portions\s{1,9})?copyright)[\s:,]{0,9}(?:(?i:\(c\))|©|(?:19|20)\d\d\b)"
           r"|(?i:\(c\))\s{0,9}(?:19|20)\d\d\b|©\s{0,9}(?:(?:19|20)\d\d\b|(?i:copyright)\b|\p{Lu}))")
_HELD = rf"(?:(?i:(?:portions\s{{1,9}})?copyright)\s{{1,9}}(?:(?i:by)\s{{1,9}})?(?!{_NO_HOLDER})\p{{Lu}})"
_RESERVED = r"(?i:all\s{1,9}rights\s{1,9}reserved)"
_TITLE = (r"(?i:(?:the\s+)?(?:mit|isc|zlib|(?:(?:new|modified|simplified|revised)\s+)?bsd(?:[\s-]+[23][\s-]+clause)?|"
          r"[23][\s-]+clause\s+bsd|apache)(?:/[a-z]{1,9})?\s+licen[cs]e(?:\s+\([^)]{1,30}\))?[\s.:]+)")
_OPENINGS = "|".join(sorted({r"[^\p{L}\p{N}]+".join(re.findall(r"\w+", x)[:4]) for x in KNOWN_LICENSES.values()}))
_OPENING = rf"[^\p{{L}}\p{{N}}]{{0,40}}(?i:{_OPENINGS})\b"
_NEXT = rf"\s{{0,9}}(?:{_SIGNED}|{_HELD}|{_RESERVED}|{_OPENING}|\n[ \t]{{0,40}}\n)"
#: Title and notices before a known text; notice lines before any other; a closing 'all rights reserved'.
HEAD_OF_KNOWN = (rf"\A[^\p{{L}}\p{{N}}©(]*+{_TITLE}?(?:[^\p{{L}}\p{{N}}©(]*+(?>{_RESERVED}|(?:{_SIGNED}|{_HELD})"
                 rf"(?:(?!\n[ \t]{{0,40}}\n)[\s\S]){{0,200}}?(?={_NEXT}))){{0,50}}+(?={_OPENING})")
HEAD_LINES = (rf"\A(?:[^\p{{L}}\p{{N}}©(]*+(?:{_SIGNED}[^\n]{{0,200}}+(?:\n|\z)|{_HELD}[^\n]{{0,80}}+\n(?=\s*+\S)|"
              rf"{_RESERVED}[^\p{{L}}\p{{N}}\n]{{0,40}}+(?:\n|\z))){{1,50}}+")
CLOSING = rf"(?:\A|[\n.!?][ \t]{{0,40}}){_RESERVED}[.!\s]*+\z"


def canonical(text: Column) -> Column:
    """Canonical form: words between single spaces, with a space at both ends."""
    t = F.translate(text, "\r", "\n")
    for notices in (HEAD_OF_KNOWN, HEAD_LINES, CLOSING):
        t = F.regexp_replace(t, notices, "")
    t = F.translate(t, UPPER, UPPER.lower())
    t = F.translate(t, WIDE_PUNCTUATION, " " * len(WIDE_PUNCTUATION))
    t = F.concat(F.lit(" "), F.regexp_replace(t, PUNCTUATION, " "), F.lit(" "))
    t = F.regexp_replace(t, " +", " ")
    for found, use in SPELLINGS:
        t = F.regexp_replace(t, found, use)
    return t


def known_licenses(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in KNOWN_LICENSES.items()])
    return spark.range(1).select(F.inline(rows))


def license_digests(known: DataFrame, name: str = "license", text: str = "text") -> DataFrame:
    """(digest, license): one row per distinct canonical text of the known licences."""
    t = canonical(F.col(f"`{text}`"))
    return (known.select(F.col(f"`{name}`").alias("license"), t.alias("t")).filter(F.trim("t") != "")
            .groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("license").alias("license")))


def license_scan(docs: DataFrame, known: DataFrame, text: str = "text", out: str = "scan") -> DataFrame:
    """Add struct ``out``: canonical digest, canonical word count, and the licence whose whole text it is, or null."""
    digests = license_digests(known).select(F.col("digest").alias("_digest"), F.col("license").alias("_license"))
    if digests.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        digests = F.broadcast(digests)
    t = F.col("_canonical")
    n_words = F.when(F.trim(t) == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) - 1)
    d = docs.withColumn("_canonical", canonical(F.col(f"`{text}`")))
    d = d.withColumn("_scan", F.struct(F.sha2(t, 256).alias("digest"), n_words.cast("long").alias("n_words"))).drop("_canonical")
    d = d.join(digests, F.col("_scan.digest") == F.col("_digest"), "left")
    return d.withColumn(out, F.col("_scan").withField("license", F.col("_license"))).drop("_scan", "_digest", "_license")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), known_licenses(spark))
    return d.select("doc_id", "scan.digest", "scan.n_words", "scan.license")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    """The canonical form in DuckDB SQL, which has no look-around: every line that begins like a notice goes."""
    t = f"translate({text}, {_sql_text(UPPER)} || chr(13), {_sql_text(UPPER.lower())} || chr(10))"
    t = f"regexp_replace({t}, {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    t = f"translate({t}, {_sql_text(WIDE_PUNCTUATION)}, {_sql_text(' ' * len(WIDE_PUNCTUATION))})"
    t = f"' ' || regexp_replace({t}, {_sql_text(PUNCTUATION)}, ' ', 'g') || ' '"
    t = f"regexp_replace({t}, ' +', ' ', 'g')"
    for found, use in SPELLINGS:
        t = f"regexp_replace({t}, {_sql_text(found)}, {_sql_text(use.replace('$', chr(92)))}, 'g')"
    return t


ORACLE_SQL = f"""
WITH known(license, text) AS (VALUES {', '.join(f'({_sql_text(k)}, {_sql_text(v)})' for k, v in KNOWN_LICENSES.items())}),
digests AS (SELECT sha256(t) AS digest, min(license) AS license
            FROM (SELECT license, {_sql_canonical('text')} AS t FROM known) WHERE trim(t) <> '' GROUP BY 1),
c AS (SELECT doc_id, {_sql_canonical('text')} AS t FROM documents)
SELECT doc_id, sha256(t) AS digest,
       CAST(CASE WHEN trim(t) = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) - 1 END AS BIGINT) AS n_words,
       license
FROM c LEFT JOIN digests ON sha256(c.t) = digests.digest
"""
