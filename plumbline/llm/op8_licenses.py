"""License scans by canonical digest, with DataFrame functions alone.

``scan`` brings a text to canonical form (case, copyright lines, equivalent spellings,
punctuation, white space), hashes the whole of it and joins the digest to known licences.
The same is done with each line, so that a notice inside a longer text is found as well.

Result: one row per input row with scope ``document`` and line 0 (``license`` null where the
whole text is no known licence), and one row per line that is a known licence or notice, with
scope ``line`` and its number from 1.  Null and empty texts, and texts of punctuation alone,
have a null digest and match nothing.  Repeated rows repeat their rows; null ids are kept;
other columns of the input are ignored.  No row depends on another, so nothing is shuffled
unless the table of known digests is too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import load

# Public licence texts and notices.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    (
        "MIT",
        """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """zlib License

Copyright (c) <year> <copyright holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSD-2-Clause",
        """BSD 2-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
]

# Spellings that count as equal. c and z are read as s (licence, license; organise, organize); then
# these parts of words are rewritten, on the text so folded (favour, favor; cancelled, canceled; catalogue, catalog).
FOLD_FROM, FOLD_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZcz", "absdefghijklmnopqrstuvwxysss"
SPELLINGS = [
    ("our", "or"),
    ("ll", "l"),
    ("logue", "log"),
    ("gramme", "gram"),
    ("dgement", "dgment"),
    ("artefast", "artifast"),
    ("sentre", "senter"),
    ("whilst", "while"),
    ("opyright owner", "opyright holder"),
]

MARKS = "\t\r\f\v!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~©“”‘’–—\u00a0"
COPYRIGHT_LINE = (
    r"(^|\n)[ \t#*/;-]*([Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt][ \t]+(\([Cc]\)|©|[0-9<]|[Bb][Yy][ \t])|\([Cc]\)|©|[Aa][Ll][Ll] [Rr][Ii][Gg][Hh][Tt][Ss] [Rr][Ee][Ss][Ee][Rr][Vv][Ee][Dd])[^\n]*"
)
#: Known digests up to which they are broadcast (some 100 bytes each).
BROADCAST_ROWS = 200_000
#: Keys over which a digest's rows are spread when the table is joined.
SALTS = 16


def _folded(text: Column) -> Column:
    """Words and lines of a text in canonical spelling, still apart. Parts of words never meet across a blank or a line's end."""
    c = F.regexp_replace(text, COPYRIGHT_LINE, "$1")
    c = F.translate(c, FOLD_FROM + MARKS, FOLD_TO + " " * len(MARKS))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _digest(folded: Column) -> Column:
    """Digest of what is left without blanks and line ends; null if nothing is."""
    c = F.translate(folded, " \n", "")
    return F.when(c != "", F.sha2(c, 256))


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``license, digest`` of the given (identifier, text) pairs: one row per digest, the smallest identifier."""
    rows = spark.createDataFrame(texts or KNOWN, "license string, body string")
    return rows.select("license", _digest(_folded(F.col("body"))).alias("digest")).dropna().groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, scope, line, license, digest``; see the module. ``known``: license, digest, one row per digest."""
    known = known.select("license", "digest")
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    base = docs.select(F.col(doc_id).alias("doc_id"), _folded(F.coalesce(F.col(text), F.lit(""))).alias("folded"))
    units = base.select("doc_id", F.posexplode(F.concat(F.array("folded"), F.split("folded", "\n", -1))).alias("line", "unit"))
    hashed = units.select("doc_id", "line", _digest(F.col("unit")).alias("digest"))
    scope = F.when(F.col("line") == 0, "document").otherwise("line")
    if small:
        found = hashed.join(F.broadcast(known), "digest", "left")
    else:  # texts and lines that repeat, and those without a digest, spread over several keys
        salt = F.pmod(F.xxhash64("doc_id", "line"), F.lit(SALTS))
        key = F.concat_ws(" ", F.coalesce("digest", F.concat(F.lit("none "), F.xxhash64("doc_id", "line").cast("string"))), salt.cast("string"))
        spread = known.select("license", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.concat_ws(" ", "digest", k.cast("string")))).alias("key"))
        found = hashed.withColumn("key", key).join(spread, "key", "left")
    found = found.where("line = 0 OR license IS NOT NULL")
    return found.select("doc_id", scope.alias("scope"), "line", "license", "digest")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"), known_licenses(spark))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def folded(text: str) -> str:
        e = f"regexp_replace({text}, {quote(COPYRIGHT_LINE)}, '\\1', 'g')"
        e = f"translate({e}, {quote(FOLD_FROM + MARKS)}, {quote(FOLD_TO + ' ' * len(MARKS))})"
        for a, b in SPELLINGS:
            e = f"replace({e}, '{a}', '{b}')"
        return e

    digest = lambda e: f"sha256(nullif(translate({e}, ' ' || chr(10), ''), ''))"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    return f"""
WITH texts(license, body) AS (VALUES {values}),
known AS (SELECT {digest(folded("body"))} AS digest, min(license) AS license FROM texts GROUP BY 1),
base AS (SELECT doc_id, {folded("coalesce(text, '')")} AS folded FROM documents),
cut AS (SELECT doc_id, string_split(folded, chr(10)) AS parts, folded FROM base),
units AS (
  SELECT doc_id, 0 AS line, folded AS unit FROM base
  UNION ALL SELECT doc_id, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER), unnest(parts) FROM cut
),
hashed AS (SELECT doc_id, line, {digest("unit")} AS digest FROM units)
SELECT doc_id, CASE WHEN line = 0 THEN 'document' ELSE 'line' END AS scope, line, license, hashed.digest AS digest
FROM hashed LEFT JOIN known ON hashed.digest = known.digest WHERE line = 0 OR license IS NOT NULL"""


ORACLE = _oracle()
