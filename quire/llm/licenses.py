"""License scans by canonical digest lookup.

A text is brought to a canonical form: lower case, one of each pair of
equivalent spellings, runs of anything but letters and digits as one space,
copyright lines gone. The digest of the whole text, and that of each of its
lines as a text of its own (notices stand on lines), is joined by hash to the
digests of known license texts, which go through the same form. A whole text
that is none of them is looked up once more among the full texts by a looser
form: copyright lines of any kind at its head gone, list marks (single letters,
numbers up to two digits) gone wherever they stand. Everything is DataFrame
functions; a text is scanned once.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, null_safe_join

#: Spellings that count as one, applied in this order.
EQUIVALENT = [
    ("©", "copyright"), ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("https:", "http:"), ("merchantibility", "merchantability"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("organisation", "organization"), ("utilisation", "utilization"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("judgement", "judgment"), ("copyright owner", "copyright holder"),
]

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: License, title (which a copy may leave out), text.
FULL_TEXTS = [
    ("MIT", "MIT License", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _AS_IS),
    ("ISC", "ISC License", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
""" + _ISC_END),
    ("0BSD", "BSD Zero Clause License", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
""" + _ISC_END),
    ("BSD-2-Clause", "BSD 2-Clause License", _BSD_START + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License", _BSD_START + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_END),
    ("Zlib", "zlib License", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
]

#: License, notice that names it.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def known_licenses() -> list[tuple[str, str]]:
    """(license, text) of full texts, with and without title, of notices, and
    of the identifier lines of all of them."""
    names = dict.fromkeys([name for name, *_ in FULL_TEXTS] + [name for name, _ in NOTICES])
    return ([(name, text) for name, _, text in FULL_TEXTS] + [(name, f"{title}\n{text}") for name, title, text in FULL_TEXTS]
            + NOTICES + [(name, f"SPDX-License-Identifier: {name}") for name in names])


#: Full texts of longer licenses, a file each, named by its license.
TEXTS = Path(__file__).with_name("license_texts")

#: Usual titles of the texts in FULL_TEXTS.
TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", "MIT"],
    "ISC": ["The ISC License", "The ISC License (ISC)", "ISC License (ISC)", "ISC"],
    "0BSD": ["Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD"],
    "BSD-2-Clause": ["The BSD 2-Clause License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License", "The 2-Clause BSD License",
                     "BSD License", "The BSD License"],
    "BSD-3-Clause": ["The BSD 3-Clause License", "New BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "The 3-Clause BSD License",
                     "Modified BSD License", "BSD License", "The BSD License"],
    "Zlib": ["The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of full texts: the short ones with and without their
    titles, the others with and without what follows the end of their terms,
    and each of these on one line, where no copyright line of their own goes."""
    out = [(name, text) for name, _, text in FULL_TEXTS]
    out += [(name, f"{t}\n{text}") for name, title, text in FULL_TEXTS for t in [title, *TITLES[name]]]
    for path in sorted(TEXTS.glob("*.txt")):
        text, end = path.read_text(encoding="utf-8"), "END OF TERMS AND CONDITIONS"
        forms = [text]
        if end in text:
            terms = text[:text.index(end)]
            forms += [terms, terms + end]
        out += [(path.stem, form) for text in forms for form in (text, " ".join(text.split()))]
    return out


def canonical_lines(text: Column) -> Column:
    """Canonical lines, without empty ones and copyright lines."""
    form = F.lower(F.coalesce(text, F.lit("")))
    for variant, common in EQUIVALENT:
        form = F.replace(form, F.lit(variant), F.lit(common))
    form = F.regexp_replace(form, r"[^\p{L}\p{N}\n]+", " ")
    lines = F.transform(F.split(form, "\n", -1), lambda line: F.trim(line))
    return F.filter(lines, lambda line: (line != "") & ~line.rlike("^(copyright )+((c )?[0-9]{4}( |$)|c )") & (line != "all rights reserved"))


def digest(lines: Column) -> Column:
    """Digest of the text that the lines make up, however it is wrapped."""
    return F.sha2(F.array_join(lines, " "), 256)


def loose_digest(lines: Column) -> Column:
    """Digest of the text that canonical lines make up, without copyright lines
    of its head (lines that start as one, or are a title: up to 8 words with
    "license", or "mit", "isc", "0bsd" alone), lines of a sign and a year or of
    a place left for them, and without list marks."""
    copyright_line = r"^(copyright|c [0-9]{4})"
    title = r"^(?=.*\blicense\b)([^ ]+( |$)){1,8}$|^(mit|isc|0bsd|zero clause bsd)$"
    body = F.array_position(F.transform(lines, lambda x: ~x.rlike(copyright_line) & ~x.rlike(title)), F.lit(True)).cast("int")
    head = F.greatest(body - 1, F.lit(0))
    own = F.concat(F.filter(F.slice(lines, F.lit(1), head), lambda x: ~x.rlike(copyright_line)), F.slice(lines, head + 1, F.size(lines)))
    own = F.filter(own, lambda x: ~x.rlike(r"^(copyright ?|c )+([0-9]{4}|yyyy|year|date)( |$)"))
    return F.sha2(F.trim(F.regexp_replace(F.array_join(own, " "), "(^| )([0-9]{1,2}|[a-z])(?= |$)", "")), 256)


def license_digests(licenses: DataFrame, digest=digest) -> DataFrame:
    """(digest, license) from (license, text); of licenses with one canonical
    text the first by name. Texts without any letter or digit are no license."""
    lines = canonical_lines(F.col("text"))
    return (licenses.where(F.col("license").isNotNull() & (F.size(lines) > 0)).select(digest(lines).alias("digest"), "license")
            .groupBy("digest").agg(F.min("license").alias("license")))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: DataFrame | None = None) -> DataFrame:
    """(id, text_digest, text_license, line_licenses) for every row of ``df``.

    text_license is the license that the whole text is (null: none known);
    line_licenses are those that a line of it is, sorted (empty: none). Null
    and empty texts have the digest of the empty text and no license. Repeated
    rows come out as often as they went in. Other columns are not read.
    """
    spark: SparkSession = df.sparkSession
    def texts(rows: list[tuple[str, str]]) -> DataFrame:
        return spark.createDataFrame(rows, "license string, text string")

    full = licenses if licenses is not None else texts(full_texts())
    known = license_digests(licenses if licenses is not None else texts(known_licenses()).union(full))
    known = cut_lineage(known, "license_digests")
    loose = cut_lineage(license_digests(full, loose_digest), "license_digests").where(F.col("digest") != F.sha2(F.lit(""), 256))
    units = df.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    units = units.select("id", digest(F.col("lines")).alias("text_digest"), loose_digest(F.col("lines")).alias("loose_digest"),
                         F.array_distinct(F.transform("lines", lambda x: F.sha2(x, 256))).alias("lines"))
    units = cut_lineage(units, "license_units")
    lines = units.select("id", "text_digest", F.explode("lines").alias("digest")).join(known, "digest")
    lines = lines.groupBy("id", "text_digest").agg(F.array_sort(F.collect_set("license")).alias("line_licenses"))
    whole = units.join(known.select(F.col("digest").alias("text_digest"), F.col("license").alias("text_license")), "text_digest", "left")
    whole = whole.join(loose.select(F.col("digest").alias("loose_digest"), F.col("license").alias("loose_license")), "loose_digest", "left")
    whole = whole.withColumn("text_license", F.coalesce("text_license", "loose_license"))
    found = null_safe_join(whole.drop("lines", "loose_digest", "loose_license"), lines, ["id", "text_digest"], "left")
    return found.select("id", "text_digest", "text_license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))
