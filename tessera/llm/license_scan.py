"""Licence scan by canonical digests.

A text is canonicalised (copyright lines out, lower case, equivalent spellings made one, punctuation and white space to
single spaces) and its digest is hash-joined with the digests of known licence texts and statements, canonicalised the
same way. What is looked up whole: the document, each of its paragraphs (parts between empty lines) and each line.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name, small, table

#: Words spelt in two ways, and the form that both become.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("authoris", "authoriz"), ("favour", "favor"), ("whilst", "while"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("acknowledgement", "acknowledgment")]

PERMISSIVE, COPYLEFT, RESTRICTED, DEDICATION = "permissive", "copyleft", "restricted", "public-domain"

#: SPDX id, class, names by which statements call the licence.
NAMES = [
    ("MIT", PERMISSIVE, ["MIT License", "MIT"]),
    ("Apache-2.0", PERMISSIVE, ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"]),
    ("BSD-2-Clause", PERMISSIVE, ["BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"]),
    ("BSD-3-Clause", PERMISSIVE, ["BSD 3-Clause License", "BSD-3-Clause", "New BSD License"]),
    ("ISC", PERMISSIVE, ["ISC License", "ISC"]),
    ("Zlib", PERMISSIVE, ["zlib License", "zlib"]),
    ("BSL-1.0", PERMISSIVE, ["Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0"]),
    ("MPL-2.0", COPYLEFT, ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"]),
    ("EPL-2.0", COPYLEFT, ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "EPL-2.0"]),
    ("GPL-2.0", COPYLEFT, ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2"]),
    ("GPL-3.0", COPYLEFT, ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3"]),
    ("LGPL-2.1", COPYLEFT, ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"]),
    ("LGPL-3.0", COPYLEFT, ["GNU Lesser General Public License, version 3", "LGPL-3.0"]),
    ("AGPL-3.0", COPYLEFT, ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"]),
    ("CC0-1.0", DEDICATION, ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"]),
    ("CC-BY-4.0", PERMISSIVE, ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"]),
    ("CC-BY-SA-4.0", COPYLEFT, ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-NC-4.0", RESTRICTED, ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-ND-4.0", RESTRICTED, ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"]),
    ("CC-BY-NC-SA-4.0", RESTRICTED, ["CC BY-NC-SA 4.0"]),
    ("CC-BY-NC-ND-4.0", RESTRICTED, ["CC BY-NC-ND 4.0"]),
]
#: Forms of a statement; {} is the licence's name.
FORMS = ["{}", "SPDX-License-Identifier: {}", "License: {}", *[f"{w}{v} under {t}{{}}" for w in ("", "This work is ", "This software is ", "This project is ", "This file is ", "This program is ", "The code is ", "This text is ", "This document is ") for v in ("licensed", "released", "distributed", "available") for t in ("", "the ", "the terms of the ")]]
#: Statements without a licence's name.
STATEMENTS = [("LicenseRef-all-rights-reserved", RESTRICTED, "All rights reserved."), ("LicenseRef-public-domain", DEDICATION, "This work is in the public domain.")]

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: Whole licence texts; each is known with and without the title before it.
TEXTS = [("MIT", PERMISSIVE, "MIT License", _MIT_BODY), ("ISC", PERMISSIVE, "ISC License", _ISC_BODY), ("BSD-2-Clause", PERMISSIVE, "BSD 2-Clause License", _BSD_2 + _BSD_END), ("BSD-3-Clause", PERMISSIVE, "BSD 3-Clause License", _BSD_2 + _BSD_3 + _BSD_END), ("Apache-2.0", PERMISSIVE, "", _APACHE), ("Zlib", PERMISSIVE, "zlib License", _ZLIB)]

#: A copyright line, in a text whose lines are parted by \n. The statement "All rights reserved." is none.
COPYRIGHT = r"(^|\n)[ \t*#/]*([Cc]opyright|COPYRIGHT|\([Cc]\)|©)[^\n]*"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_text(s: str) -> str:
    """What canonical() makes of a string, in Python, for the known texts."""
    s = re.sub(_GAP, " ", re.sub(COPYRIGHT, "\n", s).lower()).strip(" ")
    for a, b in SPELLINGS:
        s = s.replace(a, b)
    return s


def canonical(c: str | Column) -> Column:
    """The canonical form of a text: what the digests are made of."""
    c = F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, COPYRIGHT, "\n")), _GAP, " "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def known() -> list[tuple[str, str, str]]:
    """(digest, licence id, class) of everything known, by digest."""
    out = {}
    for name, kind, names in NAMES:
        for form in FORMS:
            for x in names:
                if form != "{}" or len(x.split()) > 1:
                    out[canonical_text(form.format(x))] = (name, kind)
    for name, kind, s in STATEMENTS:
        out[canonical_text(s)] = (name, kind)
    for name, kind, title, body in TEXTS:
        out[canonical_text(body)] = out[canonical_text(f"{title}\n\n{body}")] = (name, kind)
    return sorted((hashlib.md5(k.encode()).hexdigest(), *v) for k, v in out.items())


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, more) with a last struct column `licenses`: ids (sorted array), classes (sorted array), whole
    (boolean: the document as a whole is a known text).

    Null and empty texts have no licences; a text of copyright lines alone has none. Texts of any length are looked up
    whole, by paragraph and by line. Repeated rows get equal results. All columns stay; the struct's name gets
    underscores on a clash. Empty table: no rows.
    """
    spark = docs.sparkSession
    digests = spark.createDataFrame(known(), "digest string, id string, class string")  # fixed in number, so broadcast
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("b"), F.col("text")).alias("b"))
    spans = docs.where("text <> ''").select(key.alias("key"), "text")
    level = lambda name, parts: spans.select("key", F.lit(name).alias("level"), F.explode(parts).alias("span"))
    spans = level("document", F.array("text")).union(level("part", F.concat(F.split("text", r"\n[ \t\r]*\n"), F.split("text", "\n"))))
    hits = spans.select("key", "level", F.md5(canonical("span").cast("binary")).alias("digest")).join(F.broadcast(digests), "digest")
    hits = hits.groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.sort_array(F.collect_set("class")).alias("classes"), F.max(F.col("level") == "document").alias("whole"))
    hits = cut(hits.select("key", F.struct("ids", "classes", "whole").alias("hit")))
    none = F.array().cast("array<string>")
    whole_row = free_name(docs, "row")
    out = docs.select(F.struct("*").alias(whole_row), key.alias("key")).join(small(hits), "key", "left")
    found = F.struct(F.coalesce("hit.ids", none).alias("ids"), F.coalesce("hit.classes", none).alias("classes"), F.coalesce("hit.whole", F.lit(False)).alias("whole"))
    # the result before the star: an expanded column would take the place of one of the same name here
    name = free_name(docs, "licenses")
    return out.select(whole_row, found.alias(name)).select(f"{whole_row}.*", name)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = F.col("licenses")
    return found.select("doc_id", F.size(x["ids"]).cast("long").alias("n_licenses"), F.array_join(x["ids"], ",").alias("license_ids"), F.array_join(x["classes"], ",").alias("classes"), x["whole"].alias("whole_text"))


def oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"trim(regexp_replace(lower(regexp_replace(span, {quote(COPYRIGHT)}, chr(10), 'g')), {quote(_GAP)}, ' ', 'g'), ' ')"
    for a, b in SPELLINGS:
        form = f"replace({form}, '{a}', '{b}')"
    rows = ", ".join(f"('{d}', '{i}', '{c}')" for d, i, c in known())
    return f"""
WITH known(digest, id, class) AS (VALUES {rows}),
spans AS (
  SELECT doc_id, 1 AS whole, text AS span FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, 0, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, 0, unnest(string_split(text, chr(10))) FROM documents WHERE text <> ''
), hits AS (SELECT doc_id, whole, id, class FROM spans JOIN known ON md5({form}) = digest),
per AS (SELECT doc_id, list_sort(list_distinct(list(id))) AS ids, list_sort(list_distinct(list(class))) AS classes, max(whole) AS whole FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ids), 0) AS n_licenses, coalesce(array_to_string(ids, ','), '') AS license_ids,
  coalesce(array_to_string(classes, ','), '') AS classes, coalesce(whole, 0) = 1 AS whole_text
FROM documents d LEFT JOIN per USING (doc_id)
"""
