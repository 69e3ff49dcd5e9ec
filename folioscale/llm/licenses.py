"""Operator 6: licence scans by canonical digest.

A known licence or notice is the digest of its canonical text. A document's whole text, and each of its lines as a text
of its own, is brought into the same form: lower case, copyright lines out, equivalent spellings made one, punctuation
and white space as single spaces. Digests meet in a hash join; texts are never compared or shortened.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Replacements in the order in which they are applied, as (pattern, replacement), in the dialect that Java and RE2 share.
RULES = [
    (r"(?m)^[ \t/*#;-]*(copyright|\(c\)|©)[^\n]*$", " "),
    (r"https?://|www\.", ""),
    (r"licence", "license"),
    (r"sub-?licens", "sublicens"),
    (r"non-?commercial", "noncommercial"),
    (r"share-?alike", "sharealike"),
    (r"no-?derivatives", "noderivatives"),
    (r"&", " and "),
    (r"\bversion ([0-9])|\bv\.? ?([0-9])", "version \\1\\2"),
    (r"[^\p{L}\p{N}]+", " "),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = {"BSD-2-Clause": f"{_BSD_HEAD}\n{_BSD_TAIL}", "BSD-3-Clause": f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_TAIL}"}

#: Names whose usual one-line notices are known, with the identifier they stand for.
NAMES = {
    "MIT License": "MIT",
    "Apache License, Version 2.0": "Apache-2.0",
    "Apache License 2.0": "Apache-2.0",
    "BSD 3-Clause License": "BSD-3-Clause",
    "BSD 2-Clause License": "BSD-2-Clause",
    "BSD License": "BSD",
    "ISC License": "ISC",
    "zlib License": "Zlib",
    "Mozilla Public License 2.0": "MPL-2.0",
    "Mozilla Public License, version 2.0": "MPL-2.0",
    "GNU General Public License, version 2": "GPL-2.0",
    "GNU General Public License, version 3": "GPL-3.0",
    "GNU General Public License v3.0": "GPL-3.0",
    "GNU Lesser General Public License, version 2.1": "LGPL-2.1",
    "GNU Lesser General Public License, version 3": "LGPL-3.0",
    "GNU Affero General Public License, version 3": "AGPL-3.0",
    "CC BY 4.0": "CC-BY-4.0",
    "CC BY-SA 4.0": "CC-BY-SA-4.0",
    "CC BY-NC 4.0": "CC-BY-NC-4.0",
    "CC BY-ND 4.0": "CC-BY-ND-4.0",
    "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
    "CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0",
    "CC0 1.0": "CC0-1.0",
    "Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
    "Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
    "Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0",
}
#: How a notice names its licence.
FORMS = ["Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is licensed under the {}."]
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_HEAD = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEAD = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_GNU_HEAD = """This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details.
You should have received a copy of the {0} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GNU = [("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3")]
WHOLE = [("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC), ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB)]
WHOLE += [(i, title + text) for i, text in _BSD.items() for title in ("", f"BSD {i[4:]} License\n")]
WHOLE += [("Unlicense", _UNLICENSE), ("BSL-1.0", _BSL), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BSL), ("0BSD", _0BSD), ("0BSD", "BSD Zero Clause License\n" + _0BSD)]
#: The entire notices by which files are put under the long licences.
WHOLE += [("Apache-2.0", _APACHE_HEAD), ("MPL-2.0", _MPL_HEAD), *((i, _GNU_HEAD.format(name, version)) for i, name, version in _GNU)]
#: Notices that grant nothing.
RESERVED = [("All-Rights-Reserved", "All rights reserved.")]


def known_texts() -> list[tuple[str, str]]:
    """Identifier and text of each known licence and notice: a fixed table of a few hundred rows."""
    notices = [(i, form.format(name)) for name, i in NAMES.items() for form in FORMS]
    spdx = [(i, f"SPDX-License-Identifier: {i}") for i in dict.fromkeys(NAMES.values())]
    return WHOLE + RESERVED + notices + spdx


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, into in RULES:
        out = F.regexp_replace(out, pattern, into.replace("\\1\\2", "$1$2"))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


#: Parts of words that known texts may be sought by: whatever the rules do, they stand in the text as it was written.
ANCHORS = ("licen", "permission", "reserved", "redistribut", "released", "distributed")
#: What the rules take out of the middle of words: an anchor may stand on both sides of it.
TAKEN = ("http", "www.")


def anchors_of(texts: list[str]) -> list[str] | None:
    """The anchors that these texts need, each with one; None if a text has none, and every text must be read."""
    lines = [re.sub(RULES[0][0], " ", text.lower()) for text in texts]  # copyright lines go
    found = {next((a for a in ANCHORS if a in line), None) for line in lines}
    return None if None in found else sorted(found)


def may_hold(text: Column, anchors: list[str]) -> Column:
    """Whether a text can have the canonical form of a text with one of the anchors: no rule but those of TAKEN makes an anchor."""
    low = F.lower(text)
    return functools.reduce(Column.__or__, [F.contains(low, F.lit(a)) for a in (*anchors, *TAKEN)])


def scan(docs: DataFrame, extra: list[tuple[str, str]] = (), text: str = "text") -> DataFrame:
    """Matches: doc_id, line (0: the whole text), license_id. extra: more licences as (identifier, text).

    A text of one line can match as a whole and as line 1. Texts whose canonical form is empty, null texts too, match
    nothing. Repeated rows each give their matches. An empty table has none. Texts and lines that cannot match, because
    they hold no part of a word that each known text has, are passed over before the rules run.
    """
    texts = known_texts() + list(extra)
    known = docs.sparkSession.createDataFrame(texts, "license_id string, text string").withColumn("canon", canonical(F.col("text"))).where("canon <> ''")
    known = known.groupBy(F.sha2("canon", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    rows = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    anchors = anchors_of([t for _, t in texts])
    if anchors:
        rows = rows.where(may_hold(F.col("body"), anchors))
    units = rows.select("doc_id", F.posexplode(F.concat(F.array("body"), F.split("body", "\n"))).alias("line", "unit"))
    if anchors:
        units = units.where(may_hold(F.col("unit"), anchors))
    # The digest is never null, so that the join adds no filter that would run the rules again.
    read = units.select("doc_id", "line", F.coalesce(digest(F.col("unit")), F.lit("")).alias("digest"))
    return read.join(F.broadcast(known), "digest").select("doc_id", "line", "license_id")  # known: a fixed table and extra


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licences found in it: doc_id, license_ids, n_matches, whole_text (licence of the entire text)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("license_ids"),
        F.count("*").alias("n_matches"),
        F.max(F.when(F.col("line") == 0, F.col("license_id"))).alias("whole_text"),
    )
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("license_ids", F.lit("")).alias("license_ids"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), "whole_text")


def _sql_canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern, into in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{into}', 'g')"
    return f"trim({out})"


def _sql_known() -> str:
    return ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known_texts())


OP6_SQL = f"""
WITH texts(license_id, text) AS (VALUES {_sql_known()}),
known AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(license_id) AS license_id FROM texts GROUP BY 1),
units AS (SELECT doc_id, 0 AS line, coalesce(text, '') AS unit FROM documents
          UNION ALL SELECT doc_id, 1, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
canon AS (SELECT doc_id, line, {_sql_canonical("unit")} AS canon FROM units),
hits AS (SELECT doc_id, line, license_id FROM canon JOIN known ON sha256(canon.canon) = known.digest WHERE canon <> ''),
found AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS license_ids, count(*) AS n_matches,
                 max(CASE WHEN line = 0 THEN license_id END) AS whole_text FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(license_ids, '') AS license_ids, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, whole_text
FROM documents d LEFT JOIN found USING (doc_id)
"""
