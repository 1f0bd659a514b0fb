"""License scans by canonical digest lookup (operator 9), in DataFrame functions only.

Three kinds of units of a text are looked up: the whole text, each of its lines
and each run of whole paragraphs that begins as a known licence does and has as
many paragraphs. A unit is brought to a canonical form: lower case, copyright
statements dropped, equivalent spellings made one, punctuation, line ends and
white space as single blanks; so neither line width nor comment signs matter.
Its SHA-256 is then looked up by a hash join in the digests of known licence
texts and notices. Short ones are held as texts, long ones as digests only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

# Licence texts and notices as their publishers word them.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\n"
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_AGPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.\n\n"
    "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_EPL_NOTICE = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <http://unlicense.org/>"
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n\n"
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
SPDX_IDS = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-1.0", "EPL-2.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE), ("BSL-1.0", _BOOST),
    ("Apache-2.0", _APACHE_NOTICE), ("GPL-3.0-or-later", _GPL_NOTICE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("AGPL-3.0-or-later", _AGPL_NOTICE), ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."), ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("EPL-2.0", _EPL_NOTICE), ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."), ("EPL-2.0", "Released under the Eclipse Public License, Version 2.0."), ("EPL-1.0", "Licensed under the Eclipse Public License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    *((x, f"SPDX-License-Identifier: {x}") for x in SPDX_IDS),
]

# Whole licences as their publishers distribute them, by canonical form:
# licence, paragraphs, SHA-256 of the first paragraph, SHA-256 of the whole.
DIGESTS: list[tuple[str, int, str, str]] = [
    ("Apache-2.0", 27, "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", 32, "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Artistic-1.0-Perl", 29, "9fed8b0e06b2229a97a10906ed7a4e4608b849d85ed54da1ada55f2d05e8d9db", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", 13, "021f3f319970fcf1f6e1d478e5367d797699877f3434ad73ee1ef815fdc7cd63", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", 57, "8d2eae4d251844e9a73f0504efb40de0122c63022a833e6e0f5caafcd8f04324", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", 67, "f42b2e6807623175c74cf8ca228746283c01775b536214b79d00df84c9a65ffa", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", 35, "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", 50, "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 44, "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", 59, "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", 109, "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", 122, "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", 71, "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", 83, "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", 73, "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", 85, "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 37, "b1dddaf7ef2e30067896bb2f11cf3c9defcf11564304f448a9257f49502a9e85", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 73, "e8d78c7ef0b7fb5f931ba9501977c8ca266cc1ab4b95b40fea21f3a7867310ca", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", 83, "58c9a1c62b739e4bead89c80c6af62cd77999c648016e24ba011e53180a5cc15", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]

#: A line that states a copyright, of the text in lower case after a line end; a line that only speaks of copyright stays.
STATEMENT = r"\n[^\p{L}\p{N}\n]*(?:(?:copyright[ \t]*(?:\(c\)|©|:|by |[0-9]{4}|<year>|\[yyyy\])|\(c\)[ \t]*(?:copyright|[0-9]{4})|©)[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
# Spellings that mean the same, of parts of words and of words beside each other.
WORDS = [
    ("acknowledgement", "acknowledgment"), ("artefact", "artifact"), ("authoris", "authoriz"), ("cancelled", "canceled"), ("centre", "center"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("https", "http"),
    ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("merchantibility", "merchantability"), ("offence", "offense"), ("organis", "organiz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("wilful", "willful"),
]
PHRASES = [("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("non commercial", "noncommercial"), ("per cent", "percent")]
PARAGRAPH = r"\n\n+"
#: The most known texts that one scan takes: their first paragraphs are constants of its plan.
MAX_KNOWN = 10_000


def _lines(text: Column) -> Column:
    """The text in canonical words, with its line ends."""
    out = F.regexp_replace(F.concat(F.lit("\n"), F.lower(text)), STATEMENT, "\n")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    for old, new in [*WORDS, (" \n", "\n"), ("\n ", "\n")]:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out, F.lit(" \n"))


def _joined(lines: Column) -> Column:
    """Canonical lines as one run of words."""
    out = F.replace(lines, F.lit("\n"), F.lit(" "))
    for old, new in PHRASES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _close(lines: Column) -> Column:
    """Canonical lines without the empty ones between paragraphs."""
    return F.regexp_replace(lines, PARAGRAPH, "\n")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None, digests: list[tuple[str, int, str, str]] | None = None) -> DataFrame:
    """digest, license_id, n, first: one row for each known text (the first id, if two texts agree).

    n counts its paragraphs, first is the digest of the first one.
    """
    rows = spark.createDataFrame(KNOWN if known is None else known, "license_id string, body string").select("license_id", _lines(F.col("body")).alias("_l"))
    rows = rows.select("license_id", F.size(F.split("_l", PARAGRAPH)).alias("n"), F.sha2(_joined(F.split("_l", PARAGRAPH)[0]), 256).alias("first"), F.sha2(_joined(_close(F.col("_l"))), 256).alias("digest"))
    rows = rows.union(spark.createDataFrame(DIGESTS if digests is None else digests, "license_id string, n int, first string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("n").alias("n"), F.min("first").alias("first"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, kind (text, line or block), unit, license_id, digest of each unit that is a known licence.

    unit is 0 for the whole text, else the line's number among the lines
    that are left without copyright statements at the text's ends, or the
    block's first paragraph, from 1. Only texts of several lines have lines,
    only blocks of several lines count that are not the whole text. Null and
    empty texts, and units whose canonical form is empty, match nothing;
    repeated rows give repeated findings; other columns are left aside. The
    known texts are at most MAX_KNOWN; their digests are joined by broadcast
    only where Spark's own size check allows it.
    """
    starts = known.select("first", "n").distinct().limit(MAX_KNOWN + 1).collect()
    if len(starts) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known texts")
    firsts, sizes = sorted({r.first for r in starts}), sorted({r.n for r in starts})
    canon = docs.select("doc_id", _lines(F.col("text")).alias("_l")).where("_l <> ''")
    parts = canon.select("doc_id", "_l", F.split("_l", PARAGRAPH).alias("_q"))
    begins = F.filter(F.sequence(F.lit(1), F.size("_q")), lambda i: F.sha2(_joined(F.element_at("_q", i)), 256).isin(firsts))
    runs = F.flatten(F.transform(begins, lambda i: F.transform(F.filter(F.array(*map(F.lit, sizes or [0])), lambda n: (i + n - 1 <= F.size("_q")) & ((i > 1) | (n < F.size("_q")))), lambda n: F.struct(i.alias("unit"), F.array_join(F.slice("_q", i, n), "\n\n").alias("body")))))
    blocks = F.filter(runs, lambda r: F.instr(r["body"], F.lit("\n")) > 0)
    blocks = F.transform(blocks, lambda r: F.struct(F.lit("block").alias("kind"), r["unit"].cast("long").alias("unit"), F.replace(r["body"], F.lit("\n\n"), F.lit("\n")).alias("body")))
    lines = F.when(F.instr("_l", F.lit("\n")) > 0, F.transform(F.split("_l", "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), (i + 1).cast("long").alias("unit"), x.alias("body")))).otherwise(F.slice(F.array(F.struct(F.lit("line").alias("kind"), F.lit(0).cast("long").alias("unit"), F.lit("").alias("body"))), 1, 0))
    whole = F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).cast("long").alias("unit"), _close(F.col("_l")).alias("body")))
    each = parts.select("doc_id", F.explode(F.concat(whole, lines, blocks if firsts else F.slice(whole, 1, 0))).alias("u"))
    each = each.select("doc_id", "u.kind", "u.unit", F.sha2(_joined(F.col("u.body")), 256).alias("digest"))
    return each.join(known.select("digest", "license_id"), "digest").select("doc_id", "kind", "unit", "license_id", "digest")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, F.broadcast(known_digests(spark)))  # the bundled texts: tens of rows


def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, '{old}', '{new}')"
    return text


def _sql_lines(text: str) -> str:
    out = f"regexp_replace(regexp_replace(chr(10) || lower({text}), '{STATEMENT}', chr(10), 'g'), '{PUNCTUATION}', ' ', 'g')"
    return f"trim(replace(replace({_replaced(out, WORDS)}, ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10)), ' ' || chr(10))"


def _sql_joined(lines: str) -> str:
    return _replaced(f"replace({lines}, chr(10), ' ')", PHRASES)


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    more = ", ".join(f"('{a}', {n}, '{first}', '{digest}')" for a, n, first, digest in DIGESTS)
    paragraphs = "regexp_split_to_array(l, '\\n\\n+')"
    return f"""
WITH k0 AS (SELECT license_id, {_sql_lines('body')} AS l FROM (VALUES {values}) AS k(license_id, body)),
k1 AS (SELECT license_id, len({paragraphs}) AS n, sha256({_sql_joined(paragraphs + '[1]')}) AS first, sha256({_sql_joined("regexp_replace(l, '\\n\\n+', chr(10), 'g')")}) AS digest FROM k0 UNION ALL SELECT * FROM (VALUES {more}) AS m(license_id, n, first, digest)),
known AS (SELECT digest, min(license_id) AS license_id FROM k1 GROUP BY digest),
t AS (SELECT * FROM (SELECT doc_id, {_sql_lines('text')} AS l FROM documents) WHERE l <> ''),
p AS (SELECT doc_id, l, {paragraphs} AS q FROM t),
b AS (SELECT doc_id, l, q, unnest(range(1, len(q) + 1)) AS unit FROM p),
c AS (SELECT * FROM b WHERE sha256({_sql_joined('q[unit]')}) IN (SELECT first FROM k1)),
r AS (SELECT doc_id, l, unit, array_to_string(q[unit:unit + n - 1], chr(10) || chr(10)) AS body FROM c JOIN (SELECT DISTINCT n FROM k1) s ON unit + n - 1 <= len(q) AND (unit > 1 OR n < len(q))),
units AS (SELECT doc_id, 'text' AS kind, 0 AS unit, regexp_replace(l, '\\n\\n+', chr(10), 'g') AS body FROM t
  UNION ALL SELECT doc_id, 'line', unnest(range(1, len(string_split(l, chr(10))) + 1)), unnest(string_split(l, chr(10))) FROM t WHERE contains(l, chr(10))
  UNION ALL SELECT doc_id, 'block', unit, replace(body, chr(10) || chr(10), chr(10)) FROM r WHERE contains(body, chr(10)))
SELECT doc_id, kind, CAST(unit AS BIGINT) AS unit, license_id, digest FROM (SELECT doc_id, kind, unit, sha256({_sql_joined('body')}) AS digest FROM units) u JOIN known USING (digest)"""
