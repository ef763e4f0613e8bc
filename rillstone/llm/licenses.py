"""License scan by canonical digest lookup.

A text is canonicalised (case, copyright lines, list marks, equivalent spellings, punctuation, spacing) and
the SHA-256 of the whole canonical text is hash-joined to the digests of known license texts.  Each line
is a text of its own, too: its canonical form is looked up the same way, which finds the notices that
documents carry in a header or footer line.  All steps are DataFrame functions.

Known are the texts in KNOWN_TEXTS, each with and without its usual title lines and the reservation of
rights, and the long licenses in KNOWN_DIGESTS, of which only the digest of the canonical text is kept.
Other texts can be given to ``known_digests``.

Cases: a null text counts as empty; the empty canonical text (null, blank, punctuation only) matches
nothing; of several licenses with one digest the smallest id is reported; each row is reported by itself,
whether ids or whole rows repeat or ids are null; a document that contains several notices lists their
distinct ids in order; an empty table gives an empty result.  Columns other than the id and the text are not
read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.broadcasts import small_side
from .rows import version_of

# Texts of well-known licenses and of the notices that stand for them.
KNOWN_TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-1-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.
IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "FSFAP": """Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "AGPL-3.0-or-later-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
    "MIT-notice": "Released under the MIT License.",
    "BSD-notice": "Released under the BSD License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
}

WHOLE_TEXTS = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "BSD-1-Clause", "0BSD", "MIT-0", "Zlib", "BSL-1.0", "PostgreSQL")
RESERVED = "All rights reserved."

# Title lines that stand above a license's text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause Simplified License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause New or Revised License", "New BSD License", "BSD License"),
    "BSD-1-Clause": ("BSD 1-Clause License",),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "PostgreSQL": ("PostgreSQL License", "The PostgreSQL License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

# SHA-256 of the canonical forms of long licenses.
KNOWN_DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "ee1a252f5e5a4efa1e1f4a2c7b4927e22775c19aa4ab6a294d8a001dc50ae7ad",
        "7fb655d7487b9e2c60a57eb2161d24c6841381bdd04369dd5e1552f18d873ed0",
        "955a5b291d2bce93b2ed50a5c13a107dca64384aa249dbcf2222773d1444df1e",
    ),
    "Artistic-1.0": ("93cf911d6aeaeddae25b1ec31d6f9129a638a5e19479508f871936d6ea33a438",),
    "BSD-4-Clause-UC": ("ad36decb11ca5d9e70cd0be03810966574e46e926c24abb97823ef38585ef4aa",),
    "CC0-1.0": ("9c565379ec41a22f83a96b4e126b9663073d1501fda5ca866572ffde24494ee8",),
    "GFDL-1.2": ("f06e13c60d6e72f50060a62af9a4b0a61b7dcc5a13491961429f83bbed44f441",),
    "GFDL-1.3": ("72a59bd878eb610518286e445e4d63081ed19ef3b262d294135bae3d421c2c69",),
    "GPL-1.0": ("260f9d601304e993e8b1ad569f2e33deaf5111d68bf9d6cdc87269393b6bc1d5",),
    "GPL-2.0": ("d36236a4136c7654ed59330f684502448f47eb54d6195fb6e1bb7287e161f012",),
    "GPL-3.0": ("9f6a81913f42b50e1208f5c89ce851a5df31278a74f8c5da130ad1eef2cb717a",),
    "LGPL-2.0": ("d341a9698c68bef7c8d10bdadd346e2b69ffa9840215f0f78b8c91bb007d9a4c",),
    "LGPL-2.1": ("f9c3d9f28875c1fc99bc2a3900eff52dc8c2d7b243fd16f8f723b5a6dec58353",),
    "LGPL-3.0": ("1b8c024ba9b7dc45073aaa2e60f90d34673c253a2b8a48d7229d53f32197bd52",),
    "MPL-1.1": ("9623dd9dd3ac74706aefa050b9b642de1aebed219882042461feceb37a5b23d8",),
    "MPL-2.0": ("a797f58f0ca0df4dccc1c7acbc94119ac671591e9ee74bc0362e84031d3ba939",),
    "Python-2.0": ("926bf702bc2e95fba986de1b6af5cbf84659bf0221bfce8358651867a9fe2336",),
}

# The canonicalisation, as (pattern, replacement) in the order of application.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|:|by |[0-9]{4})|(\(c\)|©)[ \t]*([0-9]{4}|copyright))[^\n]*$"
LIST_MARK = r"(?m)^[ \t]*([0-9]{1,2}[.)]|[*•-])[ \t]+"
SPELLINGS = (
    (r"(sub|re)[ -](licen|distribut)", "{1}{2}"),
    (r"licence", "license"),
    (r"([a-z]{3})is(e|ed|es|er|ers|ing|ation|ations)([^\p{L}]|$)", "{1}iz{2}{3}"),
    (r"([a-z]{3})our(s|ed|ing|able|)([^\p{L}]|$)", "{1}or{2}{3}"),
    (r"(acknowledg|judg)ement", "{1}ment"),
)
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The text in canonical form with line breaks kept: lower case, no copyright lines and list marks, one
    spelling, one space for any run of other characters."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    out = F.regexp_replace(out, LIST_MARK, "")
    for pattern, put in SPELLINGS:
        out = F.regexp_replace(out, pattern, put.replace("{", "$").replace("}", ""))
    return F.regexp_replace(out, NOT_WORD, " ")


def whole(canonical: Column) -> Column:
    return F.trim(F.regexp_replace(canonical, r"[ \n]+", " "))


def variants(texts: dict[str, str], titles: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(license_id, text) of all known forms: with and without a title line, and with the reservation of
    rights that often stands between copyright line and text."""
    out = []
    for name, text in texts.items():
        for title in ("", *titles.get(name, ())):
            for reserved in ("", RESERVED) if name in WHOLE_TEXTS else ("",):
                out.append((name, "\n".join(x for x in (title, reserved, text) if x)))
    return out


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of the known texts in all their forms and, without ``texts`` of one's own, of the
    long licenses that are known by digest alone: a table of fixed size."""
    forms = variants(texts or KNOWN_TEXTS, TITLES)
    rows = spark.createDataFrame(forms, "license_id string, text string").select("license_id", F.sha2(whole(canonical_lines(F.col("text"))), 256).alias("digest"))
    if texts is None:
        rows = rows.union(spark.createDataFrame([(k, d) for k, ds in KNOWN_DIGESTS.items() for d in ds], "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 100_000) -> DataFrame:
    """One row per document row: id, ``version`` (hash of the text), digest of its canonical text,
    ``license_id`` (the whole text is this license, else null) and ``notices`` (ids of the licenses that
    single lines match, else null).

    A text is canonicalised once; the digests of the whole and of its lines are joined to the known ones,
    which are broadcast up to ``max_broadcast`` rows.  Only matching lines and one row for each text are
    grouped, by the row's own number, so a group is as large as one document at most.
    """
    base = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(f"`{id_col}`").alias("doc_id"), version_of(text_col).alias("version"),
        canonical_lines(F.col(f"`{text_col}`").cast("string")).alias("canonical"),
    )
    lines = F.array_distinct(F.filter(F.transform(F.split("canonical", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    texts = base.select("row_no", "doc_id", "version", whole(F.col("canonical")).alias("flat"), lines.alias("lines"))
    # outer: for a plain explode the planner puts a filter on the array's size below, which canonicalises again
    digested = texts.select("row_no", "doc_id", "version", F.when(F.col("flat") != "", F.sha2("flat", 256)).alias("text_digest"), F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), "lines")).alias("line"))
    keyed = digested.withColumn("digest", F.when(F.col("line").isNull(), F.col("text_digest")).otherwise(F.sha2("line", 256)))
    found = keyed.join(small_side(known, max_broadcast), "digest", "left").where("line IS NULL OR license_id IS NOT NULL")
    named = F.collect_set(F.when(F.col("line").isNotNull(), F.col("license_id")))
    out = found.groupBy("row_no", "doc_id", "version", "text_digest").agg(F.max(F.when(F.col("line").isNull(), F.col("license_id"))).alias("license_id"), named.alias("names"))
    return out.select("doc_id", "version", "text_digest", "license_id", F.when(F.size("names") > 0, F.array_join(F.array_sort("names"), ",")).alias("notices"))


def oracle() -> str:
    """The same scan as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lined = f"regexp_replace(lower(coalesce(text, '')), {quote(COPYRIGHT_LINE)}, ' ', 'g')"
    lined = f"regexp_replace({lined}, {quote(LIST_MARK)}, '', 'g')"
    for pattern, put in SPELLINGS:
        lined = f"regexp_replace({lined}, {quote(pattern)}, {quote(put.replace('{', chr(92)).replace('}', ''))}, 'g')"
    lined = f"regexp_replace({lined}, {quote(NOT_WORD)}, ' ', 'g')"
    flat = "trim(regexp_replace(canonical, '[ \n]+', ' ', 'g'))"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in variants(KNOWN_TEXTS, TITLES))
    digests = ", ".join(f"({quote(k)}, {quote(d)})" for k, ds in KNOWN_DIGESTS.items() for d in ds)
    return f"""
WITH texts(license_id, text) AS (VALUES {values}),
known AS (SELECT digest, min(license_id) AS license_id FROM (
  SELECT license_id, sha256({flat}) AS digest FROM (SELECT license_id, {lined} AS canonical FROM texts)
  UNION ALL SELECT * FROM (VALUES {digests}) fixed(license_id, digest)) GROUP BY digest),
base AS (SELECT row_number() OVER () AS row_no, doc_id, {lined} AS canonical FROM documents),
lines AS (SELECT row_no, trim(unnest(string_split(canonical, '\n'))) AS line FROM base),
hits AS (SELECT row_no, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM lines JOIN known ON known.digest = sha256(line) WHERE line <> '' GROUP BY row_no),
whole AS (SELECT row_no, doc_id, CASE WHEN {flat} <> '' THEN sha256({flat}) END AS text_digest FROM base)
SELECT w.doc_id, w.text_digest, k.license_id, h.notices
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN hits h ON h.row_no = w.row_no
"""
