"""Licence scans by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent
spellings) and its digest is looked up among the digests of known licences: whole texts
by a hash join, single lines (notices) in a map of the same digests. The form does not
depend on how lines are wrapped. Long licences are known by their digests alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import LOWER, UPPER, ascii_lower, let

#: Known licences and notices (id, text), fixed values. Copyright lines are left out: the canonical form drops them.
KNOWN = (
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("MIT-0", """MIT No Attribution

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("GPL-3.0-or-later-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("AGPL-3.0-or-later-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("MPL-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MIT-line", "Released under the MIT License."),
    ("MIT-line", "Licensed under the MIT License."),
    ("MIT-line", "This project is licensed under the MIT License."),
    ("MIT-line", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-line", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0-line", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause-line", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause-line", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause-line", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause-line", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC-line", "Licensed under the ISC License."),
    ("ISC-line", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0-line", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0-line", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-2.0-line", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-line", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-line", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-line", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0-line", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-line", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC0-1.0-line", "SPDX-License-Identifier: CC0-1.0"),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0-line", "Licensed under CC BY-ND 4.0."),
)
#: Digests of whole long licences, fixed values; the same form as below over the texts as published.
DIGESTS = (
    ("Apache-2.0", "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "452eaadd998b06b62a51be424c021eea5228803a2773e147818b9cd429a60d64"),
    ("GFDL-1.3", "c6db6132e3f9cfc574a0348860b9e8a36b70ab711ca7ec85d9c61871c2d90e55"),
    ("GPL-1.0", "eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
#: Equivalent spellings (variant, canonical) over canonical words, fixed values.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("organisation", "organization"), ("authorised", "authorized"), ("whilst", "while"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"),
    ("programme", "program"), ("judgement", "judgment"), ("fulfil", "fulfill"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"),
)
#: Lines that state a copyright or reserve rights, over lower-case lines.
COPYRIGHT = r"^[^a-z0-9©(]*(((copyright|\(c\)|©)[ \t]*)+([0-9]{4}|\[year|<year|by[ \t])|all rights reserved[^a-z0-9]*$)"
PUNCTUATION = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f“”‘’–—•]+"
VARIANT = " (" + "|".join(a for a, _ in SPELLINGS) + ") "


def lines_of(text: Column) -> Column:
    """Lower-case lines of a text without copyright lines."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: ~x.rlike(COPYRIGHT))


def canonical(x: Column) -> Column:
    """Canonical form of lower-case text: words in their canonical spelling, joined by one blank each.

    Every word gets blanks of its own, so that words next to each other are all respelt.
    """

    def spelt(x: Column) -> Column:
        y = F.replace(x, F.lit(" "), F.lit("  "))
        for a, b in SPELLINGS:
            y = F.replace(y, F.lit(spread(a)), F.lit(spread(b)))
        return F.when(x.rlike(VARIANT), F.trim(F.regexp_replace(y, " +", " "))).otherwise(F.trim(x))

    return let(F.regexp_replace(F.concat(F.lit(" "), x, F.lit(" ")), PUNCTUATION, " "), spelt)


def spread(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def whole(lines: Column) -> Column:
    return canonical(F.array_join(lines, " "))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def catalogue(spark, known=KNOWN, digests=DIGESTS) -> dict[str, str]:
    """digest -> license of the known texts; of one digest the least id. As many as known texts."""
    row = lambda i, d: F.struct(d.alias("digest"), F.lit(i).alias("license"))
    rows = [row(i, digest(whole(lines_of(F.lit(t))))) for i, t in known] + [row(i, F.lit(d)) for i, d in digests]
    out: dict[str, str] = {}
    for r in spark.range(1).select(F.inline(F.array(*rows))).collect() if rows else ():
        out[r.digest] = min(r.license, out.get(r.digest, r.license))
    return out


def scan(docs: DataFrame, known=KNOWN, digests=DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the whole canonical text, license it is as a whole (or null), n_notices lines that are known notices, and notices, their distinct ids in order.

    A null or empty text has the digest of the empty string, no licence and no notices.
    Repeated rows and null ids give one row each; other columns are ignored; an empty table
    gives no rows. Of known texts with one canonical form the least id is given.
    """
    spark = docs.sparkSession
    known_digests = sorted(catalogue(spark, known, digests).items())
    pairs = F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(i).alias("license")) for d, i in known_digests)).cast("array<struct<digest:string,license:string>>")
    table, by_digest = spark.range(1).select(F.inline(pairs)), F.map_from_entries(pairs)
    looked = docs.select(F.col(id_col).alias("doc_id"), let(lines_of(F.col(text_col)), lambda x: F.struct(digest(whole(x)).alias("digest"), found_lines(x, by_digest).alias("found"))).alias("at"))
    joined = looked.select("doc_id", F.col("at.digest").alias("digest"), F.col("at.found").alias("found")).join(F.broadcast(table), "digest", "left")  # a constant of the plan
    return joined.select("doc_id", "digest", "license", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))


def found_lines(lines: Column, by_digest: Column) -> Column:
    """Ids of the lines that are known as a whole."""
    own = F.filter(F.transform(lines, canonical), lambda x: x != "")
    return F.filter(F.transform(own, lambda x: F.try_element_at(by_digest, digest(x))), lambda x: x.isNotNull())


def oracle() -> str:
    """The same results as one DuckDB statement over table ``documents``."""
    q = lambda s: s.replace("'", "''")

    def canon(x: str) -> str:
        y = f"replace(regexp_replace(' ' || {x} || ' ', '{PUNCTUATION}', ' ', 'g'), ' ', '  ')"
        for a, b in SPELLINGS:
            y = f"replace({y}, '{spread(a)}', '{spread(b)}')"
        return f"trim(regexp_replace({y}, ' +', ' ', 'g'), ' ')"

    lines = f"list_filter(string_split(translate(coalesce(t, ''), '{UPPER}', '{LOWER}'), chr(10)), lambda x: NOT regexp_matches(x, '{COPYRIGHT}'))"
    values = ", ".join(f"('{i}', '{q(t)}')" for i, t in KNOWN)
    fixed = ", ".join(f"('{i}', '{d}')" for i, d in DIGESTS)
    return rf"""
WITH known AS (
  SELECT min(license) AS license, digest FROM (
    SELECT license, sha256({canon("array_to_string(" + lines + ", ' ')")}) AS digest FROM (VALUES {values}) AS v(license, t) UNION ALL FROM (VALUES {fixed}) AS w(license, digest)) GROUP BY digest
), d AS (SELECT row_number() OVER () AS k, doc_id, {lines} AS lines FROM (SELECT doc_id, text AS t FROM documents)),
n AS (
  SELECT k, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ids
  FROM (SELECT k, sha256(x) AS digest FROM (SELECT k, {canon("x")} AS x FROM (SELECT k, unnest(lines) AS x FROM d)) WHERE x <> '') JOIN known USING (digest) GROUP BY k
)
SELECT doc_id, digest, license, coalesce(n.n, 0) AS n_notices, coalesce(n.ids, '') AS notices
FROM (SELECT k, doc_id, sha256({canon("array_to_string(lines, ' ')")}) AS digest FROM d) LEFT JOIN known USING (digest) LEFT JOIN n USING (k)
"""
