"""Licence scans: normalised text against templates by Dice coefficient over word bigrams, in DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

MIN_DICE = 0.8
#: Two bigrams of a template belong to one block if the second starts at most so many words after the first.
GAP = 6
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Templates (name, text), fixed values: public wordings of licences, headers, grants and notices.
TEMPLATES = (
    ("MIT", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"""),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT-notice", "Released under the MIT License."),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS.replace("OR COPYRIGHT HOLDERS ", "")}"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0-header", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
)
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(text: str) -> list[str]:
    w = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bounds(n: int, min_dice: float) -> tuple[int, int]:
    """Sizes that a block must have to reach min_dice against a template of n bigrams: 2 min(b, n) / (b + n) >= min_dice."""
    return math.ceil(n * min_dice / (2 - min_dice) - 1e-9), math.floor(n * (2 - min_dice) / min_dice + 1e-9)


def marks(grams: list[list[str]], min_dice: float) -> list[str]:
    """Words of which a block has one at least if it reaches min_dice against any template: too few of a template's bigrams are
    without them. Long words first, as the rarer; words that serve other templates already go before."""
    chosen: set[str] = set()
    for own in sorted(grams, key=lambda g: (len(g), g)):
        need = bounds(len(own), min_dice)[0]
        left = [g.split() for g in own if not chosen & set(g.split())]
        for word in sorted({w for g in left for w in g}, key=lambda w: (-len(w), w)):
            if len(left) < need:
                break
            chosen.add(word)
            left = [g for g in left if word not in g]
    return sorted(chosen)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, min_dice: float = MIN_DICE, gap: int = GAP) -> DataFrame:
    """(doc_id, n_blocks, licence, dice, licences) per row of docs (doc_id, text; other columns are not read).

    A text is normalised to words of a-z and 0-9, so line breaks, comment signs and quotes don't matter. For each template its
    candidate blocks are the runs of words in which bigrams of the template follow each other with gaps of at most `gap` words, wherever they
    stand in the text. A block is compared only if its number of distinct bigrams is within the template's size bounds. licence, dice: of
    the matches of min_dice or more the one with most bigrams in common, then the highest, ties by name; licences: all matching names, ordered, comma-joined; n_blocks: distinct blocks that match.
    Null, empty and unmatched texts have 0, null, null and ''; repeated rows are scanned each; no rows give no rows.
    A text without a word that every match would need (marks) is settled by one expression. Everything happens inside a row.
    """
    grams = {name: bigrams(text) for name, text in sorted(templates)}
    names, sets = F.array(*map(F.lit, grams)), F.array(*[F.array(*map(F.lit, own)) for own in grams.values()])
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOW)
    needed = rf"(?<![a-z0-9])(?:{'|'.join(marks(list(grams.values()), min_dice))})(?![a-z0-9])"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low"))
    rows = rows.select("doc_id", F.when(F.col("low").rlike(needed), F.filter(F.split("low", "[^a-z0-9]+"), lambda x: x != "")).otherwise(F.array().cast("array<string>")).alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    rows = rows.select("doc_id", F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda x, y: F.concat(x, F.lit(" "), y)).alias("g"))
    none = F.array().cast("array<int>")

    def places(own: list[str]) -> Column:
        hit = F.transform("g", lambda x, i: F.when(x.isin(own), i))
        return F.filter(hit, lambda i: i.isNotNull())

    hits = F.when(F.size("g") > 0, F.array(*[places(own) for own in grams.values()])).otherwise(F.array(*[none] * len(grams)))
    rows = rows.withColumn("hits", hits)

    def runs(h: Column) -> Column:
        some = lambda far: F.filter(F.transform(h, lambda x, k: F.when(F.coalesce(far(x, k), F.lit(True)), x)), lambda x: x.isNotNull())
        firsts, lasts = some(lambda x, k: x - F.get(h, k - 1) > gap), some(lambda x, k: F.get(h, k + 1) - x > gap)
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def matches(h: Column, t: Column) -> Column:
        own, name = F.get(sets, t), F.get(names, t)
        size, other = F.lit(1.0) * F.size(own), 2 - min_dice
        least, most = F.ceil(size * F.lit(min_dice / other) - 1e-9), F.floor(size * F.lit(other / min_dice) + 1e-9)

        def one(r: Column) -> Column:
            block = F.array_distinct(F.slice(F.col("g"), r["a"] + 1, r["b"] - r["a"] + 1))
            common = F.size(F.array_intersect(block, own))
            dice = (2 * common).cast("double") / (F.size(block) + F.size(own)).cast("double")
            fits = (r["b"] - r["a"] + 1 >= least) & F.size(block).between(least, most) & (dice >= min_dice)
            return F.when(fits, F.struct((-common).alias("c"), (-dice).alias("d"), name.alias("name"), r["a"].alias("a"), r["b"].alias("b")))

        return F.filter(F.transform(runs(h), one), lambda x: x.isNotNull())

    rows = rows.select("doc_id", F.flatten(F.transform("hits", matches)).alias("found"))
    found = F.col("found")
    best = F.array_min(found)
    listed = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["name"])))
    blocks = F.size(F.array_distinct(F.transform(found, lambda x: x["a"].cast("long") * (1 << 31) + x["b"])))
    return rows.select("doc_id", blocks.cast("long").alias("n_blocks"), best["name"].alias("licence"), (-best["d"]).alias("dice"), F.array_join(listed, ",").alias("licences"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of all documents against TEMPLATES."""
    return scan(table(spark, sf_dir, "documents"))


_VALUES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)

OP7_SQL = rf"""
WITH t0(name, text) AS (VALUES {_VALUES}),
t1 AS (SELECT name, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t0),
t2 AS (SELECT DISTINCT name, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t1),
t3 AS (SELECT name, count(*) AS n FROM t2 GROUP BY name),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM d WHERE len(w) > 1),
h AS (SELECT r, name, i, CASE WHEN i - lag(i) OVER (PARTITION BY r, name ORDER BY i) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM g JOIN t2 USING (gram)),
k AS (SELECT r, name, i, sum(fresh) OVER (PARTITION BY r, name ORDER BY i) AS run FROM h),
b AS (SELECT r, name, min(i) AS a, max(i) AS z FROM k GROUP BY r, name, run HAVING count(*) > 1),
p AS (SELECT b.r, b.name, a, z, any_value(n) AS n, count(DISTINCT g.gram) AS size, count(DISTINCT t2.gram) AS common
      FROM b JOIN t3 ON b.name = t3.name JOIN g ON g.r = b.r AND g.i BETWEEN a AND z LEFT JOIN t2 ON t2.name = b.name AND t2.gram = g.gram
      GROUP BY b.r, b.name, a, z),
m AS (SELECT *, CAST(2 * common AS DOUBLE) / CAST(size + n AS DOUBLE) AS dice FROM p),
x AS (SELECT r, count(DISTINCT (a, z)) AS n_blocks, string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM m WHERE dice >= {MIN_DICE} GROUP BY r),
f AS (SELECT r, name AS licence, dice FROM m WHERE dice >= {MIN_DICE} QUALIFY row_number() OVER (PARTITION BY r ORDER BY common DESC, dice DESC, name) = 1)
SELECT doc_id, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks, licence, dice, coalesce(licences, '') AS licences
FROM d LEFT JOIN x ON d.r = x.r LEFT JOIN f ON d.r = f.r
"""
