"""Licence scans: MinHash bands over text windows retrieve templates, exact shingle containment verifies.

With DataFrame functions only.  Texts become lower-case words; a template is
found where a window of words holds at least ``CONTAINMENT`` of its distinct
five-word shingles.

1. Each template has a scale: windows of the least power of two that is twice
   its words or more, one starting every half window.  A passage as long as the
   template then lies whole in some window, and no window is over four times as
   long.
2. Shingles that no template of a scale has can't add to a containment there;
   windows are kept without them, by a test against the templates' own hashes.
3. A window's MinHash signature has a value for each band; windows and templates
   of a scale that agree in a band are retrieved.  A window that holds
   ``CONTAINMENT`` of a template has a Jaccard similarity j to it of at least
   what it would have were all the window's other shingles those of other
   templates, and is missed with probability (1 - j)**bands.  The bands of a
   scale are as many as make that ``MISSED`` at most for each of its templates.
4. Only retrieved pairs are verified, by the exact containment of shingles as
   texts.

Whole texts of long licences can be given as ``templates`` (``read_templates``
reads a folder of them), of at most ``WORDS`` words together: the list is sent
to every task.

Defined results.  A null, empty or licence-free text has an empty list.  Every
row gives a row and is scanned by itself: rows that share an id, or have none,
don't share matches.  Templates that match are all listed, by name; one of fewer
than five words is never found.  Without templates, or on an empty table,
nothing is found.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, plain

SHINGLE = 5
CONTAINMENT = 0.8
#: Probability that a window which holds a template is not retrieved.
MISSED = 1e-6
#: Words of all templates together, at most.
WORDS = 2_000_000

# fixed values: notices of public licences, by SPDX identifier
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# fixed values: whole texts of short public licences, by SPDX identifier
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_MIT_END = """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TEMPLATES |= {
    "0BSD-text": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause-text": f"{_BSD_HEAD}\n{_BSD_END}",
    "BSD-3-Clause-text": f"{_BSD_HEAD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_END}",
    "BSL-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC-text": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "MIT-text": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS} {_MIT_END}""",
    "Unlicense-text": f"""This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
{_AS_IS} IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _split(text: str) -> list[str]:
    """The same words of a template, on the driver."""
    return re.findall(r"[^\W_]+", text.lower())


def scale_of(n_words: int) -> int:
    """Words in the windows of a template's scale."""
    return 1 << (2 * n_words - 1).bit_length()


def similarity_bound(shingles: int, window: int) -> float:
    """The least Jaccard similarity of a template of so many shingles to a window that holds ``CONTAINMENT`` of them, whatever else it holds."""
    held = math.ceil(CONTAINMENT * shingles - 1e-9)
    most = max(window - SHINGLE + 1, held)
    return held / (most + shingles - held)


def bands_of(sizes: list[tuple[int, int]]) -> dict[int, int]:
    """Bands of each scale for templates of (words, distinct shingles)."""
    out: dict[int, int] = {}
    for n_words, shingles in sizes:
        j = similarity_bound(shingles, w := scale_of(n_words))
        out[w] = max(out.get(w, 1), 1 if j >= 1 else math.ceil(math.log(MISSED) / math.log(1 - j)))
    return out


def collision(similarity: float, bands: int) -> float:
    """Probability that one band of so many agrees at this similarity."""
    return 1 - (1 - similarity) ** bands


def _shingle_hash(w: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])


def _text_of(w: Column, at: Column) -> Column:
    return F.concat_ws(" ", *[F.get(w, at + k) for k in range(SHINGLE)])


def _hits(w: Column, known: list[int]) -> Column:
    """(at, h, s) of the shingles whose hash is known."""
    at = F.sequence(F.lit(0), F.size(w) - SHINGLE)
    found = F.filter(F.transform(at, lambda i: F.struct(i.alias("at"), _shingle_hash(w, i).alias("h"))), lambda x: x["h"].isin(known))
    with_text = F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), _text_of(w, x["at"]).alias("s")))
    return F.when(F.size(w) >= SHINGLE, with_text).otherwise(F.array().cast("array<struct<at:int,h:bigint,s:string>>"))


def _signature(hashes: Column, bands: Column) -> Column:
    """A value for each band: the least of the hashes under the band's function."""
    return F.transform(F.sequence(F.lit(1), bands), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Licence texts of a folder, by file name; the folder holds at most ``WORDS`` words."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), "value").collect()
    return {r["name"]: r["value"] for r in rows}


def _templates(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, dict[int, int]]:
    """template, scale, h (array), s (array): the distinct shingles of each, and the bands of each scale."""
    split = {name: _split(text) for name, text in templates.items()}
    if sum(map(len, split.values())) > WORDS:
        raise ValueError(f"templates of over {WORDS} words")
    split = {name: w for name, w in split.items() if len(w) >= SHINGLE}
    bands = bands_of([(len(w), len({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})) for w in split.values()])
    df = spark.createDataFrame([(name, scale_of(len(w)), w) for name, w in split.items()], "template string, scale int, w array<string>")
    at = F.sequence(F.lit(0), F.size("w") - SHINGLE)
    hashes, texts = F.transform(at, lambda i: _shingle_hash(F.col("w"), i)), F.transform(at, lambda i: _text_of(F.col("w"), i))
    return df.select("template", "scale", F.array_distinct(hashes).alias("th"), F.array_distinct(texts).alias("ts")), bands


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """row, doc_id of every row, and row, template, scale, window, containment of every verified match."""
    spark = docs.sparkSession
    given, bands = _templates(spark, TEMPLATES if templates is None else templates)
    given = spark.createDataFrame(given.collect(), given.schema)  # hashed once; at most WORDS words
    known = sorted({h for r in given.collect() for h in r["th"]})
    base = plain(docs, "doc_id", "text").withColumn("w", words(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(base.select("row", "doc_id", _hits(F.col("w"), known).alias("hits")), "licence-rows")
    found = rows.select("row", F.explode("hits").alias("x")).select("row", "x.*")
    of_scale = F.broadcast(given.select("scale", F.explode("th").alias("h")).distinct())
    half = F.col("scale") / 2
    last = F.floor(F.col("at") / half)
    inside = lambda v: (v >= 0) & (F.col("at") >= v * half) & (F.col("at") + SHINGLE <= v * half + F.col("scale"))
    placed = found.join(of_scale, "h").select("row", "scale", "h", "s", F.explode(F.filter(F.array(last, last - 1), inside)).alias("window"))
    windows = materialise(placed.groupBy("row", "scale", "window").agg(F.collect_set("h").alias("h"), F.collect_set("s").alias("s")), "licence-windows")
    n = F.element_at(F.create_map(*[F.lit(x) for kv in (bands or {0: 1}).items() for x in kv]), F.col("scale").cast("int"))
    banded = windows.select("row", "scale", "window", F.posexplode(_signature(F.col("h"), n)).alias("band", "value"))
    asked = F.broadcast(given.select("template", "scale", F.posexplode(_signature(F.col("th"), n)).alias("band", "value")))
    retrieved = banded.join(asked, ["scale", "band", "value"]).select("row", "scale", "window", "template").distinct()
    texts = F.broadcast(given.select("template", "ts"))
    held = F.size(F.array_intersect("s", "ts")) / F.size("ts")
    verified = retrieved.join(windows.select("row", "scale", "window", "s"), ["row", "scale", "window"]).join(texts, "template").withColumn("containment", held)
    return rows.select("row", "doc_id"), verified.where(F.col("containment") >= CONTAINMENT).select("row", "template", "scale", "window", "containment")


def licences(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, licences (sorted names), n_licences, containment (the best; 0 without any): a row for every row."""
    rows, found = scan(docs, templates)
    best = found.groupBy("row").agg(F.array_sort(F.collect_set("template")).alias("l"), F.max("containment").alias("c"))
    names = F.coalesce(F.array_join("l", ","), F.lit(""))
    return rows.join(best, "row", "left").select("doc_id", names.alias("licences"), F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_licences"), F.coalesce("c", F.lit(0.0)).alias("containment"))


def oracle_sql(templates: dict[str, str] | None = None) -> str:
    """DuckDB SQL for ``licences``: every window against every template of its scale, without MinHash."""
    listed = TEMPLATES if templates is None else templates
    rows = ", ".join("('{}', {}, '{}')".format(n, scale_of(len(_split(t))), t.replace("'", "''")) for n, t in listed.items())
    cut = lambda text: f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+')"
    shingle = lambda i: "concat_ws(' ', " + ", ".join(f"w[{i} + {k}]" for k in range(SHINGLE)) + ")"
    return f"""
        WITH t AS (SELECT name, scale, {cut("body")} AS w FROM (VALUES {rows}) v(name, scale, body)),
        ts AS (SELECT DISTINCT name, scale, {shingle("i")} AS s FROM (SELECT name, scale, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM t)),
        sizes AS (SELECT name, count(*) AS size FROM ts GROUP BY name),
        d AS (SELECT doc_id, {cut("text")} AS w FROM documents),
        ds AS (SELECT doc_id, i - 1 AS pos, {shingle("i")} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)),
        hits AS (SELECT doc_id, pos, s, scale, pos // (scale // 2) - back AS win FROM ds JOIN (SELECT DISTINCT s, scale FROM ts) USING (s), (VALUES (0), (1)) b(back)),
        places AS (SELECT * FROM hits WHERE win >= 0 AND pos + {SHINGLE} <= win * (scale // 2) + scale),
        held AS (SELECT doc_id, scale, win, name, count(DISTINCT s) AS n FROM places JOIN ts USING (s, scale) GROUP BY ALL),
        found AS (SELECT doc_id, name, n / size AS c FROM held JOIN sizes USING (name) WHERE n / size >= {CONTAINMENT}),
        best AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS l, count(DISTINCT name) AS k, max(c) AS c FROM found GROUP BY doc_id)
        SELECT doc_id, coalesce(l, '') AS licences, coalesce(k, 0)::BIGINT AS n_licences, coalesce(best.c, 0.0)::DOUBLE AS containment
        FROM documents LEFT JOIN best USING (doc_id)
    """
