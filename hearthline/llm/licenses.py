"""License scan: MinHash bands over overlapping windows find templates, exact containment confirms.

Texts and templates are words (runs of a-z and 0-9 in lower case; all else stands
between words) and their shingles of ``WORDS`` words.  A template with s shingles belongs to the class
c of the next power of two, and class c is looked for in windows of 2c shingles that begin
at every multiple of c, so every stretch of c shingles lies within a window.  A window that holds 80 % of
a template, at least 0.4 c shingles, has a similarity of 0.2 or more with it.  With ``BANDS`` bands of one
MinHash value, they collide in one with a probability of 1 - 0.8^64, over 0.999999.  A
collision takes a shingle that both have, so windows without a shingle of their class's
templates are not looked at.  A candidate is a match if ``SHARE`` percent or more of the template's
shingles are in the window.

One row is returned for each document and template found in it: the highest
containment in a window, the first word and the end of what matched, and the number of windows.

Only DataFrame functions are used.  Whole texts are scanned.  Null and empty texts,
and texts of fewer words than a shingle has, match nothing.  Rows without doc_id count as one document, and so
do rows with the same doc_id.  Other columns are not read.  Templates shorter than a shingle
cannot be found and are refused.  An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, written

WORDS = 5
BANDS = 64
SHARE = 80

# Notices and headers of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the"
    " MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except"
    " in compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"
    " distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY"
    " KIND, either express or implied. See the License for the specific language governing permissions and"
    " limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at"
    " your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
    " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
    " General Public License for more details. You should have received a copy of the GNU General Public License"
    " along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    " associated documentation files (the \"Software\"), to deal in the Software without restriction, including"
    " without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    " of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
    " conditions: The above copyright notice and this permission notice shall be included in all copies or substantial"
    " portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,"
    " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
    " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
    " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
    " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
    " hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE"
    " SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL"
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met: 1. Redistributions of source code must retain the above"
    " copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must"
    " reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy,"
    " modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled"
    " binary, for any purpose, commercial or non-commercial, and by any means.",
}


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def size_class(shingles: int) -> int:
    return 1 << (shingles - 1).bit_length()


def _shingles(text: Column) -> Column:
    """Hashes of all shingles, in order; null for fewer words than one has."""
    words = F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
    # One at a time through a generator-like step: the words are split once.
    return F.transform(
        F.array(words),
        lambda w: F.when(
            F.size(w) >= WORDS,
            F.transform(F.sequence(F.lit(1), F.size(w) - (WORDS - 1)), lambda i: F.xxhash64(F.slice(w, i, WORDS))),
        ),
    )[0]


def _signature(shingles: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))),
    )


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, class, shingles) of the templates."""
    rows = []
    for name, text in templates.items():
        words = template_words(text)
        if len(words) < WORDS:
            raise ValueError(f"template {name} has fewer than {WORDS} words")
        distinct = {tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)}
        rows.append((name, size_class(len(distinct)), " ".join(words)))
    made = spark.createDataFrame(rows, "license string, class int, text string")
    return made.select("license", "class", F.array_distinct(_shingles(F.col("text"))).alias("shingles"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, first_word, end_word, windows)."""
    known = template_table(docs.sparkSession, templates)
    by_class: dict[int, set[int]] = {}
    for r in known.collect():  # the templates, not the corpus
        by_class.setdefault(r["class"], set()).update(r["shingles"])
    every = sorted(set().union(*by_class.values()))

    # The generator keeps the optimizer from working out the shingles once for each use.
    hashed = docs.select("doc_id", F.explode(F.array(_shingles(F.col("text")))).alias("sh")).filter(
        F.col("sh").isNotNull()
    )
    hit = hashed.filter(F.exists("sh", lambda x: x.isin(every)))

    def starts(size: int) -> Column:
        """Windows of a class that hold a shingle of its templates."""
        own = sorted(by_class[size])
        places = F.filter(
            F.transform("sh", lambda x, i: F.when(x.isin(own), i)), lambda i: i.isNotNull()
        )
        window = F.flatten(
            F.transform(
                places,
                lambda i: F.array(F.floor(i / size), F.greatest(F.floor(i / size) - 1, F.lit(0))),
            )
        )
        return F.transform(
            F.array_distinct(window),
            lambda k: F.struct(F.lit(size).alias("class"), (k * size).cast("int").alias("start")),
        )

    placed = hit.select("doc_id", "sh", F.explode(F.flatten(F.array(*[starts(c) for c in sorted(by_class)]))).alias("w"))
    windows = written(
        placed.select(
            F.monotonically_increasing_id().alias("window"), "doc_id", "w.class", "w.start",
            F.slice("sh", F.col("w.start") + 1, 2 * F.col("w.class")).alias("part"),
        ),
        "license-windows",
    )

    def bands(of: DataFrame, name: str, shingles: str) -> DataFrame:
        return of.select(name, "class", F.posexplode(_signature(F.col(shingles))).alias("band", "value"))

    found = (
        bands(windows, "window", "part")
        .join(bands(known, "license", "shingles"), ["class", "band", "value"])
        .select("window", "license")
        .distinct()
    )
    both = windows.join(found, "window").join(known.select("license", "shingles"), "license")
    common = F.array_intersect("part", "shingles")
    where = F.filter(
        F.transform("part", lambda x, i: F.when(F.array_contains("shingles", x), i)), lambda i: i.isNotNull()
    )
    matched = both.select(
        "doc_id", "license", (F.size(common) / F.size("shingles")).alias("containment"),
        (100 * F.size(common) >= SHARE * F.size("shingles")).alias("enough"),
        (F.col("start") + F.array_min(where)).alias("first_word"),
        (F.col("start") + F.array_max(where) + WORDS).alias("end_word"),
    ).filter("enough")
    return matched.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"),
        F.min("first_word").alias("first_word"),
        F.max("end_word").alias("end_word"),
        F.count(F.lit(1)).alias("windows"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))


def sql(templates: dict[str, str] = TEMPLATES) -> str:
    """The same scan without MinHash: containment in every window that shares a shingle."""
    values = ", ".join(f"('{k}', '{' '.join(template_words(t))}')" for k, t in templates.items())
    return f"""
WITH given(license, text) AS (VALUES {values}),
split AS (SELECT license, string_split(text, ' ') AS w FROM given),
pieces AS (
    SELECT DISTINCT license, unnest(list_transform(range(1, len(w) - {WORDS - 2}),
        lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) AS g FROM split
), known AS (
    SELECT license, g, count(*) OVER (PARTITION BY license) AS n FROM pieces
), classed AS (
    SELECT *, (2 ** ceil(log2(n)))::BIGINT AS size FROM known
), worded AS (
    SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents
), placed AS (
    SELECT line, doc_id, unnest(range(0, len(w) - {WORDS - 1})) AS i,
           unnest(list_transform(range(1, len(w) - {WORDS - 2}),
               lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) AS g
    FROM worded WHERE len(w) >= {WORDS}
), hits AS (
    SELECT p.*, k.license, k.n, unnest([p.i // k.size, p.i // k.size - 1]) AS place
    FROM placed p JOIN classed k ON p.g = k.g
), windows AS (
    SELECT line, doc_id, license, n, place, count(DISTINCT g) AS c, min(i) AS a, max(i) AS b
    FROM hits WHERE place >= 0 GROUP BY ALL
)
SELECT doc_id, license, max(c::DOUBLE / n) AS containment, min(a)::INTEGER AS first_word,
       (max(b) + {WORDS})::INTEGER AS end_word, count(*) AS windows
FROM windows WHERE 100 * c >= {SHARE} * n GROUP BY doc_id, license
"""
