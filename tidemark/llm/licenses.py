"""License scans: TF-IDF cosine of headers and licence files to templates, and inheritance along paths.

DataFrame functions only.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .ranking import BROADCAST_ROWS

# Customary notices, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
# Identifiers of the texts in a folder of licence texts, by file name.
TEXT_NAMES = {
    "Apache-2.0": "Apache-2.0",
    "Artistic": "Artistic-1.0-Perl",
    "BSD": "BSD-3-Clause",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3",
    "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Templates of so many words at most are looked for as headers, anywhere; longer ones are compared with whole texts.
HEADER_WORDS = 400
THRESHOLD = 0.75
FILE_NAME = "(?i)^(un)?licen[sc]e|^copying|^notice"
#: Headers, and whole texts, of so many words at most that say this are no notices.
NEGATED, NEGATED_WORDS = r"(^| )not ([a-z0-9.-]+ ){0,2}(licensed|released|dedicated|distributed|covered)( |$)", 64
#: What ends a line of a header, besides a line's end.
SENTENCE = r"([.!?])[ \t]+"


def templates(folder: str | None = None) -> dict[str, list[str]]:
    """The notices of TEMPLATES, and the full texts that ``folder`` has under the names of TEXT_NAMES."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for file, name in TEXT_NAMES.items():
        path = Path(folder or "") / file
        if folder and path.is_file():
            out.setdefault(name, []).append(path.read_text("utf-8", "replace"))
    return out


def template_terms(templates: dict[str, list[str]]) -> list[tuple[str, int, Counter]]:
    return [(name, i, Counter(re.findall(TERM, text.lower()))) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]


def weight(count: int, idf: float) -> float:
    return (1 + log(count)) * idf


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def frequencies(df: DataFrame, text: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """All rows, and for each term of the vocabulary the rows whose whole text has it; the driver gets as many numbers as there are terms."""
    known = F.array(*[F.lit(t) for t in vocabulary])
    has = df.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(_terms(F.coalesce(F.col(text), F.lit(""))), known))).alias("term"))
    found = {r.term: r["count"] for r in has.groupBy("term").count().collect()}
    return found.pop("", 0), found


def vectors(parsed: list[tuple[str, int, Counter]], idf: dict[str, float]) -> list[dict[str, float]]:
    """The templates' weights, of length 1."""
    out = []
    for _, _, counts in parsed:
        weights = {t: weight(n, idf[t]) for t, n in counts.items()}
        norm = sqrt(sum(w * w for w in weights.values()))
        out.append({t: w / norm for t, w in weights.items()})
    return out


def anchors(unit: dict[str, float], threshold: float) -> set[str]:
    """Terms of which any text as close to a template as ``threshold`` has one: the heaviest, until what the others weigh together is less."""
    out, rest = set(), 1.0
    for t, w in sorted(unit.items(), key=lambda x: (-x[1], x[0])):
        if rest < threshold * threshold:
            break
        out.add(t)
        rest -= w * w
    return out


def notices(df: DataFrame, key: str, text: str, templates: dict[str, list[str]], threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``license``, ``score`` and ``whole`` of the texts that are, or have a header, as close to a template as ``threshold``."""
    spark = df.sparkSession
    parsed = template_terms(templates)
    vocabulary = sorted({t for _, _, c in parsed for t in c})
    rows, found = frequencies(df, text, vocabulary)
    idf = {t: log((1 + rows) / (1 + found.get(t, 0))) + 1 for t in vocabulary}
    units, sizes = vectors(parsed, idf), [sum(c.values()) for _, _, c in parsed]
    table = [(t, name, i, n if n <= HEADER_WORDS else 0, w) for (name, i, _), unit, n in zip(parsed, units, sizes) for t, w in unit.items()]
    # both have as many rows as the templates have terms
    of = lambda rows, names: F.broadcast(spark.createDataFrame(pa.table([pa.array(c) for c in zip(*rows)], names=names)))
    model = of(table, ["term", "license", "template", "words", "u"])
    idfs = of(list(idf.items()), ["term", "idf"])
    some = lambda terms: F.array(*[F.lit(t) for t in sorted(terms)])
    any_, head = some(set().union(*(anchors(u, threshold) for u in units))), some(set().union(*(anchors(u, threshold) for u, n in zip(units, sizes) if n <= HEADER_WORDS)))

    own = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    near = own.withColumn("terms", _terms(F.col("text"))).where(F.arrays_overlap("terms", any_)).withColumn("h", F.xxhash64("text")).dropDuplicates(["key", "h"])
    lines = near.select("key", "h", F.transform(F.split(F.regexp_replace("text", SENTENCE, "$1\n"), "\n"), _terms).alias("lines"))
    starts = F.transform("lines", lambda x: F.arrays_overlap(x, head))
    lines = lines.withColumn("hit", starts)
    at = lines.select("key", "h", "lines", F.explode(F.expr("filter(sequence(0, size(lines) - 1), i -> hit[i] or (i + 1 < size(lines) and hit[i + 1]))")).alias("at"))
    lengths = F.array(*[F.lit(n) for n in sorted({n for n in sizes if n <= HEADER_WORDS})])
    headers = at.select("key", "h", "lines", "at", F.explode(lengths).alias("long"))
    headers = headers.select("key", "h", "at", "long", F.expr("slice(flatten(slice(lines, at + 1, 2 * long)), 1, long)").alias("terms"))
    parts = near.select("key", "h", F.lit(-1).alias("at"), F.lit(0).alias("long"), "terms").union(headers)
    parts = parts.where((F.size("terms") > NEGATED_WORDS) | ~F.array_join("terms", " ").rlike(NEGATED))
    part = ["key", "h", "at", "long"]
    counted = parts.select(*part, F.explode("terms").alias("term")).groupBy(*part, "term").agg(F.count(F.lit(1)).alias("n"))
    unknown = F.lit(log(1 + rows) + 1)  # a word that no template has weighs as much as one that no document has
    weighed = checkpointed(counted.join(idfs, "term", "left").select(*part, "term", ((1 + F.log("n")) * F.coalesce("idf", unknown)).alias("w")))
    norms = weighed.groupBy(*part).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(model, "term").where((F.col("at") == -1) | (F.col("long") == F.col("words"))).groupBy(*part, "license", "template").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    same = F.col("d.key").eqNullSafe(F.col("n.key"))
    for c in part[1:]:
        same = same & (F.col(f"d.{c}") == F.col(f"n.{c}"))
    scored = dots.alias("d").join(norms.alias("n"), same).select(F.col("d.key").alias("key"), F.col("d.at").alias("at"), "license", F.round(F.least(F.lit(1.0), F.col("dot") / F.col("norm")), 6).alias("score"))
    # whole texts come before headers
    best = scored.where(F.col("score") >= threshold).groupBy("key").agg(F.min(F.struct((F.col("at") >= 0).alias("header"), (-F.col("score")).alias("score"), "license")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("b.license").alias("license"), (-F.col("b.score")).alias("score"), (~F.col("b.header")).alias("whole"))


def license_scan(df: DataFrame, key: str, path: str, text: str, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``path``, ``license``, ``score``, ``via`` and ``from_dir`` for every row of ``df``.

    Whole texts are compared with all templates by the cosine of their terms,
    each weighed by (1 + ln n) times its inverse document frequency over all
    rows; a term that no template has weighs as one that no row has.  So are
    headers: for each template of at most HEADER_WORDS words, as many words
    from the beginning of a line or sentence on that has an anchor term, or
    comes before one, anywhere in the text.  Anchor terms are found so that a
    text without any can't reach the threshold.  What says that it is *not*
    licensed, released and so on is no notice, up to NEGATED_WORDS words.

    From ``threshold`` on, the best template's license (whole texts first;
    ties: the first by name) is the row's own: ``via`` is ``file`` if the row is
    a licence file, as a whole or by its name, else ``header``.  A row without
    its own license inherits that of the nearest directory on its path, its own
    included, that has a licence file (of several the best score, then the
    first license): ``via`` is ``inherited`` and ``from_dir`` says from where.
    Others have null in all four.

    A null or empty text has no license of its own; a null path has no
    directory, so it neither gives nor inherits.  Rows of one key share what is
    found for any of them.  An empty table gives no rows.
    """
    found = notices(df.select(key, text), key, text, templates, threshold)
    rows = df.select(F.col(key).alias("key"), F.col(path).alias("path"))
    name, folder = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_replace("path", "/?[^/]*$", "")
    own = rows.alias("r").join(found.select(F.col(key).alias("k"), "license", "score", "whole").alias("f"), F.col("r.key").eqNullSafe(F.col("f.k")), "left").drop("k")
    is_file = F.col("license").isNotNull() & (name.rlike(FILE_NAME) | F.col("whole"))
    own = checkpointed(own.select("key", "path", folder.alias("dir"), "license", "score", F.coalesce(is_file, F.lit(False)).alias("file")))
    given = own.where(F.col("file") & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("g"))
    open_ = own.where(F.col("license").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    above = F.expr("transform(sequence(0, size(split(dir, '/'))), i -> array_join(slice(split(dir, '/'), 1, i), '/'))")
    steps = open_.select("dir", F.posexplode(above).alias("depth", "above"))
    nearest = steps.join(given.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", F.col("g.license").alias("license"), (-F.col("g.score")).alias("score"))).alias("near"))
    nearest = checkpointed(nearest)
    if nearest.count() <= BROADCAST_ROWS:
        nearest = F.broadcast(nearest)
    joined = own.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return joined.select(
        F.col("key").alias(key),
        F.col("path").alias(path),
        F.coalesce("license", "near.license").alias("license"),
        F.when(mine, F.col("score")).otherwise(F.col("near.score")).alias("score"),
        F.when(mine & F.col("file"), "file").when(mine, "header").when(F.col("near").isNotNull(), "inherited").alias("via"),
        F.when(~mine, F.col("near.above")).alias("from_dir"),
    )
