"""License scans: MinHash bands over overlapping text windows, then exact containment.

Everything runs as DataFrame expressions inside the JVM.

* Templates are cut into segments (a short template is one).  Segments of a length share a
  class of text windows, somewhat wider than the segment and so dense that every occurrence
  lies whole in one window.
* An exact screen keeps the texts that hold an anchor word of some template: words that are in
  more of its shingles than a match may miss.  Segments have anchors too, and windows are laid
  around those only.
* Each window's shingles get a MinHash signature with bands of one row; the number of bands
  is chosen so that a window with a match collides with a chance of at least ``SURE``.
* A band hit of any segment makes the text a candidate for its template.  Candidates are
  verified by exact containment of the whole template's shingles in the whole text.

However a text's misses are spread, a segment keeps at least its share of the rest, which
bounds what a segment may miss.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize

SHINGLE = 5
PERCENT = 80
SURE = 0.9999
_LONG, _STEP = 24, 8

#: License notices and the whole texts of short licenses, without their
#: copyright lines.
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "all-rights-reserved": "All rights reserved.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    size = min(SHINGLE, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _may_miss(grams: set) -> int:
    return len(grams) - -(-PERCENT * len(grams) // 100)


def anchors(grams: set[tuple[str, ...]], may_miss: int) -> list[str]:
    """Words of which a match holds at least one: long ones first, until more shingles hold
    one than a match may miss."""
    out: list[str] = []
    for word in sorted({w for g in grams for w in g}, key=lambda w: (-len(w), w)):
        out.append(word)
        if sum(any(a in g for a in out) for g in grams) > may_miss:
            break
    return out


class Segment:
    """A template's segment and the shape of the windows that look for it."""

    def __init__(self, template: str, number: int, words: list[str], may_miss: int | None = None):
        self.template, self.number, self.words = template, number, words
        self.size = min(SHINGLE, len(words))
        slack = len(words) // 4 if len(words) > SHINGLE + 2 else 0
        self.width, self.step = len(words) + slack, slack + 1
        grams = self.grams = _grams(words)
        may_miss = _may_miss(grams) if may_miss is None else may_miss
        self.anchors = anchors(grams, may_miss)
        # least Jaccard similarity of a window with a match
        least = len(grams) - may_miss
        self.similarity = least / (self.width - self.size + 1 + len(grams) - least)

    @property
    def bands(self) -> int:
        return max(4, math.ceil(math.log(1 - SURE) / math.log(max(1e-9, 1 - self.similarity)))) if self.similarity < 1 else 4


def segments(templates: dict[str, str]) -> list[Segment]:
    out = []
    for name, text in sorted(templates.items()):
        words = words_of(text)
        if len(words) <= _LONG:
            out += [Segment(name, 0, words)] if words else []
            continue
        size = 2 * _STEP
        starts = sorted({*range(0, len(words) - size + 1, _STEP), len(words) - size})
        parts = [words[a : a + size] for a in starts]
        # of a text's misses, wherever they are, some segment has no more than the average
        cover = Counter(g for part in parts for g in _grams(part))
        most = sum(n for _, n in cover.most_common(_may_miss(_grams(words)))) // len(parts)
        out += [Segment(name, k, part, most) for k, part in enumerate(parts)]
    return out


def _shingles(words: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " "))))


def _signature(grams: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(grams, lambda g: F.xxhash64(g, b))))


def _template_rows(spark: SparkSession, found: list[Segment]) -> DataFrame:
    """One row per segment; as many rows as the fixed templates have segments."""
    rows = [
        F.struct(
            F.lit(s.template).alias("license"), F.lit(s.number).alias("segment"), F.lit(s.width).alias("width"), F.lit(s.step).alias("step"),
            F.lit(s.size).alias("size"), F.array(*[F.lit(w) for w in s.words]).alias("words"),
        ) for s in found
    ]
    flat = spark.range(1).select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    grams = F.transform(F.array(_shingles(F.col("words"), F.col("size"))), lambda g: F.struct(g.alias("grams")))
    return flat.select("license", "segment", "width", "size", F.inline(grams))


def scan(docs: DataFrame, *, doc_id="doc_id", text="text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document and license found in it.

    Columns: doc_id, license, containment (share of the template's shingles that the
    document holds, at least 0.8), first_word (place of the first of them).  Rows that repeat id and text give one result; null, empty and clean
    texts give none, and without templates there are no rows.
    """
    spark = docs.sparkSession
    found = segments(TEMPLATES if templates is None else templates)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("t"), F.xxhash64(text).alias("h"))
    if not found:
        return slim.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word")).where("false")
    wanted = {name: words for name, template in (TEMPLATES if templates is None else templates).items() if (words := words_of(template))}
    marks = sorted({a for s in found for a in s.anchors})
    screen = {a for words in wanted.values() for a in anchors(_grams(words), _may_miss(_grams(words)))}
    bands = max(s.bands for s in found)
    # the lower-cased text is a lambda's variable, so that it is made once for all anchors
    def any_anchor(t: Column) -> Column:
        hit = F.lit(False)
        for a in sorted(screen, key=lambda a: (len(a), a), reverse=True):
            hit = hit | F.contains(t, F.lit(a))
        return hit

    screened = slim.where(F.get(F.transform(F.array("t"), any_anchor), 0))
    tokens = screened.select("doc_id", "h", F.regexp_extract_all("t", F.lit(_WORD), F.lit(0)).alias("words")).distinct()
    tokens = materialize(tokens, "license-texts")
    # the words around each anchor word; exploding at each step keeps expressions apart, or
    # the optimizer would write one into the other many times over
    reach = max(s.width for s in found)
    marked = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(F.array(*[F.lit(a) for a in marks]), F.get("words", i)))
    around = F.transform(marked, lambda p: F.struct(p.alias("p"), F.greatest(p - reach, F.lit(0)).alias("base"), F.slice("words", F.greatest(p - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near")))
    spots = tokens.where(F.size("words") > 0).select("doc_id", "h", F.inline(around))
    # windows of every class that hold the anchor word, on the class's grid
    shapes = [F.struct(F.lit(w).alias("width"), F.lit(t).alias("step"), F.lit(z).alias("size")) for w, t, z in sorted({(s.width, s.step, s.size) for s in found})]
    classed = spots.select("*", F.inline(F.array(*shapes)))
    grid = F.sequence(F.ceil(F.greatest(F.col("p") - F.col("width") + 1, F.lit(0)) / F.col("step")).cast("int"), F.floor(F.col("p") / F.col("step")).cast("int"))
    placed = classed.select("*", F.explode(grid).alias("g")).select("doc_id", "h", "width", "size", (F.col("g") * F.col("step")).alias("start"), F.slice("near", F.col("g") * F.col("step") - F.col("base") + 1, F.col("width")).alias("w"))
    windows = placed.where(F.size("w") >= F.col("size")).groupBy("doc_id", "h", "width", "size", "start").agg(F.first("w").alias("w"))
    signed = F.transform(F.array(_shingles(F.col("w"), F.col("size"))), lambda g: F.struct(g.alias("grams"), _signature(g, bands).alias("sig")))
    hashed = windows.select("doc_id", "h", "width", "size", "start", F.inline(signed))
    table = _template_rows(spark, found)
    sides = table.withColumn("sig", _signature(F.col("grams"), bands)).select("license", "segment", "width", "size", F.col("grams").alias("own"), F.posexplode("sig").alias("band", "value"))
    # a window meets a segment once for each band they share
    rows = hashed.select("doc_id", "h", "start", "width", "size", "grams", F.posexplode("sig").alias("band", "value"))
    met = rows.join(F.broadcast(sides), ["width", "size", "band", "value"])
    candidates = met.select("doc_id", "h", "license").distinct()
    wholes = _template_rows(spark, [Segment(name, 0, words) for name, words in sorted(wanted.items())])
    wholes = wholes.select("license", F.col("size").alias("n"), F.col("grams").alias("own"))
    # the text's shingles that the template has, and the place of the first of them
    asked = candidates.join(tokens.withColumnsRenamed({"doc_id": "_id", "h": "_h"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).join(F.broadcast(wholes), "license")
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.xxhash64(F.array_join(F.slice("words", i, F.col("n")), " ")))
    asked = asked.where(F.size("words") >= F.col("n")).select("doc_id", "license", "own", F.explode(F.array(grams)).alias("all"))
    held = asked.select("doc_id", "license", "own", "all", F.explode(F.array(F.array_intersect("all", "own"))).alias("hit")).where(100 * F.size("hit") >= PERCENT * F.size("own"))
    first = F.array_position(F.transform("all", lambda g: F.array_contains("own", g)), True) - 1
    return held.select("doc_id", "license", (F.size("hit") / F.size("own")).alias("containment"), first.alias("first_word"))
