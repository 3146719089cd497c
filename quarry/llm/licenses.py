"""Licence scan: windows of words against templates by Dice coefficient over word bigrams (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, texts

# Well-known licence statements, file headers, and the texts of the short licences. The long ones (Apache,
# GPL, MPL, CC) are known by statements and headers; Apache and GPL texts end with the header as an example.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
DICE = 0.8


def _words(line):
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(words):
    pair = lambda i: F.concat_ws(" ", F.try_element_at(words, i - 1), F.try_element_at(words, i))
    return F.array_distinct(F.transform(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), pair))


def anchors(bodies: list[list[str]], dice: float) -> list[str]:
    """Words of which each admissible window has one. A match shares at least dice / (2 - dice) of a template's bigrams, so
    words, the longest first, are taken until the bigrams without any of them are fewer than that."""
    out: set[str] = set()
    for words in bodies:
        pairs = {*zip(words, words[1:])}
        own = {w for w in words if w in out}
        for w in sorted({*words}, key=lambda w: (-len(w), w)):
            if sum(own.isdisjoint(p) for p in pairs) < dice / (2 - dice) * len(pairs):
                break
            own.add(w)
        out |= own
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str | list[str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """doc_id, license, line_no, dice: every window of words, across lines and within them, that is at least dice like a
    template; of windows that overlap the one most alike, the first of equals. line_no is the line it begins on.

    Lower-cased words of letters and digits; distinct word bigrams, of a window at most (2 - dice) / dice as many, with
    repeats, as the template has. The windows most alike begin and end with bigrams of the template, so only those are
    compared. Null and empty texts give no rows; a document has a row for each place and each template. Templates are a
    parameter of a few KB, so they are broadcast.
    """
    spark = docs.sparkSession
    each = [(k, b) for k, v in templates.items() for b in ([v] if isinstance(v, str) else v)]
    known = spark.createDataFrame(each, "license string, body string").withColumn("tw", _words(F.col("body"))).withColumn("tb", _bigrams(F.col("tw")))
    some = "|".join(anchors([r.tw for r in known.select("tw").collect()], dice))
    m = F.size("tb")
    near = F.broadcast(known.select("license", "tb", F.ceil(m * F.lit(dice / (2 - dice)) - 1e-9).cast("int").alias("need"), F.floor(m * F.lit((2 - dice) / dice) + 1e-9).cast("int").alias("most")))
    # explode keeps each expression evaluated once
    once = lambda name, value: F.explode(F.array(value)).alias(name)
    words = texts(docs).where(F.lower("text").rlike(some)).select("doc_id", "text", once("w", _words(F.col("text")))).where(F.size("w") >= 2)
    pairs = words.select("doc_id", "text", once("b", F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda x, y: F.concat_ws(" ", x, y))))
    met = pairs.join(near, F.size(F.array_intersect("b", "tb")) >= F.col("need"))
    hits = met.select("*", once("hits", F.filter(F.sequence(F.lit(1), F.size("b")), lambda i: F.array_contains(F.col("tb"), F.element_at("b", i)))))

    def ends(i, x):
        """Windows from hit x on, with as many hits as a match needs."""
        to = F.transform(F.slice("hits", x + 1, F.col("most")), lambda j, y: F.struct(i.alias("i"), j.alias("j"), (y + 1).alias("h")))
        return F.filter(to, lambda p: (p["h"] >= F.col("need")) & (p["j"] - i < F.col("most")))

    def alike(p):
        part = F.slice("b", p["i"], p["j"] - p["i"] + 1)
        return F.struct((-2 * F.size(F.array_intersect(part, F.col("tb"))) / (F.size(F.array_distinct(part)) + m)).alias("o"), p["i"].alias("i"), p["j"].alias("j"))

    found = hits.select("*", once("windows", F.array_sort(F.filter(F.transform(F.flatten(F.transform("hits", ends)), alike), lambda x: x["o"] <= -dice))))
    # a window of j bigrams has a word more, which the next may not begin with
    apart = F.aggregate("windows", F.slice("windows", 1, 0), lambda got, x: F.when(F.exists(got, lambda g: (g["i"] <= x["j"] + 1) & (x["i"] <= g["j"] + 1)), got).otherwise(F.array_append(got, x)))
    rows = found.where(F.size("windows") > 0).select("license", "doc_id", "text", F.explode(apart).alias("x"))
    line = F.flatten(F.transform(F.split("text", r"\n"), lambda t, k: F.array_repeat(k, F.size(_words(t)))))
    return rows.select("doc_id", "license", F.element_at(line, F.col("x.i")).cast("bigint").alias("line_no"), (-F.col("x.o")).alias("dice"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
