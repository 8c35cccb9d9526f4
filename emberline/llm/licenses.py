"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory (operator 7). DataFrame functions only."""

from __future__ import annotations

import re
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import let, text_of, words_of, written

#: Least cosine of a header line, and of a licence file's whole text.
HEADER, WHOLE = 0.6, 0.5

# Notices of public licences.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}
# Whole texts of public licences.
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
FULL_TEXTS = {
    "MIT": "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY,
    "ISC": "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Copyright (c) All rights reserved. " + _BSD_TERMS + " " + _BSD_WARRANTY,
    "BSD-3-Clause": "Copyright (c) All rights reserved. " + _BSD_TERMS + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _NO_WARRANTY,
}
#: Parts into which the files of one directory are dealt when they are joined with its licence.
SALTS = 16
TRIGGER = r"(?i)licen[sc]|copyright|rights reserved|public domain|hereby granted|redistribut|spdx"


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


#: Words of the templates: what a vector has places for, and the bound of what is counted and sent to the driver.
VOCABULARY = sorted({w for notices in (*TEMPLATES.values(), FULL_TEXTS.values()) for t in notices for w in _words(t)})


def weights(files: DataFrame) -> tuple[dict[str, float], float]:
    """(idf of each template word, idf of a word that no text has), over the words of all whole texts."""
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    seen = files.select(F.explode(F.array_union(F.array_intersect(words_of(text_of()), vocabulary), F.array(F.lit("")))).alias("w"))
    df = {r.w: r.n for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = df.get("", 0)
    return {w: log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in VOCABULARY}, log(n + 1) + 1


def vectors(idf: dict[str, float], templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, dict[str, float]]]:
    """(licence, unit vector) of each notice."""
    out = []
    for name, notices in templates.items():
        for t in notices:
            tf: dict[str, float] = {}
            for w in _words(t):
                tf[w] = tf.get(w, 0) + idf[w]
            norm = sqrt(sum(x * x for x in tf.values()))
            out.append((name, {w: x / norm for w, x in tf.items()}))
    return out


def _dot(weights: Column):
    return lambda a, x: a + x["x"] * F.coalesce(weights[x["w"]], F.lit(0.0))


def best_match(text: Column, idf: dict[str, float], rare: float) -> Column:
    """struct(score, license): the notice with the largest cosine to the text. Words that no template has count as rare."""
    of_word = F.create_map(*[F.lit(x) for w in sorted({w for notices in TEMPLATES.values() for t in notices for w in _words(t)}) for x in (w, idf[w])])

    def weighted(words: Column) -> Column:
        return let(F.array_sort(words), lambda s: let(F.filter(F.transform(s, lambda w, i: i), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))), lambda at: runs(s, at)))

    def runs(s: Column, at: Column) -> Column:
        """Of sorted words, each once with its weight; at: where its run begins."""
        n = lambda i, k: F.coalesce(F.get(at, k + 1), F.size(s)) - i
        return F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("w"), (n(i, k) * F.coalesce(of_word[F.get(s, i)], F.lit(rare))).alias("x")))

    def compared(tf: Column) -> Column:
        norm = F.sqrt(F.aggregate(tf, F.lit(0.0), lambda a, x: a + x["x"] * x["x"]))
        scores = []
        for name, vector in vectors(idf):
            of_notice = F.create_map(*[F.lit(x) for pair in vector.items() for x in pair])
            dot = F.aggregate(tf, F.lit(0.0), _dot(of_notice))
            scores.append(F.struct(F.round(F.coalesce(F.try_divide(dot, norm), F.lit(0.0)), 6).alias("score"), F.lit(name).alias("license")))
        return F.array_max(F.array(*scores))

    return let(let(words_of(text), weighted), compared)


def whole_matches(spoken: DataFrame, files: DataFrame, idf: dict[str, float]) -> DataFrame:
    """(path, id, h, score, license): the full licence text with the largest cosine to each whole text of spoken (path, id, h,
    text). Vectors are sparse rows (text, word, weight); every word has the document frequency that it has over all files."""
    df = files.select(F.explode(F.array_distinct(words_of(text_of()))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    size = files.agg(F.count("*").alias("files"))
    of_text = ["path", "id", "h"]
    tf = spoken.select(*of_text, F.explode(words_of(F.col("text"))).alias("w")).groupBy(*of_text, "w").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (F.log((F.col("files") + 1) / (F.col("df") + 1)) + 1)
    rows = written(tf.join(df, "w").crossJoin(F.broadcast(size)).select(*of_text, "w", weight.alias("x")))  # size: one row
    norms = rows.groupBy(*of_text).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    places = [(name, w, x) for name, vector in vectors(idf, {k: [t] for k, t in FULL_TEXTS.items()}) for w, x in vector.items()]
    templates = F.broadcast(files.sparkSession.createDataFrame(places, "license string, w string, y double"))  # words of the templates
    dots = rows.join(templates, "w").groupBy(*of_text, "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    named = [F.col(f"n.{c}").eqNullSafe(F.col(f"d.{c}")) for c in of_text]
    scored = dots.alias("d").join(norms.alias("n"), named).select("d.path", "d.id", "d.h", F.round(F.col("dot") / F.col("norm"), 6).alias("score"), "license")
    return scored.groupBy(*of_text).agg(F.max(F.struct("score", "license")).alias("m")).select(*of_text, "m.score", "m.license")


def own(files: DataFrame, header: float = HEADER, whole: float = WHOLE) -> DataFrame:
    """(path, id, h, license, score, is_file) of files (path, id, text) with a licence of their own; h: a hash of the text.

    Every line of every whole text that speaks of a licence is compared with all notices, alone and with the two lines
    after it; the best one of at least `header` counts. The whole text is compared with the full licence texts; from `whole`
    on it is a licence file, and that licence counts if it is the better one. A text is a licence file too if most of its
    words are in such lines.
    """
    idf, rare = weights(files)
    lines = F.split("text", r"\R")
    at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(TRIGGER))
    texts = F.flatten(F.transform(at, lambda i: F.array(F.get(lines, i), F.array_join(F.slice(lines, i + 1, F.lit(3)), " "))))
    spoken = files.select("path", "id", text_hash().alias("h"), text_of().alias("text")).where(F.col("text").rlike(TRIGGER))
    each = spoken.select("path", "id", "h", F.size(words_of(F.col("text"))).alias("n_words"), F.explode(F.array_distinct(texts)).alias("line"))
    scored = each.select("path", "id", "h", "n_words", F.size(words_of(F.col("line"))).alias("n"), best_match(F.col("line"), idf, rare).alias("m"))
    best = scored.groupBy("path", "id", "h", "n_words").agg(F.max(F.struct("m.score", "m.license", "n")).alias("b"))
    by_line = best.where(F.col("b.score") >= header).select("path", "id", "h", F.col("b.license").alias("license"), F.col("b.score").alias("score"), (F.col("b.n") * 2 >= F.col("n_words")).alias("is_file"))
    by_text = whole_matches(spoken, files, idf).where(F.col("score") >= whole).select("path", "id", "h", "license", "score", F.lit(True).alias("is_file"))
    both = by_line.unionByName(by_text).groupBy("path", "id", "h").agg(F.max(F.struct("score", "license")).alias("m"), F.max("is_file").alias("is_file"))
    return both.select("path", "id", "h", "m.license", "m.score", "is_file")


def text_hash() -> Column:
    return F.xxhash64(text_of())


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scanned(files: DataFrame, header: float = HEADER) -> DataFrame:
    """One row a file of files (path, id, text): path, id, license, score, origin (own, inherited or none), source_dir. Other
    columns are not read.

    A file keeps its own licence. Otherwise it has that of the nearest directory above it (its own directory first) that
    holds a licence file: one named LICENSE, LICENCE, COPYING or NOTICE, or one whose text is mostly a notice; of several in a
    directory the best score, then the least path and id counts. Files without a path, null or with no directory, inherit from the
    top. Null and empty texts have no licence of their own. Repeated rows are rows of the result; rows of one path and id with different texts are
    files of their own. An empty table stays empty.
    """
    found = written(own(files, header))
    named = F.col("path").rlike(r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$")
    declared = found.where(named | F.col("is_file")).withColumn("dir", _parent(F.coalesce("path", F.lit("")))).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "id", "license")).alias("d")).select(F.col("dir").alias("above"), "d.license", (-F.col("d.s")).alias("score"))
    placed = files.select("path", "id", text_hash().alias("h"), _parent(F.coalesce("path", F.lit(""))).alias("dir"))
    dirs = placed.select("dir").distinct()
    steps = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps))), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("above"))
    nearest = ancestors.join(declared, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "license", "score")).alias("n"))
    mine = found.select("path", "id", "h", F.struct("score", "license").alias("m"))
    p = placed.alias("p")
    with_own = p.join(mine.alias("o"), F.col("p.path").eqNullSafe(F.col("o.path")) & F.col("p.id").eqNullSafe(F.col("o.id")) & (F.col("p.h") == F.col("o.h")), "left").select("p.path", "p.id", "p.dir", "o.m", F.pmod(F.xxhash64("p.id", "p.h"), F.lit(SALTS)).cast("int").alias("salt"))
    dealt = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # one directory's files are many tasks' work
    out = with_own.join(dealt, ["dir", "salt"], "left")
    return out.select(
        "path",
        "id",
        F.coalesce("m.license", "n.license").alias("license"),
        F.coalesce("m.score", "n.score").alias("score"),
        F.when(F.col("m").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("m").isNull(), F.col("n.above")).alias("source_dir"),
    )
