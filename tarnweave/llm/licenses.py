"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the positions of the same k-grams in
license templates (64 bits; a vote that only a hash's collision gives cannot verify a span by itself). A
match at word i of the text and j of a template votes for the diagonal i - j; votes are summed for each text, template and diagonal,
and neighbouring diagonals (a few words inserted or lost) merge into one span. A span is verified by
the Dice similarity of its k-grams with the template's, each counted once; from `threshold` on
it gives the template's label. Of a merged group the best is judged: the whole, or one diagonal, or two or three that follow each
other; so words around a notice that votes for the same template too do not take away its label (a notice word for word is on one
diagonal, and always verified). Besides, short phrases label a text wherever their words stand.

The template table does not grow with the texts and is broadcast. A text is read once; what is kept
of it is narrow, and only matching k-grams are dealt out.

Edge cases: a null text counts as empty: no words, no labels, score 0. Texts shorter than a
k-gram have no votes. Rows that repeat an id give a row each. Other columns are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, checkpoint, lower_ascii

#: What stands between words: all ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM, NEAR, THRESHOLD = 3, 4, 0.8

#: Phrases that label a text.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: License lines and notices, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def words_of(text: str) -> list[str]:
    """The words of a text, as the operator reads them."""
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, UPPER.lower()))) if w]


def template_grams(spark, templates=None, gram: int = GRAM) -> DataFrame:
    """A row for each position of each template: t, label, t_pos, t_grams, h (the gram's hash)."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES if templates is None else templates):
        words = words_of(text)
        n = len(words) - gram + 1
        rows += [(t, label, j, n, words[j : j + gram]) for j in range(n)]
    table = spark.createDataFrame(rows, "t int, label string, t_pos int, t_grams int, words array<string>")
    return table.select("t", "label", "t_pos", "t_grams", F.xxhash64(*[F.get("words", k) for k in range(gram)]).alias("h"))


def _scan(docs: DataFrame, id_col: str, text_col: str, gram: int, templates: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """One pass over the texts. A row for each text (pos -1) with n_words and the places of phrases
    p0, p1, ...; a row for each vote: a k-gram at pos that template t has at t_pos."""
    words = F.filter(F.split(lower_ascii(F.col(f"`{text_col}`").cast("string")), GAP), lambda w: w != "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), words.alias("w"))
    n = F.size("w")

    def starts(phrase: str):
        parts = phrase.split(" ")

        def stands(i):
            out = F.get("w", i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                out = out & (F.get("w", i + k) == part)
            return F.coalesce(out, F.lit(False))

        found = F.filter(F.sequence(F.lit(0), n - 1), stands)
        return F.when((n >= len(parts)) & F.array_contains("w", parts[-1]), found).otherwise(F.array().cast("array<int>"))

    # place 0 stands for the text itself
    head, grams = F.array(F.lit(None).cast("long")), F.transform(F.sequence(F.lit(0), n - gram), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(gram)]))
    own = ["doc_id", "n_words", *[f"p{i}" for i in range(len(phrases))]]
    found = F.struct("doc_id", n.cast("long").alias("n_words"), *[starts(p).alias(f"p{i}") for i, p in enumerate(phrases)])
    # computed before the rows are exploded, so that the words stay behind
    rows = rows.select("row", found.alias("own"), F.when(n >= gram, F.concat(head, grams)).otherwise(head).alias("grams"))
    rows = rows.select("row", "own", F.posexplode("grams").alias("pos", "h"))
    # a few thousand rows
    rows = rows.join(F.broadcast(templates), "h", "left").where("pos = 0 or t is not null").withColumn("pos", F.col("pos") - 1)
    return rows.select("row", *[F.when(F.col("pos") < 0, F.col(f"own.{c}")).alias(c) for c in own], "pos", "t", "label", "t_pos", "t_grams")


def _spans(votes: DataFrame, gram: int, near: int) -> DataFrame:
    """Spans of templates: row, label, t, first_word, last_word, similarity."""
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    each = votes.groupBy("row", "t", "label", "t_grams", "diagonal").agg(F.collect_set("pos").alias("at"), F.collect_set("t_pos").alias("t_at"))
    order = Window.partitionBy("row", "t").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int")
    each = each.withColumn("span", F.sum(F.coalesce(far, F.lit(0))).over(order))
    group = Window.partitionBy("row", "t", "span").orderBy("diagonal")

    def judged(at, t_at):
        first, last = F.array_min(at), F.array_max(at)
        similarity = F.least(2.0 * F.least(F.size(at), F.size(t_at)) / (last - first + 1 + F.col("t_grams")), F.lit(1.0))
        # of equal ones the first, then the longest
        return F.struct(similarity.alias("similarity"), (-first).alias("first"), last.alias("last"))

    def together(c: str, n: int):
        return F.array_distinct(F.flatten(F.collect_list(c).over(group.rowsBetween(0, n))))

    each = each.withColumn("own", F.greatest(judged(F.col("at"), F.col("t_at")), *[judged(together("at", n), together("t_at", n)) for n in (1, 2)]))
    merged = each.groupBy("row", "t", "label", "t_grams", "span").agg(F.max("own").alias("own"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_distinct(F.flatten(F.collect_list("t_at"))).alias("t_at"))
    best = merged.select("row", "label", "t", F.greatest("own", judged(F.col("at"), F.col("t_at"))).alias("best"))
    return best.select("row", "label", "t", (-F.col("best.first")).alias("first_word"), (F.col("best.last") + gram - 1).alias("last_word"), F.col("best.similarity").alias("similarity"))


def _pass(docs: DataFrame, id_col: str, text_col: str, templates, gram: int, near: int, phrases: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    found = checkpoint(_scan(docs, id_col, text_col, gram, template_grams(docs.sparkSession, templates, gram), phrases))
    rows = found.where("pos < 0").drop("pos", "t", "label", "t_pos", "t_grams")
    return rows, _spans(found.where("pos >= 0").select("row", "pos", "t", "label", "t_pos", "t_grams"), gram, near)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates=None, gram: int = GRAM, near: int = NEAR, threshold: float = THRESHOLD) -> DataFrame:
    """Verified spans: id_col, label, template (its number), first_word, last_word, similarity."""
    rows, spans = _pass(docs, id_col, text_col, templates, gram, near, PHRASES)
    spans = spans.where(F.col("similarity") >= threshold).join(rows.select("row", "doc_id"), "row")
    return spans.select(F.col("doc_id").alias(id_col), "label", F.col("t").alias("template"), "first_word", "last_word", "similarity")


def license_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates=None, gram: int = GRAM, near: int = NEAR, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels,
    labels, score (similarity of the best span; at least 0.5 with a phrase)."""
    rows, spans = _pass(docs, id_col, text_col, templates, gram, near, phrases)
    verified = F.when(F.col("similarity") >= threshold, F.col("label"))
    found = spans.groupBy("row").agg(F.collect_set(verified).alias("more"), F.max("similarity").alias("best"))
    places = F.concat(*[f"p{i}" for i in range(len(phrases))])
    named = F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())])
    rows = rows.select("row", "doc_id", "n_words", places.alias("places"), F.array_sort(F.array_distinct(F.array_compact(named))).alias("base"))
    out = rows.join(found, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return out.select(
        F.col("doc_id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
