"""Licence scans: Dice coefficient over word bigrams against templates, native."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import where_late, written

#: Fixed texts: licence notices and short licences, by their identifiers.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "MIT line 2": "Licensed under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS "
        'SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER "
        "OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
        "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
        "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        'under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "GPL-2.0 notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
        "02110-1301 USA."
    ),
    "LGPL-3.0 notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser "
        "General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."
    ),
    "AGPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero "
        "General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "CC0-1.0 notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is "
        "published from the public domain under CC0 1.0 Universal."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}

#: The least Dice coefficient of a match.
THRESHOLD = 0.8

#: Bigrams of all templates that are broadcast, some 30 bytes each; with more of them, texts' bigrams are shuffled.
BROADCAST_GRAMS = 1_000_000


def normalised(text: Column) -> Column:
    """Lower case, everything but letters and digits to single spaces."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Bigram counts that a text of `size` bigrams can reach the threshold with: 2 min(a, b) >= t (a + b)."""
    return math.ceil(size * threshold / (2 - threshold)), math.floor(size * (2 - threshold) / threshold)


def from_folder(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates from a folder of licence texts, a file each, by the files' names: such as a full set of long licences."""
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("name"))
    return {r["name"]: r["value"] for r in files.collect()}


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document and template found in it: doc_id, template, dice (the best), n_passages.

    What is scored is every run of consecutive lines of a text, from one line to all of them: its words' bigrams are a multiset, and Dice is
    twice the shared over the sum of both sizes. Of the runs that reach the threshold, each line goes to the best that covers it (of equal
    ones to the longer, then to the template whose name comes first), so a text that resembles two licences is reported as the one it is. A
    template is found in a document if it has a line there; its runs that overlap are one passage. A licence that begins
    or ends within a line is judged with the rest of that line.

    A text is normalised and cut into bigrams once; one of a single line that is too short or too long for every template by the size
    bounds isn't cut at all. Templates are given by the caller and, up to BROADCAST_GRAMS bigrams, broadcast; then no document's bigrams are
    shuffled but those that a template shares. Null and empty texts match nothing; rows equal in id and text are one; ids that repeat are reported
    together; a very long text costs as much a word as a short one; an empty table gives an empty table. Other columns of `docs`, whatever
    their names, aren't read.
    """
    spark = docs.sparkSession
    given = [(c, k, t) for c, (k, t) in enumerate((templates or TEMPLATES).items())]
    cards = spark.createDataFrame(given, "__c int, template string, __t string").withColumn("__w", F.split(normalised(F.col("__t")), " "))
    cards = cards.where(F.size("__w") > 1).withColumn("__size", F.size("__w") - 1)
    sizes = [r[0] for r in cards.select("__size").distinct().collect()]
    ranges = [bounds(s, threshold) for s in sizes] or [(1, 0)]
    bound = spark.createDataFrame([(s, *bounds(s, threshold)) for s in sizes], "__size int, __lo int, __hi int")
    cards = cards.join(F.broadcast(bound), "__size")
    kinds = cards.select("__c", "template", "__size", "__lo", "__hi")
    grams = cards.select("__c", "__size", F.explode(F.sequence(F.lit(1), F.col("__size"))).alias("__i"), "__w")
    grams = grams.groupBy("__c", "__size", F.xxhash64(F.get("__w", F.col("__i") - 1), F.get("__w", F.col("__i"))).alias("__g")).agg(F.count(F.lit(1)).cast("int").alias("__of"))
    few = (cards.agg(F.sum("__size")).collect()[0][0] or 0) <= BROADCAST_GRAMS
    small = F.broadcast if few else lambda df: df
    counts = small(grams.select("__c", "__g", "__of"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("__u")).where(F.length("__u") >= 2 * min(lo for lo, _ in ranges) + 1)  # words are parted by one character at least
    rows = rows.select("doc_id", F.xxhash64("__u").alias("__th"), F.contains("__u", F.lit("\n")).alias("__long"), F.split(normalised(F.col("__u")), " ").alias("__w")).withColumn("__n", F.size("__w") - 1)
    fits = F.col("__long")
    for lo, hi in sorted(set(ranges)):
        fits = fits | F.col("__n").between(lo, hi)
    # No filter here, and the outer explode: Spark would push either below, and normalise each text again for each bound.
    pairs = rows.select("*", F.explode_outer(F.when(fits & (F.col("__n") > 0), F.sequence(F.lit(0), F.col("__n") - 1))).alias("__p"))
    pairs = pairs.select("doc_id", "__th", "__long", "__n", "__p", F.xxhash64(F.get("__w", F.col("__p")), F.get("__w", F.col("__p") + 1)).alias("__g"))
    near = (F.lit(threshold) * (F.col("__n") + F.col("__size"))) <= 2 * F.least("__n", "__size")
    hits = pairs.join(small(grams.drop("__of")), "__g").where(near | F.col("__long"))
    hits = written(hits.select("doc_id", "__th", "__long", "__n", "__c", "__g", "__p").distinct(), "hits")
    # A text of one line is one run.
    counted = hits.where(~F.col("__long")).groupBy("doc_id", "__th", "__n", "__c", "__g").agg(F.count(F.lit(1)).alias("__k")).join(counts, ["__c", "__g"])
    scored = counted.groupBy("doc_id", "__th", "__n", "__c").agg(F.sum(F.least("__k", "__of")).alias("__both")).join(F.broadcast(kinds), "__c")
    scored = scored.withColumn("dice", 2 * F.col("__both") / (F.col("__n") + F.col("__size"))).where(F.col("dice") >= threshold)
    scored = scored.groupBy("doc_id", "__th").agg(F.min(F.struct((-F.col("dice")).alias("d"), "template")).alias("b")).select("doc_id", "b.template", (-F.col("b.d")).alias("dice"), F.lit(1).alias("n_passages"))
    both = scored.unionByName(_runs(docs, hits, kinds, counts, id_col, text_col, threshold))
    return both.groupBy("doc_id", "template").agg(F.round(F.max("dice"), 6).alias("dice"), F.sum("n_passages").alias("n_passages"))


def _runs(docs: DataFrame, hits: DataFrame, kinds: DataFrame, counts: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """doc_id, template, dice (the best), n_passages of texts of several lines.

    A run that matches has `__hi` bigrams at most and shares `__lo` at least. Places in a text are parted into cells of `__hi`;
    a run that starts in a cell ends in the next one at the latest, so two cells that share too few bigrams hold none.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # Dealt out by text, which serves both aggregates.
    rows = hits.where("__long").select("doc_id", "__th", "__c", "__g", "__p").repartition(parts, "doc_id", "__th").join(F.broadcast(kinds.select("__c", "__hi")), "__c")
    cell = F.floor(F.col("__p") / F.col("__hi"))
    rows = rows.select("doc_id", "__th", "__c", "__g", "__p", F.explode(F.array(cell, cell - 1)).alias("__cell")).where("__cell >= 0")
    by_gram = rows.groupBy("doc_id", "__th", "__c", "__cell", "__g").agg(F.sort_array(F.collect_list("__p")).alias("ps")).join(counts, ["__c", "__g"])
    rich = by_gram.groupBy("doc_id", "__th", "__c", "__cell").agg(F.sum(F.least(F.size("ps"), F.col("__of"))).alias("__most"), F.collect_list(F.struct("ps", F.col("__of").alias("of"))).alias("__grams"))
    rich = rich.join(F.broadcast(kinds), "__c").where("__most >= __lo")
    of = ["doc_id", "__th", "template", "__size", "__lo", "__hi"]
    rich = written(rich.select(*of, "__cell", "__grams"), "rich")

    # Of the texts that are left, the lines that have words: the places of their first and last.
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = written(rich.select(F.col("doc_id").alias("__d"), F.col("__th").alias("__h")).distinct(), "keys")
    found = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("__th"), text.alias("__t"))
    found = found.join(keys, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__h")), "left_semi")
    lines = found.select("doc_id", "__th", F.posexplode(F.split("__t", "\n")).alias("__no", "__l")).dropDuplicates(["doc_id", "__th", "__no"])
    in_order = Window.partitionBy("doc_id", "__th").orderBy("__no")
    lines = lines.select("doc_id", "__th", "__no", normalised(F.col("__l")).alias("__l")).where("__l <> ''").withColumn("__k", F.size(F.split("__l", " ")))
    past = F.sum("__k").over(in_order)
    lines = written(lines.select(F.col("doc_id").alias("__d"), F.col("__th").alias("__h"), (past - F.col("__k")).alias("__first"), (past - 1).alias("__last")), "lines")
    here = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__h"))

    # A hit counts in a run if the run starts after the hit of that bigram that is `of` before it.
    flat = F.flatten(F.transform("__grams", lambda x: F.transform(x["ps"], lambda p, j: F.struct(p.alias("p"), F.coalesce(F.get(x["ps"], j - x["of"]), F.lit(-1)).alias("before")))))
    starts = rich.join(lines, here & (F.floor(F.col("__first") / F.col("__hi")) == F.col("__cell"))).drop("__d", "__h", "__last")
    counts = F.transform(F.filter(flat, lambda x: (x["p"] >= F.col("__first")) & (x["before"] < F.col("__first")) & (x["p"] < F.col("__first") + F.col("__hi"))), lambda x: x["p"])
    starts = where_late(starts.select(*of, "__first", counts.alias("__ps")), F.size("__ps") >= F.col("__lo"))
    n = F.col("__last") - F.col("__first")
    ends = starts.join(lines.select("__d", "__h", "__last"), here & n.between(F.col("__lo"), F.col("__hi")))
    last, first = F.col("__last"), F.col("__first")
    dice = 2 * F.size(F.filter("__ps", lambda p: p < last)) / (n + F.col("__size"))
    scored = written(where_late(ends.select("doc_id", "__th", "template", "__first", "__last", dice.alias("dice")), F.col("dice") >= threshold), "scored")

    # Each line's best run; a run stays if it is some line's.
    place = lines.select("__d", "__h", F.col("__first").alias("__line"))
    covering = scored.join(place, here & F.col("__line").between(first, last))
    best = covering.groupBy("doc_id", "__th", "__line").agg(F.min(F.struct((-F.col("dice")).alias("d"), (first - last).alias("n"), "template", first.alias("__first"), last.alias("__last"))).alias("b"))
    best = best.select("doc_id", "__th", "b.template", "b.__first", "b.__last", (-F.col("b.d")).alias("dice")).distinct()
    ordered = Window.partitionBy("doc_id", "__th", "template").orderBy("__first", "__last")
    apart = F.max("__last").over(ordered.rowsBetween(Window.unboundedPreceding, -1)) < first
    return best.withColumn("__apart", F.coalesce(apart.cast("int"), F.lit(1))).groupBy("doc_id", "__th", "template").agg(F.max("dice").alias("dice"), F.sum("__apart").cast("int").alias("n_passages")).drop("__th")
