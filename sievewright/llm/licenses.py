"""License scans by diagonal voting, in DataFrame operations only.

All rolling word k-grams of a text (k = 3, and 2 for two-word phrases) meet the positions of the templates by hash; equal hashes are
verified by their words. A hit votes for its diagonal, word position minus template position. Diagonals of a template
that lie within ``BAND`` of each other and run on in the text are merged, so that inserted or dropped words don't break a notice. A merged span is then
aligned: read in the text's order, only hits that go on in the template's order count (running maximum of the template's position). It is
a find if these are ``COVER`` of the template's grams; a base phrase has one gram, so each of its places is a find.

One row that always matches is added to every text's grams, so texts without finds come out of the same pass: the texts
are read once and only hits are shuffled. The templates are a fixed table of this module (some 2,000 rows), which bounds the broadcast.

Defined results: null text has no words (n_words 0, labels empty, score 0, first and last null). Rows equal in doc_id and text
give equal rows, as many as came in. Other columns are not read; tables without rows give none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Phrase -> label of the base scan.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program."""
#: Label -> texts and short notices of well-known public licences, as their owners publish them for use.
NOTICES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "bsd-2-clause": [f"{_BSD} {_DISCLAIMER}"],
    "bsd-3-clause": [
        f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}",
    ],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "licensed under CC BY 4.0"],
    "cc-by-nc-4.0": ["licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "copyright": ["no part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means"],
    "gpl-2.0": [_GNU.format("General Public License", "2")],
    "gpl-3.0": ["licensed under the GNU General Public License, version 3", _GNU.format("General Public License", "3")],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
        appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
        NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "lgpl-3.0": [_GNU.format("Lesser General Public License", "3")],
    "mit": [
        "released under the MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "mpl-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        http://mozilla.org/MPL/2.0/.""",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
        as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
        granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered
        from any source distribution.""",
    ],
}
BAND = 3
#: Words between the end of one diagonal's hits and the start of the next that still belong together.
REACH = 12
COVER = 0.6
#: Stands for a text itself; no gram of words equals it.
_TEXT = "."
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def template_rows(notices: dict[str, list[str]] = NOTICES) -> list[tuple[str, int, str, int, int, bool]]:
    """(gram, template, label, position, grams of the template, base?)"""
    rows = [(_TEXT, 0, _TEXT, 0, 1, False)]
    every = [*((p, x, True) for p, x in BASE.items()), *((t, x, False) for x, texts in notices.items() for t in texts)]
    for number, (text, label, base) in enumerate(every, 1):
        words = re.findall("[a-z0-9]+", text.lower())
        k = min(3, len(words))
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        rows += [(g, number, label, i, len(grams), base) for i, g in enumerate(grams)]
    return rows


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))


def license_scan(docs: DataFrame, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    values = ", ".join(map(str, template_rows(notices)))
    templates = spark.sql(f"SELECT * FROM VALUES {values} AS t(t_gram, template, label, t_pos, t_grams, base)").withColumn("t_hash", F.xxhash64("t_gram"))
    w = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    join2 = lambda a, b: F.concat(a, F.lit(" "), b)
    w = w.withColumn("g2", F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), join2))
    w = w.withColumn("g3", F.zip_with("g2", F.slice("words", F.lit(3), F.size("words")), join2))
    grams = w.select("doc_id", "h", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(_TEXT)), "g2", "g3")).alias("i", "gram")).filter("gram IS NOT NULL")
    pos = F.when(F.col("i") > F.col("n_words"), F.col("i") - F.col("n_words") - 1).otherwise(F.col("i") - 1)
    hits = grams.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(templates), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    hits = hits.select("doc_id", "h", "n_words", "template", "label", "base", "t_pos", "t_grams", pos.alias("pos"))
    text, of = ["doc_id", "h", "n_words"], ["template", "label", "base", "t_grams"]
    votes = hits.groupBy(*text, *of, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("covered"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count(F.lit(1)).alias("rows")
    )
    order = Window.partitionBy(*text, "template", "label", "base").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > BAND) | (F.col("low") - F.lag("high").over(order) > REACH)
    votes = votes.withColumn("new", (F.col("base") | F.coalesce(apart, F.lit(True))).cast("int")).withColumn("span", F.sum("new").over(order))
    spans = votes.groupBy(*text, *of, "span").agg(F.collect_list(F.struct("diagonal", "covered")).alias("lines"), F.min("low").alias("low"), F.max("rows").alias("rows"))
    places = F.array_sort(F.flatten(F.transform("lines", lambda d: F.transform(d["covered"], lambda t: F.struct((t + d["diagonal"]).alias("pos"), t.alias("t"))))))
    none = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
    on = lambda a, p: F.when(p["t"] > a["last"], F.struct(p["t"].alias("last"), (a["n"] + 1).alias("n"))).otherwise(a)
    spans = spans.withColumn("found", F.aggregate(places, none, on)["n"])
    share = F.col("found") / F.col("t_grams")
    own = ~F.col("base") & (F.col("label") != _TEXT)
    out = spans.groupBy(*text).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("low"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base") | (own & (share >= COVER)), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("base"), F.lit(1.0)).when(own, share)), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("label") == _TEXT, F.col("rows"))).cast("int").alias("times"),
    )
    out = out.withColumn("n_words", F.col("n_words").cast("long")).withColumn("each", F.explode(F.sequence(F.lit(1), "times")))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(map(str, template_rows()))
OP5_SQL = f"""
WITH t(t_gram, template, label, t_pos, t_grams, base) AS (VALUES {_VALUES}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(len(words)))::INT AS pos FROM w),
g AS (SELECT doc_id, pos, words[pos + 1] || ' ' || words[pos + 2] AS gram FROM p WHERE pos + 2 <= len(words)
      UNION ALL SELECT doc_id, pos, words[pos + 1] || ' ' || words[pos + 2] || ' ' || words[pos + 3] FROM p WHERE pos + 3 <= len(words)),
h AS (SELECT DISTINCT doc_id, template, label, base, t_grams, pos, t_pos, pos - t_pos AS diagonal FROM g JOIN t ON gram = t_gram),
v AS (SELECT doc_id, template, base, diagonal, min(pos) AS low, max(pos) AS high FROM h GROUP BY ALL),
n AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER o > {BAND} OR low - lag(high) OVER o > {REACH}, true) THEN 1 ELSE 0 END AS new
      FROM v WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT doc_id, template, diagonal, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM n),
k AS (SELECT h.*, span, t_pos > coalesce(max(t_pos) OVER (PARTITION BY h.doc_id, h.template, span ORDER BY pos, t_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS counts
      FROM h JOIN s ON h.doc_id = s.doc_id AND h.template = s.template AND h.diagonal = s.diagonal),
f AS (SELECT doc_id, template, label, base, t_grams, span, count(*) FILTER (counts) AS found, min(pos) AS low FROM k GROUP BY ALL),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(low) FILTER (base) AS first_word, max(low) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR found / t_grams >= {COVER}) AS labels,
             max(CASE WHEN base THEN 1.0 ELSE found / t_grams END) AS score FROM f GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN a USING (doc_id)
"""
