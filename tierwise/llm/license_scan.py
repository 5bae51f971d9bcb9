"""License scans by diagonal voting, in DataFrame functions only.

All rolling three-word hashes of all texts are joined with the positions of the same hashes in license
templates (a constant table of a few hundred rows, hence broadcast). A hit votes for its offset diagonal
(text position less template position); votes are summed for each text, template and diagonal, and
neighbouring diagonals (words put in or left out) are merged into chains. A chain may hold much beside a copy, so it is
verified by windows: from each of its diagonals on, those no further apart than the template is long. A window in which
distinct template positions cover enough of the template is a span, at most twice as long as the template; the best
one of a chain counts. Grams of a text that no template has are passed over before rows are made of them. Grams are compared by 64-bit hashes with a few hundred
constant ones: of 1e12 grams a wrong hit has a probability of about 1e-5.

Phrases (the base rule) are counted besides, at every place where their words stand consecutively; labels of
verified spans come on top, and the score is 1 with a phrase, else the best coverage of a template.

Defined results: a null or empty text has no words and score 0; repeated rows and rows without an id are
scanned like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierwise.llm.common import table, text_rows, text_tag
from tierwise.llm.quality_rules import let

GRAM = 3
#: Diagonals this near are one span; share of the template's grams that verifies it.
NEAR, COVERAGE = 4, 0.6
#: Phrases of the base rule with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Words of common notices, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
]

# Notices and licenses as they are usually printed, by label.
LICENSES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY
THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License
along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""),
]
TEMPLATES += [(label, " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))) for label, text in LICENSES]
#: Grams of the longest template.
LONGEST = max(len(text.split()) for _, text in TEMPLATES) - GRAM + 1


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, grams, at, h: the constant side of the join, hashed by the same function as the texts."""
    words = [(i, label, text.split()) for i, (label, text) in enumerate(TEMPLATES)]
    rows = [(i, label, len(w) - GRAM + 1, at, *w[at : at + GRAM]) for i, label, w in words for at in range(len(w) - GRAM + 1)]
    return spark.createDataFrame(rows, "template int, label string, grams int, at int, a string, b string, c string").withColumn("h", F.xxhash64("a", "b", "c")).drop("a", "b", "c")


def worded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tag, flat: the words of each text, one space before, between and after."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = text_rows(docs, id_col, text_col).withColumn("tag", text_tag())
    flat = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return rows.select("doc_id", "tag", F.concat(F.lit(" "), flat, F.lit(" ")).alias("flat"))


def _words(flat: Column) -> Column:
    return F.split(F.trim(flat), " ")


def _places_of(words: Column, parts: list[str], label: str) -> Column:
    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for j, x in enumerate(parts[1:], 1):
            found = found & F.coalesce(F.get(words, i + j) == x, F.lit(False))
        return found

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _phrase_places(flat: Column) -> Column:
    """Array of (start, label) of each place of a phrase."""

    def places(words: Column) -> Column:
        found = []
        for phrase, label in PHRASES:
            found.append(_places_of(words, phrase.split(), label))
        return F.concat(*found)

    none = F.array().cast("array<struct<start:int,label:string>>")
    ends = sorted({phrase.split()[-1] for phrase, _ in PHRASES})
    some = F.lit(False)
    for x in ends:
        some = some | F.contains(flat, F.lit(f" {x} "))
    return F.when(some, let(_words(flat), places)).otherwise(none)


def votes(rows: DataFrame) -> DataFrame:
    """doc_id, tag, template, label, grams, diagonal, at: a row for each hit of a template's gram."""
    known = template_grams(rows.sparkSession)
    # a few hundred constants: grams of a text that are none of them make no row
    wanted = [r.h for r in known.select("h").distinct().collect()]
    words = rows.where(F.col("flat") != "  ").select("doc_id", "tag", _words(F.col("flat")).alias("words"))
    grams = F.transform(F.slice("words", 1, F.greatest(F.size("words") - (GRAM - 1), F.lit(0))), lambda w, i: F.struct(i.alias("place"), F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h")))
    rolled = words.select("doc_id", "tag", F.explode(F.filter(grams, lambda x: x["h"].isin(wanted))).alias("x")).select("doc_id", "tag", "x.place", "x.h")
    return rolled.join(F.broadcast(known), "h").select("doc_id", "tag", "template", "label", "grams", (F.col("place") - F.col("at")).alias("diagonal"), "at")


def spans(hits: DataFrame, near: int = NEAR, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, tag, label, template, first (about the first word), coverage of the best verified span of each chain of diagonals."""
    key = ["doc_id", "tag", "template", "label", "grams"]
    diagonals = hits.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("seen"), F.count("*").alias("votes"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > near).cast("int"), F.lit(1))
    chained = diagonals.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(along))
    # a diagonal with those after it, as far as the longest template reaches; of these, as far as its own one does
    ahead = Window.partitionBy(*key, "chain").orderBy("diagonal").rangeBetween(0, LONGEST)
    reach = F.collect_list(F.struct("diagonal", "seen")).over(ahead)
    last = F.col("diagonal") + F.col("grams")
    windows = chained.withColumn("reach", reach).withColumn("last", last).withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform(F.filter("reach", lambda x: x["diagonal"] <= F.col("last")), lambda x: x["seen"])))))
    best = windows.groupBy(*key, "chain").agg(F.max(F.struct("covered", (-F.col("diagonal")).alias("back"))).alias("top"))
    share = F.col("top.covered") / F.col("grams")
    return best.select("doc_id", "tag", "label", "template", (-F.col("top.back")).alias("first"), share.alias("coverage")).where(F.col("coverage") >= coverage)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    rows = worded(docs, id_col, text_col)
    n = F.when(F.col("flat") == "  ", 0).otherwise(F.length("flat") - F.length(F.translate("flat", " ", "")) - 1)
    base = rows.select("doc_id", "tag", n.cast("long").alias("n_words"), _phrase_places(F.col("flat")).alias("places"))
    own = spans(votes(rows)).groupBy("doc_id", "tag").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage")).withColumnsRenamed({"doc_id": "hit_id", "tag": "hit_tag"})
    found = base.join(own, base.doc_id.eqNullSafe(own.hit_id) & (base.tag == own.hit_tag), "left")
    labels = F.transform("places", lambda x: x["label"])
    starts = F.transform("places", lambda x: x["start"])
    text_of = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        text_of(labels).alias("base_labels"), text_of(F.concat(labels, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.round(F.coalesce("coverage", F.lit(0.0)), 6)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, the places of license phrases, the labels found, and a score."""
    return scan(table(spark, sf_dir, "documents"))


ORACLE = (
    r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
), i as (
  select doc_id, ws, unnest(range(0, len(ws))) as p from w
), b as (
  select doc_id, p, case when ws[p+1] = 'mit' and ws[p+2] = 'license' then 'mit' when ws[p+1] = 'apache' and ws[p+2] = 'license' then 'apache'
    when ws[p+1] = 'general' and ws[p+2] = 'public' and ws[p+3] = 'license' then 'gpl' end as label from i
), bb as (
  select doc_id, count(*) as n_base, min(p) as first_word, max(p) as last_word, list(distinct label) as ls from b where label is not null group by doc_id
), t as (
  select template, label, string_split(text, ' ') as tw from (values """
    + ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    + r""") as x(template, label, text)
), tg as (
  select template, label, len(tw) - 2 as grams, g - 1 as pos, tw[g] || ' ' || tw[g+1] || ' ' || tw[g+2] as gram from (select *, unnest(range(1, len(tw) - 1)) as g from t)
), h as (
  select doc_id, template, label, grams, p - pos as diagonal, pos from (select doc_id, p, ws[p+1] || ' ' || ws[p+2] || ' ' || ws[p+3] as gram from i where p + 3 <= len(ws)) x join tg using (gram)
), d as (
  select *, sum(apart) over (partition by doc_id, template order by diagonal range unbounded preceding) as span
  from (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= 4 then 0 else 1 end as apart from h)
), dd as (
  select distinct doc_id, template, label, grams, span, diagonal from d
), s as (
  select a.doc_id, a.label, count(distinct b.pos) / a.grams as coverage from dd a join d b on b.doc_id = a.doc_id and b.template = a.template and b.span = a.span and b.diagonal between a.diagonal and a.diagonal + a.grams
  group by a.doc_id, a.template, a.label, a.grams, a.span, a.diagonal having count(distinct b.pos) / a.grams >= 0.6
), ss as (
  select doc_id, list(distinct label) as ls, max(coverage) as coverage from s group by doc_id
)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       coalesce(array_to_string(list_sort(bb.ls), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.ls, []), coalesce(ss.ls, [])))), ','), '') as labels,
       case when n_base > 0 then 1.0e0 else cast(round(coalesce(coverage, 0), 6) as double) end as score
from w left join bb using (doc_id) left join ss using (doc_id)
"""
)
