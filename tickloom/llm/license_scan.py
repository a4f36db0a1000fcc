"""License scans: TF-IDF cosine of headers and licence files to templates, inherited along directories.

Templates are texts of licences, the notices that files carry for them, titles and SPDX identifiers. A term's
document frequency is counted over all files; its weight in a text is its count there times
ln((files + 1) / (frequency + 1)) + 1. Telling terms are terms of templates that at most a tenth of all files
(and 50 more) hold, lines aside three quarters of whose words are words of templates: notices in every file do
not make their own words common. A line with two of them or more is a licence line. Compared with every template are:
each licence line; each block of licence lines, between two of which one other line may lie; and the whole of each file
with licence lines, which is how licence files of many lines are found. So are, however common their words, every
line with two words of templates and every file with such a line, unless the words that it has have less than
0.36 of the squared weights of every template: then no cosine can reach 0.6. So telling terms only tell where
blocks end. Nor are the weights of all words looked up for texts that cannot reach it even if their other words
weigh the least that words of their kind may: 1 if common, and what the rarest of the common words has if not.

A cosine of at least 0.6 names a licence. A file whose whole text reaches that is a licence file, and speaks
for its directory; its own licence is that of the whole. Other files' own licence is that of their best
block, or if none has one, of their best line: a line of a longer licence may be all of a shorter one.
Files without a licence of their own take that of the nearest directory above them that has a licence file,
found by joining the paths of all directories above with the directories of licence files.

Defined results: a null or empty text has no licence lines. A null path is the directory above all others. Of
equally good templates the name that sorts first wins; of several licence files in a directory, the best,
then the name. Rows equal in doc_id and path are one file, for which the best of their texts speaks. Lines
and texts of any length are compared whole. An empty table has an empty result. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import attached
from .line_dedup import let, words_of
from .scratch import pointed, released, written

LEAST_COSINE = 0.6
#: The part of all files, and the number besides, that may hold a telling term, and how many a licence line has at least.
TELLING, TELLING_FILES, LEAST_TERMS = 0.1, 50, 2
#: The part of a template's squared weights without which no cosine reaches the least, rounding left aside.
COVERED = LEAST_COSINE**2 * (1 - 1e-6)
#: The most frequent words, templates' aside, that are told from rarer ones where only the least weight of a word counts.
COMMON_WORDS = 1000
#: The part of a line's words that are template words from which on it does not count as a use of them.
MOSTLY = 0.75
#: Other lines that may lie between two lines of a block.
GAP = 1

# Names of licences (SPDX) with texts, notices and titles by which they are known.
WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
APACHE_GRANT = "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."
GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details. You should have received a copy of the GNU {0} Public License along with this program."
GPL_TITLE = "GNU {} PUBLIC LICENSE Version {} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
CC = "This work is licensed under a Creative Commons {} {} International License."
GNU = [("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")]
CREATIVE = [("CC-BY-4.0", "Attribution", "4.0"), ("CC-BY-SA-4.0", "Attribution-ShareAlike", "4.0"), ("CC-BY-NC-4.0", "Attribution-NonCommercial", "4.0"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives", "4.0"), ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike", "4.0")]
TEXTS = [
    ("Apache-2.0", APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", f"Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION {APACHE_GRANT}"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", BSD), ("BSD-2-Clause", f"{BSD} {BSD_END}"), ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) All rights reserved. {BSD} {BSD_END}"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", f"{BSD} {BSD_THIRD}"), ("BSD-3-Clause", f"{BSD} {BSD_THIRD} {BSD_END}"), ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication"),
    ("ISC", "ISC License"), ("ISC", ISC), ("ISC", f"{ISC} {ISC_END}"),
    ("MIT", "The MIT License (MIT)"), ("MIT", "Released under the MIT License"), ("MIT", MIT), ("MIT", f"{MIT} {WARRANTY}"), ("MIT", f"MIT License Copyright (c) {MIT} {WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]


def template_texts() -> list[tuple[str, str]]:
    """(name, text) of every template: the fixed ones, those of the families, and an SPDX line for each name."""
    out = list(TEXTS)
    for name, kind, version in GNU:
        out += [(name, GPL.format(kind, version)), (name, GPL_TITLE.format(kind.upper(), version)), (name, f"GNU {kind} Public License version {version}"), (name, f"This work is licensed under the GNU {kind} Public License, version {version}.")]
    for name, kind, version in CREATIVE:
        short = name.removesuffix("-" + version).replace("CC-", "CC ")
        out += [(name, CC.format(kind, version)), (name, f"Licensed under {short} {version}."), (name, f"{kind} {version} International")]
    return sorted(out + [(name, f"SPDX-License-Identifier: {name}") for name in {name for name, _ in out}])


def templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(template_texts())], "template int, license string, body string")
    return rows.select("template", "license", words_of(F.col("body")).alias("words"))


def frequencies(files: DataFrame) -> DataFrame:
    """(term, df): how many files hold a term."""
    return files.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def identified(files: DataFrame) -> DataFrame:
    """Files with a text, told apart by a hash of doc_id, path and text."""
    return files.where("text is not null").withColumn("file", F.xxhash64("doc_id", "path", "text", F.col("doc_id").isNull(), F.col("path").isNull()))


def line_terms(files: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(file, place, n, terms) of every line with a word of a template: those, of n different words."""
    lines = identified(files).select("file", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    made = F.transform(F.array(F.array_distinct(words_of(F.col("raw")))), lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda x: x.isin(vocabulary)).alias("terms")))
    return written(lines.select("file", "place", F.inline(made)).where(F.size("terms") > 0), "lines")


def telling_terms(models: DataFrame, df: DataFrame, n: int, lines: DataFrame) -> list[str]:
    """Terms of templates that few files hold in lines that are not mostly words of templates: a notice does not make
    its own words common. Bounded by the templates' vocabulary."""
    few = n * TELLING + TELLING_FILES
    terms = models.select(F.explode("words").alias("term")).distinct().join(df, "term", "left").select("term", (F.coalesce("df", F.lit(0)) > few).alias("common")).collect()
    common = [r.term for r in terms if r.common]
    plain = lines.where(F.size("terms") < F.col("n") * MOSTLY).select("file", F.explode(F.filter("terms", lambda x: x.isin(common))).alias("term")) if common else None
    used = {r.term for r in plain.distinct().groupBy("term").count().where(F.col("count") > few).collect()} if common else set()
    return [r.term for r in terms if r.term not in used]


def weight_shares(models: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """(template, term, share): a term's part of the squared weights of a template, the fixed texts' words."""
    tf = models.select("template", F.explode("words").alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    v = F.col("tf") * (F.log(F.lit(float(n + 1)) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    squares = tf.join(df, "term", "left").select("template", "term", (v * v).alias("square"))
    return pointed(squares.withColumn("share", F.col("square") / F.sum("square").over(Window.partitionBy("template"))).select("template", "term", "share"))


def may_cover(shares: DataFrame) -> Column:
    """Whether the column terms can have COVERED of some template's squared weights, by the most that each term has."""
    most = {r.term: r.most for r in shares.groupBy("term").agg(F.max("share").alias("most")).collect()}  # the templates' words
    table = F.map_from_arrays(F.lit(list(most)), F.lit(list(most.values())))
    return F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.coalesce(F.element_at(table, t), F.lit(0.0))) >= COVERED


def covering(held: DataFrame, by: list[str], shares: DataFrame) -> DataFrame:
    """Those (columns ``by``) of held (by, terms) whose terms have COVERED of a template's squared weights."""
    each = held.select(*by, F.explode("terms").alias("term")).join(F.broadcast(shares), "term")  # the templates' words
    return each.groupBy(*by, "template").agg(F.sum("share").alias("share")).where(F.col("share") >= COVERED).select(*by).distinct()


def units(files: DataFrame, lines: DataFrame, telling: list[str], shares: DataFrame) -> DataFrame:
    """(doc_id, path, scope, words; 0 whole files, 1 blocks, 2 lines) of all licence lines, blocks of them, and files that
    hold some; and of all lines and files that can reach the least cosine, however common their words."""
    may = may_cover(shares)
    places = lines.where(F.size(F.filter("terms", lambda x: x.isin(telling))) >= LEAST_TERMS).select("file", "place")
    in_file = Window.partitionBy("file").orderBy("place")  # licence lines of one file
    starts = pointed(places).distinct().withColumn("new", (F.col("place") - F.lag("place").over(in_file) > GAP + 1).cast("int"))
    at = starts.select("file", "place", F.coalesce(F.sum("new").over(in_file), F.lit(0)).alias("block"))
    none = F.lit(None).cast("long").alias("block")
    two = F.size("terms") >= LEAST_TERMS
    alone = covering(lines.where(two & may), ["file", "place"], shares).select("file", "place", none)
    # The groups by file are those by file and template, too.
    of_file = lines.groupBy("file").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"), F.max(two).alias("two"))
    whole = covering(of_file.where(F.col("two") & may), ["file"], shares).select("file", F.lit(None).cast("int").alias("place"), none)
    at = at.unionByName(alone).groupBy("file", "place").agg(F.max("block").alias("block")).unionByName(whole)
    at = at.groupBy("file").agg(F.collect_list(F.struct("place", "block")).alias("at"))
    held = attached(identified(files), pointed(at), "file")

    def bodies(lines):
        one = F.transform(F.filter("at", lambda a: a["place"].isNotNull()), lambda a: F.struct(F.lit(2).alias("scope"), F.get(lines, a["place"]).alias("body")))
        of_block = lambda b: F.array_join(F.transform(F.array_sort(F.filter("at", lambda a: a["block"] == b)), lambda a: F.get(lines, a["place"])), "\n")
        block = F.transform(F.array_distinct(F.filter(F.transform("at", lambda a: a["block"]), lambda b: b.isNotNull())), lambda b: F.struct(F.lit(1).alias("scope"), of_block(b).alias("body")))
        return F.concat(one, block, F.array(F.struct(F.lit(0).alias("scope"), F.col("text").alias("body"))))

    each = held.select("doc_id", "path", F.explode(let(F.split("text", "\n"), bodies)).alias("x"))
    return each.select("doc_id", "path", "x.scope", words_of(F.col("x.body")).alias("words"))


def reaching(found: DataFrame, models: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """(unit) of all units that may be near enough to a template: what they share with it is counted whole, and of
    their other words only the least that they can weigh. No unit that reaches the least cosine is left out."""
    idf = F.log(F.lit(float(n + 1)) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    tf_models = models.select("template", F.explode("words").alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    of_models = pointed(tf_models.join(df, "term", "left").select("template", "term", idf.alias("idf"), (F.col("tf") * idf).alias("v")))  # the templates' words
    own = [r.term for r in of_models.select("term").distinct().collect()]
    top = df.where(~F.col("term").isin(own)).orderBy(F.desc("df")).limit(COMMON_WORDS).collect()
    common = [r.term for r in top]
    rarest = math.log((n + 1) / (min((r.df for r in top), default=0) + 1)) + 1
    # Words k times in all, d of them different, have squared counts of k^2 / d at least; and of k.
    rare = F.filter("words", lambda x: ~x.isin(own + common))
    facts = found.select("unit", F.size(F.filter("words", lambda x: x.isin(common))).alias("often"), F.explode(F.array(rare)).alias("rare"))
    seldom = F.col("n") * F.col("n") / F.greatest(F.col("d"), F.lit(1)) * rarest**2
    facts = facts.select("unit", "often", F.size("rare").alias("n"), F.size(F.array_distinct("rare")).alias("d")).select("unit", (F.col("often") + seldom).alias("other"))
    # Copies of a unit are counted with it.
    facts = facts.groupBy("unit").agg(F.count("*").alias("copies"), F.min("other").alias("other"))
    tf = found.select("unit", F.explode(F.filter("words", lambda x: x.isin(own))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    w = tf.join(F.broadcast(of_models.select("term", "idf").distinct()), "term").select("unit", "term", (F.col("tf") * F.col("idf")).alias("w"))
    weights = w.groupBy("unit").agg(F.sum(F.col("w") * F.col("w")).alias("squares"), F.collect_list(F.struct("term", "w")).alias("shared"))  # at most the templates' words
    norm = F.sqrt(F.col("squares") + F.col("other") * F.col("copies") * F.col("copies"))
    lengths = of_models.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    m = F.broadcast(of_models.join(lengths, "template").select("template", "term", (F.col("v") / F.col("length")).alias("v")))
    dots = weights.join(facts, "unit").select("unit", norm.alias("norm"), F.inline("shared")).join(m, "term")
    near = dots.groupBy("unit", "norm", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot")).where(F.col("dot") >= F.col("norm") * (LEAST_COSINE * (1 - 1e-6)))
    return pointed(near.select("unit").distinct())


def best_templates(found: DataFrame, models: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """(unit, license, cosine) of every distinct unit that is near enough to a template. Equal texts are one unit."""
    each = found.select("unit", "words").dropDuplicates(["unit"])
    tf = each.select("unit", F.explode("words").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    tf_models = models.select("template", "license", F.explode("words").alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    needed = tf.select("term").union(tf_models.select("term")).distinct()
    idf = F.log(F.lit(float(n + 1)) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    terms = pointed(needed.join(df, "term", "left").select("term", idf.alias("idf")))
    own = [r.term for r in tf_models.select("term").distinct().collect()]  # the words of the templates above
    released(spark := found.sparkSession)
    w = attached(tf, terms, "term").select("unit", "term", (F.col("tf") * F.col("idf")).alias("w"))
    shared = F.when(F.col("term").isin(own), F.struct("term", "w"))
    weights = pointed(w.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(shared).alias("shared")))  # at most the templates' words
    released(spark)
    of_models = tf_models.join(terms, "term").select("template", "license", "term", (F.col("tf") * F.col("idf")).alias("v"))
    lengths = of_models.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    m = F.broadcast(pointed(of_models.join(lengths, "template")))  # the words of the templates above
    dots = weights.select("unit", F.inline("shared")).join(m, "term").groupBy("unit", "license", "template", "length").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(weights.select("unit", "norm"), "unit").select("unit", "license", F.round(F.col("dot") / F.col("norm") / F.col("length"), 9).alias("cosine"))
    scored = scored.where(F.col("cosine") >= LEAST_COSINE)
    best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return pointed(best.select("unit", "b.license", (-F.col("b.c")).alias("cosine")))


def parent(path):
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def scan(files: DataFrame) -> DataFrame:
    """doc_id, path, license, origin (header, file, inherited or none), cosine and directory of the licence file, of every file (doc_id, path, text)."""
    spark = files.sparkSession
    files = files.select("doc_id", "path", "text")
    models = pointed(templates(spark))
    n = files.count()
    df = written(frequencies(files), "frequencies")
    lines = line_terms(files, [r.term for r in models.select(F.explode("words").alias("term")).distinct().collect()])  # fixed texts bound these
    found = units(files, lines, telling_terms(models, df, n, lines), weight_shares(models, df, n)).withColumn("unit", F.xxhash64(F.array_sort("words"), F.size("words")))
    found = written(found, "units")
    released(spark, lines)
    near = reaching(found, models, df, n)
    best = best_templates(attached(found, near, "unit"), models, df, n)
    hits = attached(found.select("doc_id", "path", "scope", "unit"), best, "unit")
    own = hits.groupBy("doc_id", "path").agg(F.min(F.struct("scope", (-F.col("cosine")).alias("c"), "license")).alias("b"))
    own = pointed(own.select("doc_id", "path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), (F.col("b.scope") == 0).alias("is_file")))
    o = own.withColumnsRenamed({"doc_id": "of", "path": "of_path"})
    rows = attached(files.select("doc_id", "path"), o, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("path").eqNullSafe(F.col("of_path")), "left")
    rows = rows.select("doc_id", "path", parent(F.col("path")).alias("dir"), "license", "cosine", F.coalesce("is_file", F.lit(False)).alias("is_file"))
    rows = written(rows, "files")
    declared = rows.where("is_file").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("from_license"), (-F.col("b.c")).alias("from_cosine"))
    parts = F.split("dir", "/")
    dirs = rows.where("license is null").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))).alias("a")).select("dir", "a.depth", "a.above")
    nearest = attached(above, pointed(declared), "above").groupBy("dir").agg(F.max_by(F.struct("from_license", "from_cosine", "above"), "depth").alias("n"))
    nearest = pointed(nearest.select(F.col("dir").alias("of_dir"), "n.from_license", "n.from_cosine", "n.above"))
    out = attached(rows, nearest, (F.col("dir") == F.col("of_dir")) & F.col("license").isNull(), "left")
    origin = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("from_license").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("license", "from_license").alias("license"), origin.alias("origin"), F.coalesce("cosine", "from_cosine").alias("cosine"), F.when(F.col("is_file"), F.col("dir")).otherwise(F.col("above")).alias("licence_dir"))
