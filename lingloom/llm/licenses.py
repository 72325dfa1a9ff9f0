"""Operator 4: licences by sparse TF-IDF cosine to templates, inherited along directories, in DataFrame functions only.

A line of a file that has a licence word is a candidate header, and so is each window of terms around a licence word,
across line breaks, that is as long as a template: headers share lines with other text and are wrapped. A candidate's
terms meet the templates' terms (a fixed table of a few hundred rows) in a join; products add up to the cosine. Headers
that reach `least` give the file a licence of its own; a reservation of rights gives way to a licence. A licence file, by
its name or because most of its terms are ones of full licence texts, is compared with those as a whole as well: one
vector of all of its terms. A file that is a full text, that is named as a licence file or most of whose words are in
headers licenses its directory; a file
without a licence takes the one of its nearest ancestor directory that has one: each file's ancestor paths meet the
table of licensed directories in an equi-join, and the deepest wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import saved

RESERVED = "LicenseRef-all-rights-reserved"
#: Headers and titles by which public licences are recognised.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    (RESERVED, "All rights reserved."),
]
#: Full texts of short public licences; longer ones can be handed to scan_licenses.
FULL_TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]
#: A table of directories up to this size goes to the tasks as a broadcast (its measured size); beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
LICENCE_WORD = r"(?i)licen[sc]|copyright|rights[\W_]+reserved|spdx|permission[\W_]+is[\W_]+hereby|redistribution[\W_]+and[\W_]+use|public[\W_]+domain|\bcc0\b"
#: The same on terms: a term, and terms that follow one another.
LICENCE_TERM, LICENCE_TERMS = r"licen[sc]|copyright|spdx|^cc0$", [("rights", "reserved"), ("permission", "is", "hereby"), ("redistribution", "and", "use"), ("public", "domain")]
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense|notice|copyright)([._-].*)?$"


def terms_of(line: Column) -> Column:
    """Lower-case terms; a version number is one term."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[0-9]+(?:\.[0-9]+)+|[\p{L}\p{N}]+"), F.lit(0))


def template_weights(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, license, size, term, weight, idf), size in terms: unit vectors of the templates, a few hundred rows whatever the corpus."""
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(templates)], "template int, license string, line string")
    counts = rows.select("template", "license", F.explode(terms_of(F.col("line"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    idf = counts.groupBy("term").agg((1 + F.log(F.lit(float(len(templates))) / F.count_distinct("template"))).alias("idf"))
    raw = counts.join(F.broadcast(idf), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(F.broadcast(norm), "template").join(F.broadcast(counts.groupBy("template").agg(F.sum("tf").cast("int").alias("size"))), "template").select("template", "license", "size", "term", (F.col("w") / F.col("norm")).alias("weight"), "idf")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def windows_of(files: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of terms around the licence words of files(path, text): (path, at, context) for each word, context an id
    of the terms around it, at the place of its first term; and (context, first, key, terms) for each window of a context.

    Windows are as long as a template and hold the word; equal contexts have theirs once.
    """
    lengths = sorted(r["size"] for r in weights.select("size").distinct().collect())  # a few numbers, from the templates
    most = lengths[-1]
    rows = files.where(F.col("text").rlike(LICENCE_WORD)).select("path", terms_of(F.col("text")).alias("t"))
    is_word = lambda x, k: x.rlike(LICENCE_TERM) | _any([F.coalesce(F.slice("t", k + 1, len(w)) == F.array(*map(F.lit, w)), F.lit(False)) for w in LICENCE_TERMS])
    places = F.filter(F.transform("t", lambda x, k: F.when(is_word(x, k), k)), lambda k: k.isNotNull())
    start = F.greatest(F.col("k") - (most - 1), F.lit(0))
    met = rows.select("path", "t", F.explode(places).alias("k")).select("path", start.alias("at"), (F.col("k") - start).alias("k"), F.slice("t", start + 1, F.col("k") - start + most).alias("t"))
    met = saved(met.withColumn("context", F.xxhash64("k", "t")))
    n = F.size("t")
    low = lambda size: F.greatest(F.col("k") - (size - 1), F.lit(0))
    starts = lambda size: F.transform(F.sequence(low(size), F.greatest(F.least(F.col("k"), n - size), low(size))), lambda s: F.struct(s.alias("first"), F.lit(size).alias("size")))
    each = met.select("context", "k", "t").dropDuplicates(["context"]).select("context", "t", F.explode(F.concat(*map(starts, lengths))).alias("w"))
    each = each.select("context", "w.first", "w.size", F.slice("t", F.col("w.first") + 1, F.col("w.size")).alias("terms"))
    return met.select("path", "at", "context"), each.withColumn("key", F.xxhash64("size", "terms"))


def full_text_scores(rows: DataFrame, texts: list[tuple[str, str]], least: float, unknown_idf: float, share: float = 0.5) -> DataFrame:
    """(path, f struct<reserved, minus, license>): the licence whose full text a licence file of rows(path, text) is most
    like, as a whole, with a cosine of `least` at least; minus is the negative score.

    Licence files are those so named, and those with a licence word `share` of whose terms are ones of the texts.
    """
    spark = rows.sparkSession
    weights = F.broadcast(saved(template_weights(spark, texts)))
    vocabulary = [r["term"] for r in weights.select("term").distinct().collect()]  # the texts' own
    terms = terms_of(F.col("text"))
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE)
    held = rows.where(named | F.col("text").rlike(LICENCE_WORD)).select("path", terms.alias("t"), named.alias("named"))
    known = F.size(F.filter("t", lambda x: x.isin(vocabulary)))
    files = held.where((F.size("t") > 0) & (F.col("named") | (known >= share * F.size("t"))))
    tf = saved(files.select("path", F.explode("t").alias("term")).groupBy("path", "term").agg((1 + F.log(F.count("*"))).alias("tf")))
    idf = F.broadcast(weights.select("term", "idf").distinct())
    norm = tf.join(idf, "term", "left").groupBy("path").agg(F.sqrt(F.sum((F.col("tf") * F.coalesce("idf", F.lit(unknown_idf))) ** 2)).alias("norm"))
    dots = tf.join(weights, "term").groupBy("path", "template", "license").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    scored = dots.join(norm, "path").select("path", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    order = F.struct((F.col("license") == RESERVED).alias("reserved"), (-F.col("score")).alias("minus"), "license")
    return scored.groupBy("path").agg(F.min(order).alias("f"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, texts: list[tuple[str, str]] = FULL_TEXTS, least: float = 0.6, least_text: float = 0.8, file_share: float = 0.5, unknown_idf: float = 2.0) -> DataFrame:
    """(path, own_license, own_score, license, license_path, distance) for each path of files.

    own_license comes from the file's own best header or from the full text that it is, whichever scores higher (a
    licence before a reservation of rights; ties: the licence first in the alphabet), null without one.
    license is that, or the nearest licensed ancestor directory's: then license_path is the licence file and distance
    the directories between. Several licence files in one directory: the highest score, then the smallest path. A
    term that no template has weighs `unknown_idf` in the header's length. Null paths are left out, a null text has no
    header, and rows that repeat a path count as one file.
    """
    spark = files.sparkSession
    weights = F.broadcast(saved(template_weights(spark, templates)))
    rows = files.where(F.col(path_col).isNotNull()).select(F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = rows.select("path", F.size(terms_of(F.col("text"))).alias("n_terms"), F.explode_outer(F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(LICENCE_WORD)))).alias("line"))
    lines = saved(lines.withColumn("key", F.xxhash64("line")))

    # equal lines and equal windows are scored once; a window meets the templates of its length only
    places, windows = windows_of(rows.dropDuplicates(["path", "text"]), weights)
    windows = saved(windows)
    heads = lines.where("line is not null").select("key", F.lit(0).alias("size"), terms_of(F.col("line")).alias("terms"))
    heads = heads.unionByName(windows.select("key", "size", "terms")).dropDuplicates(["key", "size"])
    tf = saved(heads.select("key", "size", F.explode("terms").alias("term")).groupBy("key", "size", "term").agg((1 + F.log(F.count("*"))).alias("tf")))
    idf = F.broadcast(weights.select("term", "idf").distinct())
    length = tf.join(idf, "term", "left").groupBy("key", "size").agg(F.sqrt(F.sum((F.col("tf") * F.coalesce("idf", F.lit(unknown_idf))) ** 2)).alias("norm"))
    of = weights.withColumnRenamed("size", "of_size")
    dots = tf.join(of, "term").where("size = 0 or size = of_size").groupBy("key", "size", "template", "license").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    scored = dots.join(length, ["key", "size"]).select("key", "size", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    order = F.struct((F.col("license") == RESERVED).alias("reserved"), (-F.col("score")).alias("minus"), "license")
    best = saved(scored.groupBy("key", "size").agg(F.min(order).alias("b")).select("key", "size", "b"))

    of_lines = lines.join(best.where("size = 0").select("key", "b"), "key", "left")
    by_line = of_lines.groupBy("path").agg(F.min("b").alias("b"), F.sum(F.when(F.col("b").isNotNull(), F.size(terms_of(F.col("line")))).otherwise(0)).alias("in_lines"), F.max("n_terms").alias("n_terms"))
    hits = windows.join(best.where("size > 0"), ["key", "size"]).select("context", "first", "size", "b")
    ranges = places.join(hits, "context").select("path", "b", F.explode(F.sequence(F.col("at") + F.col("first"), F.col("at") + F.col("first") + F.col("size") - 1)).alias("place"))
    by_window = ranges.groupBy("path", "place").agg(F.min("b").alias("b")).groupBy("path").agg(F.min("b").alias("w"), F.count("*").alias("in_windows"))
    own = by_line.join(by_window, "path", "left").join(full_text_scores(rows, texts, least_text, unknown_idf), "path", "left")
    own = own.select("path", "n_terms", F.col("f").isNotNull().alias("whole"), F.least("b", "w", "f").alias("b"), F.greatest("in_lines", F.coalesce("in_windows", F.lit(0))).alias("in_headers"))
    own = saved(own.select("path", F.col("b.license").alias("own_license"), (-F.col("b.minus")).alias("own_score"), (F.col("whole") | (F.col("n_terms") > 0) & (F.col("in_headers") >= file_share * F.col("n_terms"))).alias("mostly")))

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    giving = own.where("own_license is not null").where(F.col("mostly") | name.rlike(LICENCE_FILE))
    by_dir = giving.groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("own_score")).alias("minus"), "path", "own_license")).alias("g")).select("dir", F.col("g.path").alias("license_path"), F.col("g.own_license").alias("dir_license"))

    parts = F.split(directory(F.col("path")), "/")
    depth = F.size(parts)
    up = F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("distance"), F.array_join(F.slice(parts, F.lit(1), depth - k), "/").alias("dir")))
    # a directory that many files share is asked for once: files meet their directory's answer afterwards
    dirs = own.where("own_license is null").select(directory(F.col("path")).alias("of"), parts.alias("_p"), up.alias("up")).dropDuplicates(["of"])
    asked = dirs.select("of", F.explode("up").alias("u")).select("of", "u.distance", "u.dir").distinct()
    found = saved(asked.join(by_dir, "dir").groupBy("of").agg(F.min(F.struct("distance", "license_path", "dir_license")).alias("f")).select("of", "f.*"))
    size = found.agg(F.sum(F.length("of") + F.length("license_path") + 64)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found  # a directory of very many files costs no shuffle
    out = own.withColumn("of", directory(F.col("path"))).join(found, "of", "left")
    has = F.col("own_license").isNotNull()
    return out.select(
        F.col("path").alias(path_col),
        "own_license",
        "own_score",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(has, F.col("path")).otherwise(F.col("license_path")).alias("license_path"),
        F.when(has, F.lit(0)).otherwise(F.col("distance")).cast("int").alias("distance"),
    )
