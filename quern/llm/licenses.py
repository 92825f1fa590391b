"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by path; native.

Comment marks at the beginning of lines are taken off. A header is a line, a paragraph (lines up to a blank one, joined) or a sentence of
a paragraph that has one of the anchor words, or the four words before and after a word of licence in it, wherever it stands in the whole text, so a wrapped notice is
compared as a whole and one inside a longer line by itself; of a file that is named like a licence the whole text is compared too.
Terms are weighted by count and by ln((1 + T) / (1 + df)) + 1 over the T templates. A file takes the licence of the
template with the largest cosine at or above ``least``; an SPDX tag with a known id counts as a cosine of 1. A file
without one takes that of the licence file in its nearest ancestor directory, its own directory first.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lower_ascii, materialise

#: Notices, paragraphs and titles of the licences, as their publishers word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal public domain license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: Ids of tags; those of the templates and one that shares its paragraphs with another.
SPDX = sorted({name for name, _ in TEMPLATES} | {"BSD-2-Clause"})
SPDX_TAG = r"spdx-license-identifier:[ \t]*([a-z0-9.-]+?)(?:-only|-or-later|\+)?(?:[^a-z0-9.+-]|$)"
ANCHORS = "licen[cs]e|copyright|spdx|permission|redistribut|free software|unencumbered"
MARKS = r"(?m)^[ \t]*(?://+|/?\*+/?|#+|--+|;+|%+|<!--)?[ \t]*"
AROUND = "(?:[^ ]+ ){0,4}[^ ]*licen[cs]e[^ ]*(?: [^ ]+){0,4}"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENSE_FILE = "(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
LEAST = 0.6


def template_weights() -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """(template, term, weight over the template's norm), idf of each template term, idf of a term in no template."""
    counts = []
    for _, text in TEMPLATES:
        terms = re.findall(TERM, text.lower())
        counts.append({t: terms.count(t) for t in terms})
    total = len(counts)
    idf = {t: math.log((1 + total) / (1 + sum(t in c for c in counts))) + 1 for c in counts for t in c}
    rows = []
    for k, c in enumerate(counts):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(k, t, n * idf[t] / norm) for t, n in c.items()]
    return rows, idf, math.log(1 + total) + 1


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def own_licenses(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(path, text_hash, own_license, own_score) of the files (path, text) that match a template."""
    spark = files.sparkSession
    weighted, idf, other = template_weights()
    # Constants of the program: a few hundred rows, whatever the input.
    weights = F.broadcast(spark.createDataFrame(weighted, "template int, term string, w double"))
    idfs = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    low = F.regexp_replace(lower_ascii(F.coalesce("text", F.lit(""))), MARKS, "")
    has = lambda x: x.rlike(ANCHORS)
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE)
    rows = files.select("path", F.xxhash64("text").alias("text_hash"), low.alias("low"), named.alias("named")).filter(has(F.col("low")))
    rows = rows.withColumn("paragraphs", F.transform(F.filter(F.split("low", "\n\n+"), has), lambda x: F.translate(x, "\n", " ")))
    sentences = F.filter(F.flatten(F.transform("paragraphs", lambda x: F.split(x, "[.!?] +"))), has)
    rows = rows.withColumn("sentences", sentences)
    around = F.flatten(F.transform("sentences", lambda x: F.regexp_extract_all(x, F.lit(AROUND), F.lit(0))))
    blocks = F.concat(F.filter(F.split("low", "\n"), has), "paragraphs", "sentences", around, F.when(F.col("named"), F.array("low")).otherwise(F.array().cast("array<string>")))
    tag = F.regexp_extract("low", SPDX_TAG, 1)
    known = F.create_map(*[F.lit(x) for name in SPDX for x in (name.lower(), name)])
    rows = rows.select("path", "text_hash", F.array_distinct(blocks).alias("blocks"), F.element_at(known, tag).alias("tagged"))
    blocks = rows.select("path", "text_hash", F.posexplode("blocks").alias("block", "body"))
    tagged = rows.filter("tagged is not null").select("path", "text_hash", F.col("tagged").alias("name"), F.lit(1.0).alias("score")).distinct()
    terms = blocks.select("path", "text_hash", "block", F.explode(F.regexp_extract_all("body", F.lit(TERM), F.lit(0))).alias("term"))
    key = ["path", "text_hash", "block"]
    # A repeated row doubles all counts of its blocks, which leaves cosines as they are.
    tf = terms.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf")).join(idfs, "term", "left")
    tf = materialise(tf.withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other))).select(*key, "term", "x"), "license-terms")
    norms = tf.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = tf.join(weights, "term").groupBy(*key, "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    same = F.col("d.path").eqNullSafe(F.col("n.path")) & (F.col("d.text_hash") == F.col("n.text_hash")) & (F.col("d.block") == F.col("n.block"))
    scored = dots.alias("d").join(norms.alias("n"), same).select("d.path", "d.text_hash", F.round(F.col("dot") / F.col("norm"), 6).alias("score"), F.get(names, F.col("template")).alias("name"))
    best = scored.unionByName(tagged).groupBy("path", "text_hash", "name").agg(F.max("score").alias("score")).filter(F.col("score") >= least)
    top = best.groupBy("path", "text_hash").agg(F.max("score").alias("own_score"))
    best, top = best.alias("b"), top.alias("t")
    same = F.col("b.path").eqNullSafe(F.col("t.path")) & (F.col("b.text_hash") == F.col("t.text_hash")) & (F.col("b.score") == F.col("t.own_score"))
    return best.join(top, same).groupBy(F.col("b.path").alias("path"), F.col("b.text_hash").alias("text_hash")).agg(F.min("name").alias("own_license"), F.max("own_score").alias("own_score"))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """Every row of ``files`` with own_license, own_score, license and license_from (the directory inherited from).

    Ties between licences go to the first name. Null texts and empty ones have no licence of their own; a null path is
    a file in no directory and inherits nothing. Repeated rows get equal results; an empty input gives no rows.
    Directories are joined once each before files are, so a directory with very many files costs no more than another.
    """
    plain = files.drop("own_license", "own_score", "license", "license_from").withColumn("__hash", F.xxhash64("text"))
    own = materialise(own_licenses(files.select("path", "text"), least), "own-licenses")
    granted = own.filter(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE)).withColumn("dir", _dir(F.col("path")))
    granted = granted.groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("own_score"), "path", "own_license")).alias("license"))
    granted = materialise(granted, "licensed-dirs")
    dirs = files.select(_dir(F.col("path")).alias("dir")).filter("dir is not null").distinct()
    # The directory itself and every ancestor, by the number of its names; '' is the root.
    names = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = dirs.withColumn("names", names).select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("names")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("names", F.lit(1), n), "/").alias("up")))).alias("a"))
    above = above.select("dir", "a.depth", "a.up").join(granted.withColumnRenamed("dir", "up"), "up")
    nearest = above.groupBy("dir").agg(F.max_by(F.struct("license", "up"), "depth").alias("g"))
    nearest = materialise(nearest.select("dir", F.col("g.license").alias("__license"), F.col("g.up").alias("__up")), "nearest-licenses")
    own = own.select(F.col("path").alias("__path"), F.col("text_hash").alias("__text"), "own_license", "own_score")
    found = plain.join(own, F.col("path").eqNullSafe(F.col("__path")) & (F.col("__hash") == F.col("__text")), "left")
    found = found.withColumn("__dir", _dir(F.col("path"))).join(nearest.withColumnRenamed("dir", "__of"), F.col("__dir") == F.col("__of"), "left")
    return (
        found.withColumn("license", F.coalesce("own_license", "__license"))
        .withColumn("license_from", F.when(F.col("own_license").isNull(), F.col("__up")))
        .drop("__hash", "__path", "__text", "__dir", "__of", "__license", "__up")
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source / thousands / hundreds / name; ids divisible by 100, 1000 and 10000 name licence files of these levels."""
    by = lambda n: F.col("doc_id") % n == 0
    root = F.coalesce("source", F.lit("unknown"))
    k, j = F.expr("doc_id div 1000"), F.expr("doc_id div 100 % 10")
    path = (
        F.when(by(10_000), F.concat_ws("/", root, F.lit("LICENSE")))
        .when(by(1000), F.concat_ws("/", root, k, F.lit("LICENSE")))
        .when(by(100), F.concat_ws("/", root, k, j, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", root, k, j, F.concat(F.lit("f"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, path, own_license, own_score, license, license_from."""
    return scan(document_paths(documents(spark, sf_dir)).select("doc_id", "path", "text")).drop("text")
