"""License scans with DataFrame functions only.

Method: sentences of a text that may speak of a licence become sparse TF-IDF vectors (a row a word) and are compared by cosine to the
templates of known notices and file headers; a text of any length that is a notice or a full licence text as a whole is a licence file.
Sentences are those of each line and those of each paragraph with its comment marks and line breaks taken out, so a header that is
broken over lines is one notice; blank lines end it. Files without a licence of their own inherit that
of the nearest ancestor directory with a licence file, by joining paths to the paths of their ancestors.

idf comes from the templates, the highest one for words that no template has, so a long sentence that only mentions a
licence scores low. Notices, headers and full texts (``license_texts/``) each have an idf of their own. The templates are fixed
tables, which is what gets broadcast. A full text outweighs the notices inside it, since licences mention one another.

Defined results: null or empty text has no licence; several licences in a text: the best-scored one is ``license``, all are in
``licenses``; licence files that differ in one directory are all inherited, in order; ties go to the first name; a null path
inherits nothing; repeated rows get the same result each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blank, join_groups, materialise, quoted, text_key

#: Usual notices of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
]
TRIGGER = r"(?i)licen[sc]e|copyright|public domain|rights reserved|free software|redistribut|permission is hereby|\bCC BY|\bCC0"
_WORD = r"[a-z0-9]+(?:\.[0-9]+)?"
#: Sentences of standard file headers that have more words than the notices above.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    *((f"{a}GPL-{v}.0", f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.")
      for a, name, what, v in [("", "", "program", 3), ("", "", "program", 2), ("A", "Affero ", "program", 3), ("L", "Lesser ", "library", 3)]),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]


@cache
def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the full licence texts."""
    found = [f for f in files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    return sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in found)


def vectors(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template number, licence, word, unit weight) rows, idf by word, idf of other words."""
    counts = [Counter(re.findall(_WORD, text.lower())) for _, text in templates]
    df = Counter(w for c in counts for w in c)
    other = math.log(1 + len(counts)) + 1
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for k, ((name, _), c) in enumerate(zip(templates, counts)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        rows += [(k, name, w, n * idf[w] / norm) for w, n in c.items()]
    return rows, idf, other


#: Comment marks at the start and end of lines.
_MARKS = r"(?im)^[ \t]*+(?://++[!/]?|#++|/?\*++/?|--++|;++|%++|<!--++|rem\b|dnl\b|\"{3}|'{3})?[ \t]*+(?=\S|$)|[ \t]*+(?:\*++/|--++>)?[ \t]*+$"


def _notices(text: Column) -> Column:
    """Sentences of the text's lines, paragraphs and sentences of paragraphs that may speak of a licence."""

    def sentences(parts: Column) -> Column:
        return F.flatten(F.transform(parts, lambda x: F.split(x, r"(?<=[.!?])\s+(?=\p{Lu})")))

    plain = F.regexp_replace(text, _MARKS, "")
    blocks = F.transform(F.split(plain, r"(?:\r\n?|\n)[ \t]*+(?:\r\n?|\n)\s*+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    blocks = F.filter(blocks, lambda x: x.rlike(TRIGGER))
    lines = F.array_distinct(F.concat(sentences(F.split(text, r"[\r\n]+")), sentences(blocks), blocks))
    return F.when(text.rlike(TRIGGER), F.filter(lines, lambda x: x.rlike(TRIGGER)))


def match(spark: SparkSession, texts: DataFrame, threshold: float, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """texts: (key, text), keys distinct. (key, license, score) of the templates at the threshold or over, best a licence."""
    rows, idf, other = vectors(templates)
    weights = F.broadcast(spark.createDataFrame(rows, "template int, license string, word string, weight double"))
    of_word = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))
    tf = texts.select("key", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("word")).groupBy("key", "word").count()
    tf = tf.join(of_word, "word", "left").select("key", "word", (F.col("count") * F.coalesce("idf", F.lit(other))).alias("w"))
    norm = tf.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = tf.join(weights, "word").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    # rounded, so that the order of sums decides no tie
    scored = dot.join(norm, "key").withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("score") >= threshold)
    return scored.groupBy("key", "license").agg(F.max("score").alias("score"))


def scan(docs: DataFrame, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, file_threshold: float = 0.85) -> DataFrame:
    """A row per document: doc_id, license, score, licenses, license_file, inherited, inherited_from, effective."""
    spark = docs.sparkSession
    text = blank(quoted(text_col).cast("string"))
    path = path if path is not None else F.lit(None).cast("string")
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), path.alias("path"), text.alias("text"))
    rows = rows.select(
        "doc_id", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).alias("dir"), _notices(F.col("text")).alias("notices"),
        F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias("whole"), text_key("text").alias("text_hash"),
    )
    rows = materialise(rows, "notices")
    # equal sentences and equal texts are compared once
    lines = rows.filter("notices is not null").select("text_hash", F.explode("notices").alias("text")).distinct()
    lines = materialise(lines.withColumn("key", text_key("text")), "license-lines")
    distinct = lines.select("key", "text").dropDuplicates(["key"])
    known = match(spark, distinct, threshold).unionByName(match(spark, distinct, threshold, HEADERS))
    # a sentence speaks of one licence, the nearest
    known = known.groupBy("key").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license"))).alias("x")).select("key", "x.*")
    own = lines.select("text_hash", "key").join(known, "key").groupBy("text_hash", "license").agg(F.max("score").alias("score"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))))
    own = own.groupBy("text_hash").agg(ranked.alias("all")).select("text_hash", F.col("all")[0]["l"].alias("license"), (-F.col("all")[0]["s"]).alias("score"), F.array_sort(F.transform("all", lambda x: x["l"])).alias("licenses"))
    whole = rows.filter("whole is not null").select(F.col("text_hash").alias("key"), F.col("whole").alias("text")).dropDuplicates(["key"])
    best = lambda found, name: found.groupBy("key").agg(F.min_by(F.struct(F.col("license").alias("l"), F.col("score").alias("s")), F.struct(-F.col("score"), F.col("license"))).alias(name))
    whole = materialise(whole, "license-wholes")
    files = best(match(spark, whole, file_threshold), "notice").join(best(match(spark, whole, file_threshold, full_texts()), "full"), "key", "full")
    sizes = rows.filter("notices is not null").groupBy("text_hash").agg(F.count("*").alias("copies"))
    found = sizes.join(own, "text_hash", "left").join(files.withColumnRenamed("key", "text_hash"), "text_hash", "left")
    is_full = F.col("full").isNotNull()
    found = found.select(
        "text_hash", "copies", F.coalesce("full.l", "license", "notice.l").alias("license"), F.coalesce("full.s", "score", "notice.s").alias("score"),
        F.when(is_full, F.array("full.l")).when(F.col("license").isNull() & F.col("notice").isNotNull(), F.array("notice.l")).otherwise(F.col("licenses")).alias("licenses"),
        F.coalesce("full.l", "notice.l").alias("file_license"),
    )
    found = materialise(found, "license-texts")
    out = join_groups(rows.select("doc_id", "dir", "text_hash"), found, "text_hash", "copies")
    out = materialise(out, "license-rows")

    # nearest ancestor: a row per distinct directory and ancestor, joined to directories with licence files
    holders = out.filter("file_license is not null and dir is not null").groupBy("dir").agg(F.array_join(F.array_sort(F.collect_set("file_license")), ",").alias("inherited"))
    dirs = out.filter("dir is not null").groupBy("dir").agg(F.count("*").alias("members"))
    parts = F.split("dir", "/")
    up = dirs.select("dir", "members", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("ancestor"))
    near = up.join(holders.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir", "members").agg(F.max_by(F.struct("ancestor", "inherited"), F.length("ancestor")).alias("x"))
    near = materialise(near.select("dir", "members", F.col("x.ancestor").alias("inherited_from"), F.col("x.inherited").alias("inherited")), "license-dirs")
    done = join_groups(out.drop("copies"), near, "dir", "members")
    return done.select(
        "doc_id", "license", "score", F.coalesce("licenses", F.expr("CAST(array() AS array<string>)")).alias("licenses"), F.col("file_license").isNotNull().alias("license_file"),
        "inherited", "inherited_from", F.coalesce("license", "inherited").alias("effective"),
    )
