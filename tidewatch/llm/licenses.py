"""Licence scan with DataFrame functions: notices against templates by TF-IDF cosine, then inheritance by directory.

The notices of a file are its leading comment lines and each paragraph, if they hold a licence cue; only a file without a
licence by these is judged by its single lines with a cue. The notice of a licence file (by its name) is its whole text,
cue or not. Notices and templates are sparse vectors of terms (ASCII letters and digits in lower case), weighted by term
count times ``ln((1 + N) / (1 + df)) + 1`` over all notices. A file's own licence is the template with the highest cosine
of any of its notices, at least ``threshold``; ties go to the smaller name. A file without one inherits the licence of the
nearest directory above it for which one is declared.

Only different notices are compared with the templates, and only different directories look for their ancestors, so a
notice that millions of files repeat, or a directory that holds a third of them, is worked on once. A notice's text moves
once, to where its repetitions are counted; from there on a digest stands for it, as for each template.

Null and empty texts have no notice; a text without blank lines is one paragraph, however long; a null path has no
directory and inherits nothing; rows that repeat a path are judged together. Empty tables give empty results. Columns
other than those named are not read, and those in ``keep`` may have any name.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import config_table

CUE = "[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]|[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]|SPDX|[Pp]ublic [Dd]omain"
TERM = "[a-z0-9]+"
COMMENT = r"\A[ \t\f\r]*(//|#|/?\*|--|;|%|<!--|\"\"\"|'''|\z)"
PARAGRAPHS = r"\n[ \t\r]*\n"
LICENCE_FILE = "^(LICEN[CS]E|COPYING|UNLICENSE|NOTICE)([.-].*)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Notices that name a licence, as their authors recommend or as is usual.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy. The MIT License (MIT)"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("proprietary", "Copyright. All rights reserved."),
]

# Notices of several lines, as the licences' authors give them for the heads of files.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
     'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
     "the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Copyright The Authors. All rights reserved. Use of this source code is governed by a BSD-style "
     "license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} "
       f"as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later "
       "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
       "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
       f"{kind} for more details.")
      for name, kind, n in (("GPL-3.0", "General Public License", 3), ("GPL-2.0", "General Public License", 2),
                            ("LGPL-3.0", "Lesser General Public License", 3),
                            ("AGPL-3.0", "Affero General Public License", 3))),
]


def all_templates() -> list[tuple[str, str]]:
    """The one-line notices, headers of several lines and whole licence texts."""
    texts = [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    return [*TEMPLATES, *HEADERS, *texts]


def templates(spark: SparkSession) -> DataFrame:
    return config_table(spark, all_templates(), "licence string, template string")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def is_licence_file(path: Column) -> Column:
    return F.coalesce(F.regexp_replace(path, "^.*/", "").rlike(LICENCE_FILE), F.lit(False))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def notices(files: DataFrame, id: str, text: str) -> DataFrame:
    """One row (``id``, ``notice``, its ``key``, ``single``: a line that counts only without other notices) per notice."""
    whole, lines = F.col(text), F.split(F.col(text), "\n")
    cued = F.filter(lines, lambda line: line.rlike(CUE))
    code = F.array_position(F.transform(lines, lambda line: line.rlike(COMMENT)), False)
    head = F.array_join(F.slice(lines, F.lit(1), F.when(code > 0, code - 1).otherwise(F.size(lines)).cast("int")), "\n")
    runs = F.filter(F.concat(F.array(head), F.split(whole, PARAGRAPHS)), lambda run: run.rlike(CUE))
    marked = lambda found, single: F.transform(
        F.array_distinct(found), lambda x: F.struct(x.alias("notice"), F.lit(single).alias("single"))
    )
    named = is_licence_file(F.col(id))
    some = files.filter(whole.rlike(CUE) | (named & (whole != "")))
    found = F.when(named, marked(F.array(whole), False)).otherwise(F.concat(marked(runs, False), marked(cued, True)))
    rows = some.select(F.col(id).alias("id"), F.explode(found).alias("n"))
    return rows.select("id", "n.notice", "n.single", digest(F.col("n.notice")).alias("key"))


def score_notices(found: DataFrame, wanted: DataFrame, threshold: float) -> DataFrame:
    """Of each different notice its best template: ``key``, ``licence``, ``score`` (6 digits)."""
    counted = found.groupBy("key").agg(F.count("*").alias("n"), F.min("notice").alias("notice"))
    bag = counted.select("key", "n", F.explode(terms("notice")).alias("term"))
    tf = bag.groupBy("key", "n", "term").agg(F.count("*").alias("tf"))
    total = found.agg(F.count("*").alias("total"))
    df = tf.groupBy("term").agg(F.sum("n").alias("df"))
    ours = wanted.select("licence", digest(F.col("template")).alias("template"), F.explode(terms("template")).alias("term"))
    ours = ours.groupBy("licence", "template", "term").agg(F.count("*").alias("tf"))

    def weighted(bag: DataFrame) -> DataFrame:
        joined = bag.join(df, "term", "left").withColumn("total", total.scalar())
        idf = F.log((F.lit(1.0) + F.col("total")) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1
        return joined.withColumn("weight", F.col("tf") * idf).drop("df", "total", "tf")

    left, right = weighted(tf.drop("n")), weighted(ours)
    left_norm = left.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("left_norm"))
    right_norm = right.groupBy("licence", "template").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("right_norm")
    )
    dots = left.withColumnRenamed("weight", "w").join(right, "term").groupBy("key", "licence", "template")
    dots = dots.agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(left_norm, "key").join(right_norm, ["licence", "template"])
    scored = scored.select(
        "key", "licence", F.round(F.col("dot") / (F.col("left_norm") * F.col("right_norm")), 6).alias("score")
    )
    best = scored.filter(F.col("score") >= threshold).groupBy("key").agg(F.min(rank("score", "licence")).alias("b"))
    return best.select("key", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"))


def rank(score: str, licence: str) -> Column:
    """Smallest for the highest score, then the smallest name."""
    return F.struct((-F.col(score)).alias("minus"), F.col(licence).alias("licence"))


def own_licences(
    files: DataFrame,
    wanted: DataFrame,
    id: str = "path",
    text: str = "text",
    threshold: float = 0.5,
) -> DataFrame:
    """``id``, ``licence`` and ``score`` of the files (of all rows of an id) with a notice like a template. Files are
    known for licence files by ``id``."""
    seen = notices(files, id, text)
    found = seen.drop("notice").join(score_notices(seen, wanted, threshold), "key")
    first = F.struct("single", (-F.col("score")).alias("minus"), "licence")
    best = found.groupBy("id").agg(F.min(first).alias("b"))
    return best.select(F.col("id").alias(id), F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"))


def directory(path: Column) -> Column:
    """What stands before the last slash; null without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, down to the top ("" for the root of absolute paths)."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def declared_by_name(own: DataFrame, path: str = "path") -> DataFrame:
    """Directories with a licence file (by its name), and its licence: ``folder``, ``licence``."""
    files = own.filter(is_licence_file(F.col(path))).withColumn("folder", directory(F.col(path)))
    best = files.groupBy("folder").agg(F.min_by("licence", path).alias("licence"))
    return best.filter(F.col("folder").isNotNull())


def inherited(folders: DataFrame, declared: DataFrame) -> DataFrame:
    """For each different ``folder`` the nearest of it and its ancestors with a declared licence: ``folder``,
    ``licence``, ``licence_from``."""
    up = folders.select("folder").distinct().filter(F.col("folder").isNotNull())
    up = up.select("folder", F.posexplode(ancestors(F.col("folder"))).alias("depth", "licence_from"))
    found = up.join(declared.withColumnRenamed("folder", "licence_from"), "licence_from")
    near = found.groupBy("folder").agg(F.max_by(F.struct("licence", "licence_from"), "depth").alias("n"))
    return near.select("folder", "n.licence", "n.licence_from")


def scan(
    files: DataFrame,
    wanted: DataFrame,
    declared: DataFrame | None = None,
    path: str = "path",
    text: str = "text",
    threshold: float = 0.5,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per row of ``files``: the columns ``keep`` (the path), ``own_licence``, ``own_score``, ``licence`` (own or
    inherited) and ``licence_from`` (the directory it is inherited from). ``declared`` gives the licences of
    directories (``folder``, ``licence``); by default those of licence files."""
    own = own_licences(files, wanted, path, text, threshold)
    declared = declared_by_name(own, path) if declared is None else declared
    keep = keep or [path]
    rows = files.select(F.struct(*keep).alias("kept"), F.col(path).alias("path"))
    rows = rows.withColumn("folder", directory(F.col("path")))
    near = inherited(rows.select("folder"), declared).withColumnRenamed("licence", "near")
    own = own.select(F.col(path).alias("path"), F.col("licence").alias("own_licence"), F.col("score").alias("own_score"))
    out = rows.join(own, "path", "left").join(near, "folder", "left")
    return out.select(
        *[F.col("kept")[name].alias(name) for name in keep],
        "own_licence",
        "own_score",
        F.coalesce("own_licence", "near").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("licence_from")).alias("licence_from"),
    )
