from pyspark.sql import functions as F

from tidewatch.llm import licenses as L

ROWS = [
    ("/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ("/a/b/c/x.py", "no word about it"),
    ("/a/b/LICENSE.txt", "intro\nReleased under the MIT License.\n"),
    ("/a/y.py", "# Licensed under CC BY-NC 4.0.\ncode"),
    ("/a/z.py", ""),
    ("/d/e.py", None),
    ("/a/b", "a file where others have a directory"),
    (None, "Released under the MIT License."),
    ("top.py", "copyright of something else entirely with many other words in it"),
    ("/a/z.py", "twice"),
]


def test_own_and_inherited(spark):
    files = spark.createDataFrame([(*r, "x") for r in ROWS], "path string, text string, licence_from string")
    got = {(r.path, r.own_licence, r.licence, r.licence_from) for r in L.scan(files, L.templates(spark)).collect()}
    assert got == {
        ("/a/LICENSE", "Apache-2.0", "Apache-2.0", None),
        ("/a/b/c/x.py", None, "MIT", "/a/b"),
        ("/a/b/LICENSE.txt", "MIT", "MIT", None),
        ("/a/y.py", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        ("/a/z.py", None, "Apache-2.0", "/a"),
        ("/d/e.py", None, None, None),
        ("/a/b", None, "Apache-2.0", "/a"),
        (None, None, None, None),
        ("top.py", None, None, None),
    }
    assert L.scan(files, L.templates(spark)).count() == len(ROWS)


def test_empty_tables(spark):
    files = spark.createDataFrame(ROWS, "path string, text string")
    assert L.scan(files.limit(0), L.templates(spark)).count() == 0
    found = L.scan(files, L.templates(spark).limit(0)).collect()
    assert len(found) == len(ROWS) and all(r.licence is None for r in found)


def test_ties_take_the_smaller_name(spark):
    wanted = spark.createDataFrame([("B", "licence one"), ("A", "licence one")], "licence string, template string")
    files = spark.createDataFrame([("/p", "licence one")], "path string, text string")
    assert L.own_licences(files, wanted).first().licence == "A"


BSD = """Copyright (c) 2020 X. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE
DISCLAIMED."""
GO = """// Copyright 2009 The Go Authors. All rights reserved.
// Use of this source code is governed by a BSD-style
// license that can be found in the LICENSE file.

package main
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
int x;
"""


def test_whole_files_and_wrapped_headers(spark):
    gpl = (L.Path(L.__file__).parent / "licence_texts" / "GPL-3.0.txt").read_text()
    line = "many words of prose here " * 20 + "\nReleased under the MIT License.\n" + "and many other words " * 20
    rows = [("/b/LICENSE", BSD), ("/b/x.go", "package x"), ("/g/COPYING", gpl), ("/s/main.go", GO), ("/s/a.c", MPL)]
    files = spark.createDataFrame([*rows, ("/s/prose", line)], "path string, text string")
    got = {r.path: r.licence for r in L.scan(files, L.templates(spark)).collect()}
    assert got == {
        "/b/LICENSE": "BSD-3-Clause",
        "/b/x.go": "BSD-3-Clause",
        "/g/COPYING": "GPL-3.0",
        "/s/main.go": "BSD-3-Clause",
        "/s/a.c": "MPL-2.0",
        "/s/prose": "MIT",
    }


def test_odd_rows(spark, hard_docs, no_docs):
    """Repeated ids, nulls, and columns with the names that the scan uses."""
    docs = hard_docs.withColumn("folder", F.lit("f")).withColumn("near", F.lit("n")).withColumn("licence_from", F.lit("x"))
    docs = docs.drop("path").withColumn("path", F.concat(F.lit("/d/"), F.col("doc_id")))
    out = L.scan(docs, L.templates(spark), keep=["doc_id", "folder", "near"]).collect()
    assert len(out) == docs.count() and {(r.folder, r.near) for r in out} == {("f", "n")}
    assert L.scan(no_docs.withColumn("path", F.lit("/p")), L.templates(spark)).count() == 0


def test_a_paragraph_of_a_megabyte(spark):
    words = " ".join(f"word{i}" for i in range(110_000))
    rows = [("/a/long", f"{words} license"), ("/a/LICENSE", "Released under the MIT License."), ("/a/b", "x")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.own_licence, r.licence) for r in L.scan(files, L.templates(spark)).collect()}
    assert got == {"/a/long": (None, "MIT"), "/a/LICENSE": ("MIT", "MIT"), "/a/b": (None, "MIT")}
