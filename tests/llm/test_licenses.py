"""Licence scans on notices as files have them, written out by hand."""

import duckdb
import pytest

from editspark.llm import licenses, queries
from editspark.llm.notices import TEMPLATES

SMALL = "/root/testdata/sf0.001"


def commented(text, mark):
    return "".join(f"{mark}{' ' if line else ''}{line}\n" for line in text.split("\n"))


GPL = """This program is free software{a} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{b} either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Copyright 2019 Some Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2021 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright (c) 2015, The Project
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """ISC License

Copyright (c) 2020, A. Writer

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
GNU_OPENING = """                    GNU GENERAL PUBLIC LICENSE
                       {version}

 Copyright (C) {year} Free Software Foundation, Inc.{where}
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  {preamble}
"""
MORE = """
  When we speak of free software, we are referring to freedom, not
price.  Our General Public Licenses are designed to make sure that you
have the freedom to distribute copies of free software (and charge for
them if you wish), that you receive source code or can get it if you
want it, that you can change the software or use pieces of it in new
free programs, and that you know you can do these things.
""" * 30
CODE = "\nimport os\n\n\ndef run(x):\n    return os.path.join(x, 'y')\n" * 20

GOLDEN = [
    ("GPL-3.0", commented(GPL.format(a=":", b=",", v=3), "#") + CODE),
    ("GPL-2.0", commented(GPL.format(a=";", b=";", v=2), " *") + CODE),
    ("GPL-2.0", "/*\n" + commented("A driver for things.\n\n" + GPL.format(a=";", b=";", v=2), " *") + " */" + CODE),
    ("GPL-2.0", "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.\n */\n" + CODE),
    ("LGPL-2.1", commented(LGPL, "//") + CODE),
    ("LGPL-3.0", commented(LGPL.replace("2.1", "3"), ";;") + CODE),
    ("AGPL-3.0", commented(AGPL, "#") + CODE),
    ("MPL-2.0", commented(MPL, "//") + CODE),
    ("MPL-2.0", "/* " + MPL + " */" + CODE),
    ("Apache-2.0", commented(APACHE, "#") + CODE),
    ("Apache-2.0", "/*\n" + commented(APACHE, " *") + " */\npackage x;" + CODE),
    ("Apache-2.0", "<!--\n" + APACHE + "\n-->\n<x/>"),
    ("MIT", MIT),
    ("MIT", commented(MIT, "#") + CODE),
    ("MIT", MIT.split("\n\n", 2)[2]),
    ("BSD-2-Clause", BSD.format(third="")),
    ("BSD-3-Clause", BSD.format(third=THIRD)),
    ("BSD-2-Clause", commented(BSD.format(third=""), "//") + CODE),
    ("BSD-3-Clause", "/*\n" + commented(BSD.format(third=THIRD), " *") + " */" + CODE),
    ("ISC", ISC),
    ("Unlicense", UNLICENSE),
    ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\n" + CODE),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only\n/* Copyright. All rights reserved. */\n" + CODE),
    ("MIT", "# SPDX-License-Identifier: (MIT OR Apache-2.0)\n" + CODE),
    ("GPL-3.0", GNU_OPENING.format(version="Version 3, 29 June 2007", year=2007, where=" <https://fsf.org/>", preamble="The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.") + MORE),
    ("GPL-2.0", GNU_OPENING.format(version="Version 2, June 1991", year="1989, 1991", where="\n 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", preamble="The licenses for most software are designed to take away your\nfreedom to share and change it.") + MORE),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n" + "      other words follow here\n" * 600),
    ("BSL-1.0", "//  Copyright Some One 2003.\n//  Distributed under the Boost Software License, Version 1.0.\n//  (See accompanying file LICENSE_1_0.txt or copy at\n//  http://www.boost.org/LICENSE_1_0.txt)\n" + CODE),
    ("CC0-1.0", "To the extent possible under law this is under the Creative Commons CC0 1.0 Universal Public Domain Dedication.\n"),
    ("Proprietary", "# Copyright 2020 Some Company. All rights reserved.\n" + CODE),
    (None, CODE), (None, "Prose about a driving licence and the licensing of taverns, with no notice in it at all, whatever the words suggest."), (None, ""), (None, None),
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    return con


def test_notices_as_files_have_them(spark):
    rows = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(GOLDEN)], "path int, text string").withColumn("path", licenses.F.col("path").cast("string"))
    got = {int(r.path): (r.own_license, r.own_score) for r in licenses.scan(rows).collect()}
    wrong = [(expected, got[k], text[:120]) for k, (expected, text) in enumerate(GOLDEN) if got[k][0] != expected]
    assert not wrong


def test_goldens_equal_sql(spark, duck):
    rows = [(k * 3, text, "s") for k, (_, text) in enumerate(GOLDEN)]
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    expected = duck.sql(licenses.sql())
    got = licenses.of_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).select(*expected.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected.fetchall()))


def test_the_sample_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    expected = con.sql(queries.oracle_sql()["op3_licenses"])
    got = queries.op3_licenses(spark, SMALL).select(*expected.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected.fetchall()))


def test_templates_are_their_own_best_matches(spark):
    rows = spark.createDataFrame([(str(k), text) for k, (_, text) in enumerate(TEMPLATES)], "path string, text string")
    got = rows.select("path", licenses.best_match(licenses.F.col("text")).alias("best")).collect()
    assert {int(r.path): TEMPLATES[-r.best.order][0] for r in got} == {k: name for k, (name, _) in enumerate(TEMPLATES)}
    assert all(r.best.score >= 0.5 for r in got)


def test_inheritance(spark):
    files = [
        ("a/LICENSE", MIT), ("a/x.py", "code"), ("a/b/y.py", "code"), ("a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/z.py", None),
        ("a/b/c/d/own.py", "# Copyright. All rights reserved\nmore"), ("ab/q.py", "code"), ("r.py", "We licensed nothing in long prose without any likeness to notices at all, really"), (None, ""),
        ("a/LICENSE.2", "Released under the MIT License."), ("a/x.py", "code"),
    ]
    df = spark.createDataFrame([(*f, 0.5, "d", 7, "l") for f in files], "path string, text string, best double, dir string, nearest int, license string")
    scanned = licenses.scan(df)
    rows = licenses.inherit(scanned, scanned.path.contains("/LICENSE")).collect()
    assert len(rows) == len(files) and all((r.best, r.dir, r.nearest) == (0.5, "d", 7) for r in rows)
    got = {r.path: (r.license, r.origin, r.inherited_from) for r in rows}
    assert got["a/LICENSE"][:2] == ("MIT", "own")
    assert got["a/x.py"] == got["a/b/y.py"] == ("MIT", "inherited", "a")
    assert got["a/b/c/z.py"] == ("Apache-2.0", "inherited", "a/b/c")
    assert got["a/b/c/d/own.py"][:2] == ("Proprietary", "own")
    assert got["ab/q.py"] == got["r.py"] == got[None] == (None, "none", None)
    assert licenses.inherit(licenses.scan(df.limit(0)), licenses.F.lit(True)).count() == 0
    plan = licenses.of_documents(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_texts_are_scanned(spark):
    late = "filler line\n" * 20_000 + "Licensed under CC BY-NC 4.0.\n" + "more\n" * 9
    got = licenses.scan(spark.createDataFrame([("p", late), ("q", "x" * 50_000 + " licence " + "y" * 50_000)], "path string, text string")).collect()
    assert {r.path: r.own_license for r in got} == {"p": "CC-BY-NC-4.0", "q": None}
