import re
import textwrap

import duckdb

from tallyglass.llm import licenses as L

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(f"select doc_id, license, rule, n_sentences, n_known from ({L.ORACLE}) order by all").fetchall()
    got = sorted(tuple(r) for r in L.op6_license_scan(spark, SF).collect())
    assert got == want and want


def test_edges_and_order(spark):
    header = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n http://x\n'
    tail = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    rows = [(1, "x y. RELEASED under the MIT License.\nmore"), (2, header + tail), (3, tail + "\n" + header), (4, None), (5, ""), (1, "Released under the MIT License."), (None, "z. " * 50_000 + "Licensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, ids int, rule string")
    got = sorted((str(r.doc_id), r.rule) for r in L.scan(docs).collect())
    assert got == [("1", "mit-released"), ("1", "mit-released"), ("2", "apache2-header"), ("None", "ccbync4-notice")]
    assert L.scan(docs.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", L.scan(docs)._jdf.queryExecution().optimizedPlan().toString())


MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def test_wrapped_texts(spark):
    texts = {"mit": MIT, "apache": APACHE, "gpl3": GPL, "gpl2": GPL.replace("version 3", "version 2"), "bsd": BSD, "isc": ISC}
    want = {"mit": ["mit-text"], "apache": ["apache2-header"], "gpl3": ["gpl3-header"], "gpl2": ["gpl2-header"], "bsd": ["bsd2-text", "bsd3-text"], "isc": ["isc-text"]}
    rows = []
    for name, text in texts.items():
        for width in (20, 70, 80, 10_000):
            for sign, end in (("", "\n"), (" * ", "\n"), ("# ", "\r\n")):
                lines = [line for part in text.split("\n") for line in textwrap.wrap(part, width) or [""]]
                rows.append((name, "Head without a mark\n" + end.join((sign + line).rstrip() for line in lines) + "\nmore text"))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id, r.rule) for r in L.scan(docs).collect())
    # The Apache header's first line is a notice of its own where it breaks before (the "License").
    assert [x for x in got if x[1] != "apache2-licensed"] == sorted((name, rule) for name, rules in want.items() for rule in rules for _ in range(12))


def test_notices_among_lines(spark):
    rows = [
        (1, "Head\nReleased under the MIT License\nmore lines"),
        (2, "Licensed under the Apache License, Version 2.0\n(the \"License\"); you may"),
        (3, "This work is\nlicensed under the GNU General Public License,\nversion 3"),
        (4, "Released under\n\nthe MIT License"),
        (5, "Released under. the MIT License"),
        (6, "It is not Released under\nthe MIT License"),
        (7, "\n" * 100_000 + "Released under\nthe MIT License" + " \n-" * 100_000),
        (8, "Released \x01under\x02the MIT License"),
    ]
    got = sorted((r.doc_id, r.rule, r.n_known) for r in L.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert got == [(1, "mit-released", 1), (2, "apache2-licensed", 2), (3, "gpl3-licensed", 2), (3, "gpl3-work", 2), (7, "mit-released", 1), (8, "mit-released", 1)]
