"""Notices that an earlier list of licences took for others or did not know."""

from collections import defaultdict

from opsmetrics.llm import licenses

GNU = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the"
    " Free Software Foundation, either version {} of the License, or (at your option) any later version."
)


# 5
def test_notices_are_told_apart(spark):
    rows = [
        ("GPL-3.0", GNU.format("program", "General Public License", "3")),
        ("GPL-2.0", GNU.format("program", "General Public License", "2").replace(":", ";")),
        ("AGPL-3.0", GNU.format("program", "Affero General Public License", "3")),
        ("LGPL-3.0", GNU.format("program", "Lesser General Public License", "3")),
        ("LGPL-2.1", GNU.format("library", "Lesser General Public License", "2.1")),
        ("MIT", "The above copyright notice and this permission notice " + licenses._MIT_REST[len("The above copyright notice and this permission notice ") :]),
        ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ]
    docs = spark.createDataFrame([(i, f"words before\n{t}\nwords after") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = defaultdict(set)
    for r in licenses.scan_licenses(docs).collect():
        got[r["doc_id"]].add((r["license"], r["containment"]))
    assert got == {i: {(name, 1.0)} for i, (name, _) in enumerate(rows)}
