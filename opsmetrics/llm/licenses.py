"""Licence texts in documents by MinHash bands over overlapping windows.

Templates are dealt into classes by length. For a class, windows of one and a
half times its size start every half size, so some window holds any occurrence
whole. Bands are chosen so that such a window shares a band with the template
with the target probability even at the least containment; matches are then
verified by the exact share of the template's shingles in the window. Only
DataFrame functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.llm.common import Shared, id_text, let

#: Short licence statements and the notices that licences ask to be used.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met:",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
)

_GNU = (
    "This {it} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name}General"
    " Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your"
    " option) any later version."
)


def _gnu(name: str, version: str, it: str = "program", colon: str = ":", comma: str = ",") -> str:
    return _GNU.format(it=it, colon=colon, name=name, comma=comma, version=version)


_MIT_GRANT = next(text for name, text in TEMPLATES if text.startswith("Permission is hereby granted"))
_ISC_GRANT = next(text for name, text in TEMPLATES if name == "ISC")
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT"
    " NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
    " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN"
    " THE SOFTWARE."
)
_ISC_REST = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL"
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN"
    " ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF"
    " THIS SOFTWARE."
)
TEMPLATES += (
    ("MIT", _MIT_GRANT + " " + _MIT_REST),
    ("MIT", _MIT_REST),
    ("ISC", _ISC_GRANT + " " + _ISC_REST),
    ("GPL-2.0", _gnu("", "2", colon=";")),
    ("GPL-2.0", _gnu("", "2")),
    ("LGPL-2.0", _gnu("Library ", "2", "library", ";", ";")),
    ("LGPL-2.1", _gnu("Lesser ", "2.1", "library", ";", ";")),
    ("LGPL-2.1", _gnu("Lesser ", "2.1", "library")),
    ("LGPL-2.1", _gnu("Lesser ", "2.1")),
    ("LGPL-3.0", _gnu("Lesser ", "3")),
    ("LGPL-3.0", _gnu("Lesser ", "3", "library")),
    ("AGPL-3.0", _gnu("Affero ", "3")),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,"
        " use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
        " purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
        " liable for any damages arising from the use of this software. Permission is granted to anyone to use this software"
        " for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the"
        " following restrictions:",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to"
        " this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
        " which is available at",
    ),
    (
        "EPL-1.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"
        " which accompanies this distribution, and is available at",
    ),
)

_SHINGLE = 3
_SMALLEST_CLASS = 8


def bands_for(similarity: float, recall: float) -> int:
    """Bands of one row that a pair of this similarity misses with probability ``1 - recall`` at most."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(similarity, 1 - 1e-12))))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """A hash of each ``_SHINGLE`` consecutive words."""

    def hashes(own: Column) -> Column:
        places = F.when(F.size(own) >= _SHINGLE, F.sequence(F.lit(0), F.size(own) - _SHINGLE))
        places = F.coalesce(places, F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*(F.get(own, i + k) for k in range(_SHINGLE))))

    return let(words, hashes)


def _low_hashes(shingles: Column, bands: int) -> Column:
    """The least value of each band's hash function over the shingles."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda band: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, band))),
    )


def template_frame(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """A row per template: its number, licence, distinct shingles and class (a power of two of words)."""
    own = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, body string")
    words = own.withColumn("words", _words(F.col("body")))
    size = F.greatest(F.pow(2.0, F.ceil(F.log2(F.size("words").cast("double")))).cast("int"), F.lit(_SMALLEST_CLASS))
    return words.where(F.size("words") >= _SHINGLE).select(
        "template", "license", F.array_distinct(_shingles(F.col("words"))).alias("shingles"), size.alias("class")
    )


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    containment: float = 0.8,
    recall: float = 0.9999,
) -> DataFrame:
    """A row per document and licence found: ``doc_id``, ``license``, ``containment``, ``n_windows``.

    ``containment`` is the largest share of a template's distinct shingles of three
    words that one window holds; shares under the parameter do not count, nor does
    a variant (another version of a licence) whose shingles all belong to a better
    match in the document. Case and punctuation do not count. Templates shorter than a shingle are ignored.

    A window that shares no shingle with any template shares no least hash with
    one either, so documents without a template shingle leave before windows
    are made: nothing is lost by that. A very long text is cut into windows over its
    whole length. Null and empty texts, and documents with
    no licence, give no row; rows that repeat an id count as one document; rows
    without id are reported under a null id; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    known = [  # as many rows as templates
        (r["template"], r["license"], r["shingles"], r["class"]) for r in template_frame(spark, templates).collect()
    ]
    if not known:
        return docs.select(docs[id_col].cast("long").alias("doc_id")).where("false").selectExpr(
            "doc_id", "cast(null as string) license", "cast(null as double) containment", "cast(null as long) n_windows"
        )
    every = sorted({s for _, _, own, _ in known for s in own})
    shared = Shared(spark, "licenses")
    words = id_text(docs, id_col, text_col).select("doc_id", _words(F.col("text")).alias("words"))
    hashed = words.select("doc_id", _shingles(F.col("words")).alias("shingles"))
    template_shingles = F.split(F.lit(",".join(map(str, every))), ",").cast("array<long>")  # folded to one literal
    some = shared.table(hashed.where(F.arrays_overlap("shingles", template_shingles)))

    windows, bands = [], []
    for size in sorted({c for *_, c in known}):
        own = [t for t in known if t[3] == size]
        length, stride = size + size // 2 - _SHINGLE + 1, size // 2  # in shingles
        least = min(len(t[2]) for t in own) * containment / length
        n_bands = bands_for(least, recall)
        starts = F.sequence(F.lit(0), F.greatest(F.size("shingles") - 1, F.lit(0)), F.lit(stride))
        cut = some.select("doc_id", F.posexplode(F.transform(starts, lambda s: F.slice("shingles", s + 1, F.lit(length))))).select(
            "doc_id", F.lit(size).alias("class"), F.col("pos").alias("window"), F.array_distinct("col").alias("shingles")
        )
        cut = cut.where(F.arrays_overlap("shingles", template_shingles))
        windows.append(cut.select("*", _low_hashes(F.col("shingles"), n_bands).alias("lows")))
        frame = spark.createDataFrame([(t[0], t[1], t[2], size) for t in own], "template int, license string, own array<long>, class int")
        bands.append(
            frame.select("template", "license", "own", "class", F.posexplode(_low_hashes(F.col("own"), n_bands)).alias("band", "low"))
        )
    index = reduce(DataFrame.unionAll, bands)
    met = reduce(DataFrame.unionAll, windows).select("doc_id", "class", "window", "shingles", F.posexplode("lows").alias("band", "low")).join(
        F.broadcast(index),  # templates times bands
        ["class", "band", "low"],
    )
    common = F.array_intersect("shingles", "own")
    share = F.size(common) / F.size("own")
    verified = shared.table(
        met.select("doc_id", "class", "window", "template", "license", "own", common.alias("common"), share.alias("share"))
        .where(F.col("share") >= containment)
        .distinct()
    )
    # a variant all of whose shingles belong to a better match in the document is that match
    mine = verified.alias("mine")
    better = verified.select("doc_id", "own", "share").distinct().alias("better")
    covered = (
        F.col("mine.doc_id").eqNullSafe(F.col("better.doc_id"))
        & (F.col("mine.share") < F.col("better.share"))
        & (F.size(F.array_except("mine.common", "better.own")) == 0)
    )
    return (
        mine.join(better, covered, "left_anti")
        .groupBy("doc_id", "license")
        .agg(F.max("share").alias("containment"), F.countDistinct("class", "window").alias("n_windows"))
    )
