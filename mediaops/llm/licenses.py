"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Only DataFrame expressions. A template of m shingles belongs to the class L, the least power of two that is at least m.
Windows of class L hold 2 L positions and begin every L, so any passage as long as a template of the class lies
whole in one of them. A window's set is all of its shingles, at most 2 L < 4 m. With containment c the Jaccard similarity
to the template is at least c / (5 - c), so one-row bands collide with probability 1 - (1 - c / (5 - c)) ** BANDS or more:
over 0.99998 for c = 0.8 and 54 bands. Containment is counted for the pairs that bands retrieve, and for no others.

Windows without one of a few long words (``anchors``), which every text that reaches a template holds, are not signed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.functions.frames import once
from mediaops.session import materialise

SHINGLE = 3
CONTAINMENT = 0.8
BANDS = 54
#: Templates that one scan takes, and their words in all; their shingles and bands are sent to every executor.
MAX_TEMPLATES, MAX_WORDS = 2000, 500_000

#: Notices by license. The wording of the public licenses and of usual notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "mit-line": "Released under the MIT License.",
    "mit-licensed-line": "Licensed under the MIT License.",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software.""",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsd-clauses": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """The hash of every run of SHINGLE words."""
    last = F.size(words) - F.lit(SHINGLE)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("array()").cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))


def template_words(text: str) -> list[str]:
    from re import findall

    return findall(r"[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which any text that reaches CONTAINMENT of a template holds at least one: without the shingles that
    have one of them, every template falls short. Long words are taken first, as they are rare elsewhere."""
    found: set[str] = set()
    for text in templates.values():
        words = template_words(text)
        shingles = set(zip(*(words[k:] for k in range(SHINGLE))))
        for word in sorted(set(words), key=lambda w: (w not in found, -len(w), w)):
            if sum(not found.intersection(s) for s in shingles) < CONTAINMENT * len(shingles):
                break
            found.add(word)
    return sorted(found)


def prepare(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license, m, width, hs``: the distinct shingles of each template; ``width`` is its class."""
    words = {name: template_words(text) for name, text in templates.items()}
    if len(templates) > MAX_TEMPLATES or sum(map(len, words.values())) > MAX_WORDS:
        raise ValueError(f"more than {MAX_TEMPLATES} templates or {MAX_WORDS} words")
    short = [name for name, own in words.items() if len(own) < SHINGLE]
    if short:
        raise ValueError(f"templates with fewer than {SHINGLE} words: {short}")
    named = spark.createDataFrame(list(templates.items()), "license string, text string")
    cut = named.select("license", _words(F.col("text")).alias("words"))
    listed = cut.select("license", F.array_distinct(_shingles(F.col("words"))).alias("hs"),
                        (F.size("words") - F.lit(SHINGLE - 1)).alias("length"))
    return listed.select("license", F.size("hs").alias("m"), F.expr("int(pow(2, ceil(log2(length))))").alias("width"), "hs")


def _bands(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, band, v``: the least value of each of BANDS hash functions over the shingles of a group."""
    least = [F.min(F.xxhash64(F.lit(b), "h")).alias(f"v{b}") for b in range(BANDS)]
    signed = rows.groupBy(*keys).agg(*least)
    return signed.select(*keys, F.posexplode(F.array(*(F.col(f"v{b}") for b in range(BANDS)))).alias("band", "v"))


def _windows(texts: DataFrame, widths: list[int], words: list[str]) -> DataFrame:
    """``key, id, width, low, hs``: the windows of each class that hold one of the words, with all their shingles in
    order; ``low`` is the number of the first."""
    # each step is a column of its own, made once per row: a lambda would make it anew for each element
    cut = once(texts.select("key", "text"), "words", _words(F.col("text"))).drop("text")
    marked = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(words))
    found = once(cut.where(F.size("words") >= SHINGLE), "marks", marked)
    hashed = once(found, "hs", _shingles(F.col("words"))).drop("words")
    classes = ", ".join(map(str, widths))
    lows = once(hashed, "wins", F.expr(f"""array_distinct(flatten(transform(array({classes}), w -> flatten(transform(marks, i ->
        transform(sequence(greatest(i - {SHINGLE - 1}, 0) div w - 1, i div w), k -> struct(w AS width, int(greatest(k, 0) * w) AS low)))))))"""))
    cut_out = lows.select("key", F.explode("wins").alias("win"), "hs").select(
        "key", F.monotonically_increasing_id().alias("id"), "win.width", "win.low", F.expr("slice(hs, win.low + 1, 2 * win.width)").alias("hs"))
    return cut_out


def scan(df: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, license, containment, first_word``: every template that a document holds.

    A template is found if one window holds at least CONTAINMENT of its distinct shingles. ``containment`` is the
    largest over the windows and ``first_word`` the number (from 0) of the first word of a found passage. Words are
    runs of ASCII letters and digits, in lower case. Null, empty and short texts hold nothing. Rows that repeat a key count
    once; texts that share a key are scanned apart. An empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    spark = df.sparkSession
    if not templates:
        return df.select(F.col(f"`{key}`").alias(key), F.lit("").alias("license"), F.lit(0.0).alias("containment"),
                         F.lit(0).alias("first_word")).where(F.lit(False))
    known = prepare(spark, templates)
    widths = sorted(r.width for r in known.select("width").distinct().collect())
    words = anchors(templates)
    needed = F.col("text").rlike("(?i)(?<![a-z0-9])(" + "|".join(words) + ")(?![a-z0-9])")
    texts = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where(needed)
    windows = materialise(_windows(texts, widths, words), "windows")
    signed = _bands(windows.select("id", "width", F.explode("hs").alias("h")), "id", "width")
    bands = _bands(known.select("license", "width", F.explode("hs").alias("h")), "license", "width")
    retrieved = signed.join(F.broadcast(bands), ["width", "band", "v"]).select("id", "license").distinct()
    # a template's shingles are bounded by MAX_WORDS
    pairs = windows.join(retrieved, "id").join(F.broadcast(known.withColumnRenamed("hs", "wanted")), ["license", "width"])
    counted = pairs.select("key", "license", "m", F.size(F.array_intersect("hs", "wanted")).alias("n"),
                           (F.col("low") + F.array_position(F.transform("hs", lambda h: F.array_contains("wanted", h)), True) - 1).alias("first"))
    return counted.where(F.col("n") >= CONTAINMENT * F.col("m")).groupBy("key", "license").agg(
        F.max(F.col("n") / F.col("m")).alias("containment"), F.min("first").cast("int").alias("first_word")).withColumnRenamed("key", key)
