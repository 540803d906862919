"""Licence scans by the Dice coefficient of word bigrams.

Each line and each paragraph of a text is normalised to words and compared to
licence templates.  With ``a`` and ``b`` bigrams, counted with repeats, the
coefficient is at most ``2 * min(a, b) / (a + b)``, so a unit is compared only to
templates whose size lies within the bounds that follow from the threshold.

A notice inside a longer line, or spread over lines and comment marks, is found by
the windows of a template's size over the words of the whole text.  The k-th place
of a bigram that the template has ``t`` times counts in the windows that hold it
but not the place ``t`` before it: an interval of window starts.  The overlap at a
start is the number of intervals over it, a running sum of their ends.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from settlespark.llm.batches import text_or_empty
from settlespark.llm.columns import MAX_BROADCAST_ROWS, row_key, small, words
from settlespark.plans.skew import freeze

THRESHOLD = 0.8
GAP = r"[^\p{L}\p{N}]+"
# a line without letters and digits is blank, so that comment marks do not join paragraphs
PARAGRAPH = r"\n[^\p{L}\p{N}\n]*\n"

# Customary notices and texts of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
        this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
        claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed
        or altered from any source distribution."""),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def _words(text: Column) -> Column:
    return words(F.lower(text), GAP)


def _pair(of: Column, at: Column) -> Column:
    return F.concat(F.get(of, at), F.lit(" "), F.get(of, at + 1))


def scan_licenses(
    df: DataFrame, licenses: DataFrame, id: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of ``df``: id, ``license`` and ``dice`` of its best match (null
    without one; ties by the smaller name), ``n_units`` with a match, the sorted names
    of all ``licenses`` matched and the number of templates matched, ``n_templates``.

    Units are the lines and paragraphs of the whole text, and match a template (a row
    of ``licenses``: ``license``, ``text``) with a coefficient of at least
    ``threshold``; so does a window of as many words as the template anywhere in the
    text, which is no unit (beyond the end of a text a window holds nothing).  Units
    and templates with fewer than two words match nothing.  A null text counts as
    empty; rows may repeat; other columns are ignored; an empty table gives no row,
    without templates nothing matches.
    """
    known = licenses.select("license", _words(text_or_empty("text")).alias("w")).distinct().filter(F.size("w") > 1)
    size = F.size("w") - 1
    pairs = freeze(
        known.select("license", F.unhex(F.md5(F.array_join("w", " "))).alias("template"), "w", size.alias("b"),
                     F.posexplode("w").alias("at", "word"))
        .filter(F.col("at") < F.col("b"))
        .select("license", "template", "b", _pair(F.col("w"), F.col("at")).alias("pair"))
        .groupBy("license", "template", "b", "pair").agg(F.count(F.lit(1)).alias("times_b")))
    bounds = pairs.agg(F.min("b"), F.max("b"), F.count(F.lit(1))).first()
    lookup = small(pairs, bounds[2], max_broadcast_rows)
    # 2 min(a, b) / (a + b) >= t  <=>  t / (2 - t) <= a / b <= (2 - t) / t, with room for rounding
    ratio = threshold / (2 - threshold)
    low, high = (bounds[0] or 0) * ratio - 1e-6, (bounds[1] or 0) / ratio + 1e-6

    body = text_or_empty(text)
    key = row_key(F.col(f"`{id}`"), body)
    # a text without a blank line is one paragraph, one without a line break one line
    units = df.select(key.alias("key"), F.explode(F.array_distinct(
        F.concat(F.split(body, "\n", -1), F.split(body, PARAGRAPH, -1)))).alias("unit"))
    sized = units.select("key", F.xxhash64("unit").alias("unit"), _words(F.col("unit")).alias("w")).withColumn(
        "a", size).filter((F.col("a") >= low) & (F.col("a") <= high) & (F.col("a") > 0))
    placed = sized.select("key", "unit", "a", "w", F.posexplode("w").alias("at", "word")).filter(
        F.col("at") < F.col("a")).select("key", "unit", "a", "at", _pair(F.col("w"), F.col("at")).alias("pair"))
    shared = placed.join(lookup, "pair").filter(
        (F.col("a") >= F.col("b") * ratio - 1e-6) & (F.col("a") <= F.col("b") / ratio + 1e-6)
    ).groupBy("key", "unit", "a", "license", "template", "b", "pair").agg(
        # places, as rows that repeat give the same unit again
        F.count_distinct("at").alias("times"), F.first("times_b").alias("times_b"))
    matched = shared.groupBy("key", "unit", "a", "license", "template", "b").agg(
        F.sum(F.least("times", "times_b")).alias("both")
    ).withColumn("dice", 2 * F.col("both") / (F.col("a") + F.col("b"))).filter(F.col("dice") >= threshold)

    inside = _windows(df.select(key.alias("key"), _words(body).alias("w")), lookup, threshold)
    found = matched.select("key", "unit", "license", "template", "dice").unionByName(
        inside.withColumn("unit", F.lit(None).cast("long")))
    best = found.groupBy("key").agg(
        F.max("dice").alias("dice"),
        F.min(F.struct(-F.col("dice"), "license"))["license"].alias("license"),
        F.count_distinct("unit").alias("n_units"), F.sort_array(F.collect_set("license")).alias("licenses"),
        F.size(F.collect_set(F.struct("license", "template"))).alias("n_templates"))
    return df.select(F.col(f"`{id}`").alias("id"), key.alias("key")).join(best, "key", "left").select(
        F.col("id").alias(id), "license", "dice", F.coalesce("n_units", F.lit(0)).alias("n_units"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.coalesce("n_templates", F.lit(0)).alias("n_templates"))


def _windows(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Key, license, template and the largest coefficient of a window of the template's size.

    ``texts`` has ``key`` and the words ``w``, ``pairs`` the bigrams of the templates.
    """
    places = texts.select("key", "w", F.posexplode("w").alias("at", "word")).filter(
        F.col("at") < F.size("w") - 1).select("key", "at", _pair(F.col("w"), F.col("at")).alias("pair"))
    of = ["key", "license", "template", "b"]
    # the places of a row are in one task, so they are one row per bigram before the exchange
    held = places.join(pairs, "pair").groupBy(*of, "pair", "times_b").agg(
        F.array_sort(F.collect_set("at")).alias("ats"))
    # no window holds more of the template than the whole text
    near = held.groupBy(*of).agg(
        F.sum(F.least(F.size("ats"), "times_b")).alias("most"), F.collect_list(F.struct("ats", "times_b")).alias("held")
    ).filter(F.col("most") >= threshold * F.col("b") - 1e-6)
    spread = near.select(*of, F.explode("held").alias("h")).select(
        *of, F.col("h.ats").alias("ats"), F.col("h.times_b").cast("int").alias("t"),
        F.posexplode("h.ats").alias("k", "at"))
    before = F.when(F.col("k") >= F.col("t"), F.get("ats", F.col("k") - F.col("t")) + 1)
    first = F.greatest(F.lit(0), F.col("at") - F.col("b") + 1, before)
    ends = spread.select(*of, F.explode(F.array(
        F.struct(first.alias("start"), F.lit(1).alias("step")),
        F.struct((F.col("at") + 1).alias("start"), F.lit(-1).alias("step")))).alias("end")).select(*of, "end.*")
    both = F.sum("step").over(Window.partitionBy(*of).orderBy("start"))
    return ends.withColumn("both", both).groupBy(*of).agg(F.max("both").alias("both")).select(
        "key", "license", "template", (2 * F.col("both") / (F.col("b") + F.col("b"))).alias("dice")
    ).filter(F.col("dice") >= threshold)
