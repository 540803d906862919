import random
import re
from collections import Counter

import pytest

from settlespark.llm.licenses import TEMPLATES, scan_licenses, templates


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text):
    w = words(text)
    return Counter(zip(w, w[1:]))


def expected(rows, known, threshold):
    out = []
    for id_, text in rows:
        text = text or ""
        matched, units = [], set()
        for unit in {*text.split("\n"), *re.split(r"\n(?:(?!\n)[\W_])*\n", text)}:
            a = bigrams(unit)
            for name, template in known:
                b = bigrams(template)
                if a and b:
                    dice = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
                    if dice >= threshold:
                        matched.append((-dice, name, template))
                        units.add(unit)
        w = words(text)
        pairs = list(zip(w, w[1:]))
        for name, template in known:
            b = bigrams(template)
            n = sum(b.values())
            if n and sum((Counter(pairs) & b).values()) >= threshold * n - 1e-6:
                dice = max(sum((Counter(pairs[s:s + n]) & b).values()) for s in range(len(pairs))) / n
                if dice >= threshold:
                    matched.append((-dice, name, template))
        best = min(matched) if matched else (None, None)
        out.append((id_, best[1], best[0] and round(-best[0], 9), len(units), sorted({m[1] for m in matched}),
                    len({(m[1], *words(m[2])) for m in matched})))
    return sorted(out, key=repr)


def documents():
    rng = random.Random(8)
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(TEMPLATES)[1].split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(["", "some", "Words,", "of the"])
            lines.append(rng.choice(["\n", " "]).join([" ".join(w[:9]), " ".join(w[9:])]))
        rows.append((i, rng.choice(["\n", "\n\n", "\n \n"]).join(lines)))
    # notices inside lines, behind comment marks, over lines, and cut off at the end of a text
    for i in range(60):
        w = rng.choice(TEMPLATES)[1].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["some", "the the", "of the of the"])
        sep = rng.choice([" ", "\n# ", "\n *\n * ", " the software "])
        at = sorted(rng.sample(range(len(w) + 1), 2))
        body = [" ".join(w[:at[0]]), " ".join(w[at[0]:at[1]]), " ".join(w[at[1]:])]
        rows.append((200 + i, "Copyright 2024 Foo. " + sep.join(body) + rng.choice(["", " All the rest of the text."])))
    return rows + [(100, None), (101, ""), (None, TEMPLATES[0][1]), (102, "word " * 60_000 + "\n" + TEMPLATES[3][1]),
                   (1, TEMPLATES[5][1]), (1, TEMPLATES[5][1]), (103, "solo")]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_matches_equal_those_of_all_comparisons(spark, broadcast):
    df = spark.createDataFrame([(*r, "k", 1) for r in documents()], "doc_id long, text string, key string, unit int")
    got = scan_licenses(df, templates(spark), max_broadcast_rows=broadcast).collect()
    assert sorted([(r.doc_id, r.license, r.dice and round(r.dice, 9), r.n_units, r.licenses, r.n_templates) for r in got],
                  key=repr) == expected(documents(), TEMPLATES, 0.8)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licenses(none, templates(spark)).collect() == []
    df = spark.createDataFrame(documents(), "doc_id long, text string")
    no_templates = spark.createDataFrame([(None, None), ("x", "one")], "license string, text string")
    assert {r.license for r in scan_licenses(df, no_templates).collect()} == {None}


def test_repeated_rows_count_once(spark):
    """A template with repeated bigrams; rows equal in id and text give what one gives."""
    known = spark.createDataFrame([("L", "a b a b a b c d")], "license string, text string")
    text = "a b x a b q c d"
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    many = spark.createDataFrame([(1, text)] * 5, "doc_id long, text string")
    want = [tuple(r) for r in scan_licenses(one, known, threshold=0.3).collect()]
    assert want[0][2] is not None
    assert [tuple(r) for r in scan_licenses(many, known, threshold=0.3).collect()] == want * 5


def test_notices_inside_longer_units(spark):
    header = """#!/usr/bin/env python
    # Copyright 2024 Foo
    #
    # This program is free software: you can redistribute it and/or modify
    # it under the terms of the GNU General Public License as published by
    # the Free Software Foundation, either version 3 of the License, or
    # (at your option) any later version.
    #
    # This program is distributed in the hope that it will be useful."""
    rows = [(1, "Copyright 2024 Foo. Released under the MIT License."), (2, header),
            (3, "word " * 50_000 + "licensed under CC BY 4.0 " + "word " * 50_000), (4, "the License of the Software")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df, templates(spark)).collect()}
    assert (got[1].license, got[1].dice, got[1].n_units) == ("MIT", 1.0, 0)
    assert got[2].license == "GPL-3.0" and got[3].license == "CC-BY-4.0" and got[4].licenses == []
