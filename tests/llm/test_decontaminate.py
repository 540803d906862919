import random
import re
from hashlib import sha256

import pytest

from settlespark.llm.decontaminate import contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def expected(documents, items):
    windows = []
    for id_, text in items:
        ws = words(text)
        if ws:
            windows += [("" if id_ is None else str(id_), ws[i:i + 13]) for i in range(max(len(ws) - 13, 0) + 1)]
    out = []
    for id_, text in documents:
        ws, hit, seen = words(text), set(), set()
        for item, window in windows:
            for i in range(len(ws) - len(window) + 1):
                if ws[i:i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    seen.add(item)
        out.append((id_, len(ws), len(hit), len(seen), sha256(",".join(sorted(seen)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


def passages():
    rng = random.Random(2)
    vocabulary = ["Alpha", "beta", "GAMMA", "Éa", "ça", "x1", "9", "the"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 13, 14, 30])))) for i in range(12)]
    items += [(None, "only one item without id here"), (3, "of the same id"), (4, ""), (5, None), (6, "solo")]
    documents = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text) + 1):0] = re.split("[ ]", rng.choice(items[:13])[1])
        documents.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    long = "filler word " * 9000 + items[5][1] + " end"
    return documents + [(100, None), (101, ""), (None, items[2][1]), (102, long), (103, "solo " * 30),
                        (1, documents[1][1]), (1, items[11][1])], items


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_hits_equal_those_of_a_plain_search(spark, broadcast):
    documents, items = passages()
    df = spark.createDataFrame([(*d, "k", 1) for d in documents], "doc_id long, text string, key string, h int").repartition(3)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, pos int")
    got = contamination(df, bench, max_broadcast_rows=broadcast)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(documents, items)


def test_many_items_that_share_a_passage(spark):
    passage = " ".join(f"shared{i}" for i in range(20))
    items = [(i, f"{passage} own{i} tail{i}") for i in range(1000)] + [(5000, "shared1 shared2"), (5001, "tail7 tail7")]
    documents = [(1, f"{passage} filler " * 300), (2, f"a {passage} own7 tail7 tail7 z"), (3, "shared1 shared3"), (4, passage)]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    got = contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(documents, items)


def test_drop_keeps_clean_rows_and_columns(spark):
    documents, items = passages()
    df = spark.createDataFrame([(*d, "k", 1) for d in documents], "doc_id long, text string, key string, _row_key int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns
    flagged = {(i, *r) for (i, *r) in expected(documents, items)}
    clean = sum(not r[-1] for r in expected(documents, items))
    assert kept.count() == clean and flagged


def test_empty_tables(spark):
    documents, items = passages()
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(none, bench).collect() == []
    df = spark.createDataFrame(documents, "doc_id long, text string")
    without = contamination(df, spark.createDataFrame([], "item_id long, text string"))
    assert {r.n_hit for r in without.collect()} == {0} and without.count() == len(documents)
