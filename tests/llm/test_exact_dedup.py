import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import types as T

from settlespark.llm.exact_dedup import ContentTable, drop_exact_copies, exact_groups

SCHEMA = "doc_id long, text string, key long, head string, rest string"


def expected(rows):
    groups = defaultdict(list)
    for id_, text in rows:
        groups[text or ""].append(id_)
    out = []
    for id_, text in rows:
        ids = groups[text or ""]
        known = [i for i in ids if i is not None]
        out.append((id_, max(known) if known else None, len(ids), sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


CASES = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "a "), (None, "a"), (None, "b"), (None, "b"),
         (7, "c"), (7, "c"), (8, "x" * 300_000), (9, "x" * 300_000), (10, "x" * 300_001), (11, "é")]


@pytest.mark.parametrize("table_bytes", [64 << 20, 700])
def test_groups(spark, table_bytes):
    rng = random.Random(1)
    rows = CASES + [(i, f"text {rng.randrange(40)}") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_groups(df, table_bytes=table_bytes)
    assert rows_of(got) == expected(rows)
    kept = defaultdict(int)
    for r in got.collect():
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_drop_keeps_columns_with_clashing_names(spark):
    rows = [(1, "a", 5, "h1", "r1"), (2, "a", None, None, "r2"), (3, None, 7, "h3", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(rows[1:], key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_groups(df).collect() == []
    assert drop_exact_copies(df).collect() == []


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "t"), ("a", "t")], T.StructType(
        [T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())]))
    assert {r.keep_id for r in exact_groups(df).collect()} == {"b"}


def test_equal_digests_are_told_apart_by_content():
    table = ContentTable()
    for content in (b"one", b"two"):
        entry, slot = table.find(7, content)
        assert entry == -1
        table.add(7, content, slot)
    assert table.find(7, b"one")[0] == 0 and table.find(7, b"two")[0] == 1
    for i in range(5000):
        table.add(i * 1024, str(i).encode(), table.find(i * 1024, str(i).encode())[1])
    assert all(table.contents[table.find(i * 1024, str(i).encode())[0]] == str(i).encode() for i in range(5000))
