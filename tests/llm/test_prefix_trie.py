"""The trie of conversation prefixes against one built turn by turn."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from settlespark.llm import prefix_trie
from settlespark.llm.prefix_trie import conversation_trie, running

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows, share):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if share else 0
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + path[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * words
    return sorted((
        min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(k)))).encode()).hexdigest(),
    ) for k, m in members.items())


def conversations():
    random.seed(1)
    rows = []
    for c in [*range(45), 100, 101, 205]:
        for t in range(random.choice([0, 1, 2, 3, 5, 30])):
            rows.append((c, random.choice([t, t, t, None]), random.choice(["user", "assistant", None]),
                         random.choice(["a b", "c", "", None, "d  e\nf"])))
    # many rows that are equal, rows without a conversation, a negative one
    return rows + [(7, 1, "user", "x")] * 50 + [(None, 1, "user", "q")] + [(-3, 0, "user", "c")]


@pytest.mark.parametrize("block,share", [(2, True), (8, False)])
def test_equals_plain_trie(spark, block, share):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, conversation_trie(df, block=block, share=share).collect()), key=str) == sorted(
        expected(rows, share), key=str)


def test_hot_nodes(spark, monkeypatch):
    """Nodes with very many members or children, and conversations with very many blocks."""
    monkeypatch.setattr(prefix_trie, "HOT", 3)
    monkeypatch.setattr(prefix_trie, "SALT", 2)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    turns = prefix_trie.placed_turns(df)
    convs = turns.groupBy("conv").count().withColumnRenamed("count", "total")
    assert sorted(map(tuple, prefix_trie.trie(turns, convs, 4, hot=3).collect()), key=str) == sorted(
        expected(rows, False), key=str)


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    df = spark.range(400).select((F.col("id") % 3 * F.lit(0)).alias("g"), F.col("id").alias("o"), F.lit(2).alias("x"))
    got = running(df.repartition(5), "g", ["o"], {"s": F.col("x").cast("long")}).collect()
    assert sorted((r.o, r.s) for r in got) == [(i, 2 * i) for i in range(400)]


def test_empty_and_clashing(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA), share=True).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "a", 5, "x")], SCHEMA + ", depth int, key string")
    assert len(conversation_trie(df).collect()) == 2
