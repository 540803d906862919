"""Removal of repeated passages against a plain count of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from settlespark.llm import repeats
from settlespark.llm.bwt import Strings, merged_order
from settlespark.llm.repeats import cut_repeats


def expected(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[a:a + length] for _, b in texts for a in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for a in range(len(b) - length + 1):
            if counts[b[a:a + length]] > 1:
                gone[a:a + length] = [True] * length
        spans, at = [], 0
        while at < len(b):
            end = at
            while end < len(b) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        out.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((r[0], r[1], [tuple(s) for s in r[2]], bytes(r[3])) for r in cut_repeats(df, **options).collect()), key=repr)


def corpus():
    random.seed(5)
    text = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (30, 45, 60, 90)]
    rows = [(i, text(random.randint(0, 40)) + random.choice(passages) + text(10) + random.choice(passages)[5:])
            for i in range(60)]
    rows += [(100 + i, text(random.randint(5, 25)) + passages[0] + text(random.randint(5, 25))) for i in range(40)]
    rows += [(200, "x" * 150), (201, "ab" * 70), (202, "x" * 40), (203, None), (204, ""), (205, text(1500)), (None, text(90))]
    rows += [rows[3], rows[3], (7, rows[8][1])]
    return rows


@pytest.mark.parametrize("options", [
    {"crowded": 4, "most": 3}, {"gram": 5, "symbols": 3}, {"gram": 24, "symbols": 8, "crowded": 1, "most": 1}])
def test_equals_counting_all_windows(spark, options):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    options = {"length": 24, "gram": 8, "symbols": 4} | options
    assert found(df, **options) == expected(rows, 24)


def test_segments_and_buckets(spark, monkeypatch):
    """Long texts are read in segments; the result does not depend on where they end."""
    random.seed(1)
    base = "".join(random.choice("abcdefgh") for _ in range(3000))
    rows = [(1, base), (2, base[1000:2000] + "z" + base[:500]), (3, base[::-1])]
    for segment in (64, 1000, 1 << 20):
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
        sizes = [len(t) for _, t in rows]
        end = np.repeat(np.cumsum(sizes), sizes)
        windows = Counter()
        for start, count, place, _ in repeats.anchors(data, end, 50, 16):
            for a, n in zip(start.tolist(), count.tolist()):
                windows.update(range(a, a + n))
        # every window of every text belongs to one context
        want = [s + a for s, n in zip(np.cumsum(sizes) - sizes, sizes) for a in range(n - 49)]
        assert sorted(windows) == want and set(windows.values()) == {1}


def test_merged_transforms_are_sorted(spark):
    random.seed(3)
    for _ in range(60):
        width, rounds = random.choice([1, 2, 3, 5, 9]), random.choice([1, 2, 4])
        strings = [bytes(random.choice(b"ab") for _ in range(random.randint(width, 40))) for _ in range(random.randint(1, 12))]
        strings += strings[:2]
        s = Strings(np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings]), width)
        merged = merged_order(s, rounds, random.choice([10, 30, 1000]))

        def symbols(slot):
            return [int(x) for x in s.symbols[slot:slot + s.left[slot] + 1:width] if x][:rounds]

        order = [symbols(x) for x in merged.slots]
        assert order == sorted(order) and sorted(merged.slots.tolist()) == list(range(len(s.string)))
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert merged.common[k] == common
            assert (merged.interval[k] == merged.interval[k - 1]) == (common == rounds)
        texts = {}
        for slot in np.flatnonzero(s.symbols):
            at = int(s.offset[slot])
            texts.setdefault(int(s.symbols[slot]), set()).add(strings[s.string[slot]][at:at + width])
        assert all(len(t) == 1 for t in texts.values())


def test_empty_and_clashing(spark):
    schema = "doc_id long, text string, digest long, id string, removed int, gram int"
    assert cut_repeats(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(1, "ab" * 150, 1, "x", 2, 3), (2, "c", None, None, None, None)], schema)
    assert [(r[0], r[1], len(r[2])) for r in sorted(cut_repeats(df).collect())] == [(1, 300, 1), (2, 1, 0)]
