import math
import random
import re

import numpy as np
import pytest

from settlespark.llm import near_dedup
from settlespark.llm.components import components
from settlespark.llm.near_dedup import drop_near_copies, near_groups, shingle_sets
from settlespark.llm.superminhash import EMPTY, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_sets(rows):
    out = []
    for _, text in rows:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        out.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def expected(rows, percent=85):
    sets, parent = plain_sets(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                both = len(a & sets[j])
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    out = []
    for i, (id_, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        smallest = min(ids) if ids else None
        out.append((id_, len(sets[i]), smallest, id_ == smallest))
    return sorted(out, key=repr)


def chain(rng, base, steps, edits):
    """Copies of copies: neighbours are near, the ends are not."""
    words = list(base)
    for _ in range(steps):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


def documents():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]

    def fresh(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    texts = [" ".join(fresh(rng.randrange(1, 200))) for _ in range(60)]
    texts += list(chain(rng, fresh(300), 60, 2))
    base = fresh(150)
    for _ in range(80):                      # star around one text, pairs near the threshold
        words = list(base)
        for at in rng.sample(range(150), 2):
            words[at] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    passage = fresh(60)                      # a passage shared by short texts that are no copies
    texts += [" ".join(passage + fresh(20)) for _ in range(60)]
    texts += [" ".join(f"t{i}" for i in range(k)) for k in (1, 2, 3, 4, 5, 6, 20, 21, 23, 24)]
    texts += ["A  b\tC", "a b c", "É x y z q", "é x y z q", "", None, " \n ", "", "long " + "word " * 50_000]
    texts += [texts[70], texts[70].upper(), texts[100]]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [(None, texts[3]), (None, "alone without an id and enough words"), rows[5], (ids[6], texts[7])]


@pytest.mark.parametrize("block", [1000, 7])
def test_groups_equal_those_of_all_comparisons(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = documents()
    df = spark.createDataFrame([(*r, "k", 2, "r") for r in rows], "doc_id long, text string, key string, n int, root string")
    got = near_groups(df.repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_drop_keeps_one_of_each_group(spark):
    rows = [r for r in dict.fromkeys(documents()) if r[0] is not None]
    df = spark.createDataFrame([(*r, "k", 2) for r in rows], "doc_id long, text string, key string, _row_key int")
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    groups = {r[2] for r in expected(rows)}
    left = [r.doc_id for r in kept.collect()]
    assert sorted(set(left)) == sorted(groups)


def test_pairs_between_both_thresholds_are_near_for_the_pipeline(spark):
    import corpus_pipeline

    words = [f"p{i}" for i in range(204)]
    # each change spoils 5 of 200 shingles: 180 / 220 = 0.818
    other = [f"q{i}" if i in (20, 60, 100, 140) else w for i, w in enumerate(words)]
    far = [f"q{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert near_groups(df).filter("kept").count() == 2
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()] == [1]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(far))], "doc_id long, text string")
    assert near_groups(df, percent=80).filter("kept").count() == 2


def test_bands_and_equal_slots_follow_the_threshold():
    for percent, rows in ((85, 5), (80, 4)):
        link = near_dedup.Threshold(percent)
        assert link.band_rows == rows
        assert 50 < link.plausible < 1.25 * percent


@pytest.mark.parametrize("percent", [85, 80])
def test_plausible_pairs_are_missed_no_more_than_by_the_bands(percent):
    link, p = near_dedup.Threshold(percent), percent / 100
    tail = sum(math.comb(125, k) * p ** k * (1 - p) ** (125 - k) for k in range(link.plausible))
    assert tail < (1 - 0.85 ** 5) ** 25


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_groups(df).collect() == [] and drop_near_copies(df).collect() == []


def test_hashed_sets_have_the_sizes_of_plain_sets():
    rows = documents()
    hashed, _ = shingle_sets([(t or "").encode() for _, t in rows])
    assert [len(s) for s in hashed] == [len(s) for s in plain_sets(rows)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, shared in ((200, 150), (40, 30), (6, 3)):
        sets = []
        for _ in range(150):
            common = rng.integers(0, 2**63, shared, np.int64)
            sets += [np.concatenate((common, rng.integers(0, 2**63, n - shared, np.int64))) for _ in range(2)]
        table = signatures(np.concatenate(sets).view(np.uint64), np.repeat(np.arange(300), n), 300)
        true = shared / (2 * n - shared)
        equal = (table[::2] == table[1::2]).mean(axis=1)
        assert abs(equal.mean() - true) < 0.02
        assert equal.std() < (true * (1 - true) / 125) ** 0.5 * 1.1
        assert (table != EMPTY).all()


@pytest.mark.parametrize("batch", [500_000, 3])
def test_components(spark, batch):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [
        (rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        u, v = find(u), find(v)
        parent[max(u, v)] = min(u, v)
    got = components(spark.createDataFrame(links, "u long, v long").repartition(5), batch)
    want = {x: find(x) for x in parent if any(x in l for l in links if l[0] != l[1])}
    assert {r.node: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
