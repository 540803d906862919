import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from settlespark.llm.encoding import _tokenizer
from settlespark.llm import packing
from settlespark.llm.packing import Bins, closing, group_count, improve, pack, pack_sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(6))
def test_search_never_breaks_a_packing_and_needs_no_more_than_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 60) for _ in range(300)]
    packed = pack(sizes, 100)
    assert sorted(i for b in packed for i in b) == list(range(300))
    assert all(sum(sizes[i] for i in b) <= 100 for b in packed)
    assert len(packed) <= math.ceil(sum(sizes) / 100) + 2


def bins_of(capacity, *members):
    bins = Bins(capacity)
    bins.pieces = [[(s, 100 * b + i) for i, s in enumerate(m)] for b, m in enumerate(members)]
    bins.fill = [sum(m) for m in members]
    return bins


@pytest.mark.parametrize("members", [
    ([6, 3], [7], [2]),            # moves
    ([6, 2], [5, 1], [3, 3]),      # one for one, then moves
    ([4, 4], [5, 4], [2, 1]),      # two pieces into gaps
])
def test_search_empties_a_sequence(members):
    bins = bins_of(10, *members)
    before = sum(f * f for f in bins.fill)
    improve(bins)
    assert sum(f * f for f in bins.fill) > before
    assert sum(1 for f in bins.fill if f) == math.ceil(sum(map(sum, members)) / 10)
    assert [sum(s for s, _ in p) for p in bins.pieces] == bins.fill


def test_search_goes_on_while_sequences_can_be_emptied():
    bins = bins_of(10, *[[7]] * 120, *[[3, 3]] * 60)
    improve(bins)
    assert sum(1 for f in bins.fill if f) == 120


ROWS = [(1, ""), (2, None), (3, "the cat " * 900), (3, "again"), (None, "x"), (4, "word " * 70)] + [
    (i, "some words here " * (i % 37)) for i in range(10, 200)]


@pytest.mark.parametrize("group_pieces", [20_000, 40])
def test_pieces_hold_every_token_once(spark, group_pieces):
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in ROWS], "doc_id long, text string, sequence long, id int")
    got = pack_sequences(df, PATH, 1, length=128, group_pieces=group_pieces).collect()
    tokenizer, want = _tokenizer(PATH), []
    for id_, text in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(id_, p, s, len(ids[s:s + 128]), zlib.crc32(np.array(ids[s:s + 128], "<u4").tobytes()))
                 for p, s in enumerate(range(0, len(ids), 128))]
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= 128
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 128) + 2


def test_groups_stay_bounded_when_pieces_fill_no_gaps(spark, tmp_path, monkeypatch):
    run = packing._pack_group

    def watched(capacity, last):
        inner = run(capacity, last)

        def pack_one(table):
            (tmp_path / f"{random.random()}").write_text(str(table.num_rows))
            return inner(table)
        return pack_one

    monkeypatch.setattr(packing, "_pack_group", watched)
    # 80 tokens and the end: no two fit into 128
    df = spark.createDataFrame([(i, "the " * 80) for i in range(1200)], "doc_id long, text string")
    got = pack_sequences(df, PATH, 1, length=128, group_pieces=100).collect()
    assert len({r.sequence_id for r in got}) == len(got) == 1200
    assert max(int(f.read_text()) for f in tmp_path.iterdir()) < 200


def test_half_of_the_pieces_are_closed_fullest_first():
    assert closing([(60, 1), (90, 2), (100, 1), (55, 2), (70, 1)], 100) == [False, True, True, False, True]
    assert closing([(100, 1), (100, 1), (40, 1)], 100) == [True, True, False]
    # many small pieces are not spread over more groups than they fill sequences of
    assert group_count(1_000_000, 1_000_000, 100_000, 20_000) == 1
    assert group_count(1_000_000, 500_000_000, 4096, 20_000) == 50


def test_empty_table(spark):
    assert pack_sequences(spark.createDataFrame([], "doc_id long, text string"), PATH, 1).collect() == []


def test_many_tiny_pieces():
    """Sequences with hundreds of equal pieces are searched by distinct sizes."""
    import time

    began = time.perf_counter()
    packed = pack([4090] * 10_000 + [7] * 10_000, 4096)
    assert time.perf_counter() - began < 60
    assert len(packed) == 10_000 + math.ceil(7 * 10_000 / 4096)
    assert sorted(i for b in packed for i in b) == list(range(20_000))


def test_search_tries_a_share_of_a_large_group():
    """Pairs of pieces too large for one another: a sequence that can be emptied is found
    behind more than FAILURES that cannot."""
    members = [[60]] * (packing.FAILURES * packing.FAILED_SHARE * 2) + [[30, 31], [39]]
    bins = bins_of(100, *members)
    improve(bins)
    assert sum(1 for f in bins.fill if f) <= len(members) - 1
