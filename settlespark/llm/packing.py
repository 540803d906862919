"""Packing documents into sequences of bounded length.

Documents become rows of (piece, length): only a document longer than a sequence
is cut.  Pieces are dealt at random into groups of bounded size, and each group is
packed by one task: best fit places the pieces, then a local search exchanges
pieces of underfull sequences, one for one, two for one, or by moving one.  Every
step increases the sum of squared fills, so the emptiest sequence drains until it
is gone.  What the groups leave underfull is dealt again into fewer groups, until
one group is left.  In every round the fullest sequences that hold half of a group's
pieces are final, so the pieces halve and the last group is no larger than others.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlespark.llm.batches import map_batches, partition_id, slices, text_or_empty
from settlespark.llm.encoding import encoder
from settlespark.plans.skew import freeze

GROUP_PIECES = 20_000
# Tokens of a group suffice for so many sequences, however small its pieces are.
GROUP_SEQUENCES = 8
# A sequence with less room than this share of its length is not opened again.
CLOSED_SHARE = 1 / 256
# Sequences in a row that could not be emptied, after which the search ends, and the share
# of the sequences of a larger group.
FAILURES, FAILED_SHARE = 50, 32


def _pieces(
    batches, schema: pa.Schema, tokenizer: str, end_id: int, length: int
) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer).encode
    rng = np.random.default_rng(partition_id())
    for batch in batches:
        for part in slices(batch, pc.binary_length(batch["text"]).to_pylist()):
            found, count = encode(part["text"].to_pylist())
            ids = np.insert(found, np.cumsum(count), end_id).astype("<u4")
            sizes = count + 1
            first = np.cumsum(sizes) - sizes
            pieces = -(-sizes // length)
            row = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * length
            held = np.minimum(length, sizes[row] - start)
            at = first[row] + start
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), held.tolist())]
            yield pa.RecordBatch.from_arrays([
                part["id"].take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start),
                pa.array(held), pa.array(crc, pa.int64()),
                pa.array(rng.integers(0, 1 << 62, len(row))),
            ], schema=schema)


def cut(df: DataFrame, tokenizer: str, end_id: int, length: int, id: str, text: str) -> DataFrame:
    """Pieces of all documents: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    and ``deal``, a random number that spreads them."""
    schema = T.StructType([
        T.StructField("id", df.schema[id].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("deal", T.LongType()),
    ])
    texts = df.select(F.col(f"`{id}`").alias("id"), text_or_empty(text).cast("binary").alias("text"))
    return map_batches(texts, _pieces, schema, tokenizer, end_id, length)


class Bins:
    """Sequences being filled; the pieces of each are (size, index) pairs."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.pieces: list[list[tuple[int, int]]] = []
        self.fill: list[int] = []
        self.by_gap: dict[int, list[int]] = {}
        self.gaps = 0

    def place(self, size: int, index: int) -> None:
        """Best fit: the sequence with the least sufficient gap."""
        mask = self.gaps >> size << size
        if mask:
            gap = (mask & -mask).bit_length() - 1
            bin_ = self.by_gap[gap].pop()
            if not self.by_gap[gap]:
                self.gaps ^= 1 << gap
        else:
            bin_, gap = len(self.fill), self.capacity
            self.pieces.append([])
            self.fill.append(0)
        self.pieces[bin_].append((size, index))
        self.fill[bin_] += size
        gap -= size
        if not self.by_gap.get(gap):
            self.by_gap[gap] = []
            self.gaps |= 1 << gap
        self.by_gap[gap].append(bin_)

    def least(self) -> int:
        return -(-sum(self.fill) // self.capacity)


class _Outs:
    """What a sequence may give away: the totals of one piece or two, each once."""

    def __init__(self, pieces: list[tuple[int, int]]):
        held = Counter(size for size, _ in pieces)
        sizes = sorted(held)
        pairs = [(a, b) for i, a in enumerate(sizes) for b in sizes[i:] if a < b or held[a] > 1]
        self.outs = [(a,) for a in sizes] + pairs
        self.totals = np.array([sum(out) for out in self.outs], np.int64)
        self.single = len(sizes)
        #: Exchanges found so far; targets with the same gap and sizes give the same.
        self.known: dict[tuple, tuple | None] = {}

    def best(self, target: list[tuple[int, int]], gap: int, least: int) -> tuple | None:
        """The exchange that takes most out and still fits into the gap of the target.

        Gives (sizes taken out, size given back or 0, amount); only amounts above ``least``
        raise the squared fill.
        """
        backs = sorted({0, *(size for size, _ in target)})
        key = (gap, least, *backs)
        if key not in self.known:
            sizes = np.array(backs, np.int64)
            # the smallest piece given back that leaves the amount within the gap
            at = np.searchsorted(sizes, self.totals - gap)
            fits = at < len(backs)
            # two pieces go only for one
            fits[self.single:] &= at[self.single:] > 0
            amount = np.where(fits, self.totals - sizes[np.minimum(at, len(backs) - 1)], 0)
            one = int(np.argmax(amount))
            self.known[key] = (self.outs[one], backs[at[one]], int(amount[one])) if amount[one] > least else None
        return self.known[key]


def _take(pieces: list[tuple[int, int]], size: int) -> tuple[int, int]:
    """Remove a piece of that size."""
    return pieces.pop(next(i for i, p in enumerate(pieces) if p[0] == size))


def improve(bins: Bins, failures: int | None = None) -> None:
    """Drain the emptiest sequences into the gaps of fuller ones.

    Each accepted exchange moves a positive amount from a sequence to one that
    becomes fuller than the first was, so the sum of squares rises and the search
    ends.  It also ends when no packing can have fewer sequences.  Sequences are tried
    emptiest first, again after each pass that emptied one; ``failures`` in a row
    (``FAILURES``, or more in a larger group) end the search, as fuller ones are harder
    to empty.
    """
    capacity, fill, pieces = bins.capacity, bins.fill, bins.pieces
    total = sum(fill)
    alive = sum(1 for f in fill if f)
    limit = max(FAILURES, alive // FAILED_SHARE) if failures is None else failures
    failed, before = 0, None
    while alive != before:
        before = alive
        for source in sorted(range(len(fill)), key=fill.__getitem__):
            if alive * capacity - total < capacity or failed >= limit:
                return
            if not fill[source] or fill[source] == capacity:
                continue
            order = sorted(
                (b for b in range(len(fill)) if b != source and 0 < fill[b] < capacity),
                key=lambda b: -fill[b])
            failed += 1
            moved = True
            outs = _Outs(pieces[source])
            while fill[source] and moved:
                moved = False
                for target in order:
                    gap, least = capacity - fill[target], max(0, fill[source] - fill[target])
                    # an exchange moves no more than the gap
                    if gap <= least:
                        continue
                    found = outs.best(pieces[target], gap, least)
                    if found is None:
                        continue
                    out, back, amount = found
                    given = _take(pieces[target], back) if back else None
                    pieces[target] += [_take(pieces[source], size) for size in out]
                    if given:
                        pieces[source].append(given)
                    fill[source] -= amount
                    fill[target] += amount
                    moved = True
                    if not fill[source]:
                        alive, failed = alive - 1, 0
                        break
                    outs = _Outs(pieces[source])


def pack(sizes: list[int], capacity: int, failures: int | None = None) -> list[list[int]]:
    """Indices of the pieces in each sequence."""
    bins = Bins(capacity)
    for index in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins.place(sizes[index], index)
    improve(bins, failures)
    return [[i for _, i in p] for p in bins.pieces if p]


def closing(filled: list[tuple[int, int]], capacity: int) -> list[bool]:
    """Which sequences, given as (tokens, pieces), are not opened again: those with little
    room, and the fullest ones until half of the pieces are in closed ones."""
    pieces, held, closed = sum(n for _, n in filled), 0, [False] * len(filled)
    for at in sorted(range(len(filled)), key=lambda at: -filled[at][0]):
        tokens, n = filled[at]
        if 2 * held >= pieces and capacity - tokens > capacity * CLOSED_SHARE:
            break
        closed[at] = True
        held += n
    return closed


def group_count(pieces: int, tokens: int, capacity: int, group_pieces: int) -> int:
    """Groups of about ``group_pieces``, each with tokens for some sequences."""
    return max(1, min(math.ceil(pieces / group_pieces), tokens // (GROUP_SEQUENCES * capacity)))


def _pack_group(capacity: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("deal", "ascending")])
        sizes = table["length"].to_pylist()
        sequence, offset, closed = ([0] * len(sizes) for _ in range(3))
        packed = pack(sizes, capacity)
        final = closing([(sum(sizes[i] for i in members), len(members)) for members in packed], capacity)
        for number, members in enumerate(packed):
            at = 0
            for i in members:
                sequence[i], offset[i], closed[i] = number, at, last or final[number]
                at += sizes[i]
        for name, values, kind in (
            ("sequence", sequence, pa.int64()), ("offset", offset, pa.int64()), ("closed", closed, pa.bool_())
        ):
            table = table.append_column(name, pa.array(values, kind))
        return table
    return run


def pack_sequences(
    df: DataFrame, tokenizer: str, end_id: int, length: int = 4096, id: str = "doc_id",
    text: str = "text", group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Pack all texts into sequences of at most ``length`` tokens, as few as it can.

    A document is the ids of its text followed by ``end_id``; a null text counts
    as empty.  One row per piece: id, ``piece`` (from 0), ``start`` (ids of the
    document before it), ``length``, ``ids_crc32``, ``sequence_id`` and
    ``offset`` in the sequence, gapless from 0.  Rows that repeat an id are
    documents of their own; other columns are ignored; an empty table gives an
    empty result.  ``group_pieces`` is about the number of pieces a task packs, in
    every round (more if they are so small that they fill few sequences).
    """
    left = freeze(cut(df, tokenizer, end_id, length, id, text))
    out = T.StructType([
        *left.schema.fields, T.StructField("group", T.LongType()), T.StructField("sequence", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("closed", T.BooleanType()),
    ])
    def measure(df: DataFrame) -> tuple[int, int]:
        count, tokens = df.agg(F.count(F.lit(1)), F.sum("length")).first()
        return count, tokens or 0

    rounds, numbered, result, (pieces, tokens) = 0, 0, None, measure(left)
    while result is None or pieces:
        groups = group_count(pieces, tokens, length, group_pieces)
        dealt = left.withColumn("group", F.pmod(F.xxhash64("deal", F.lit(rounds)), F.lit(groups)))
        packed = freeze(
            dealt.repartition(groups, "group").groupBy("group")
            .applyInArrow(_pack_group(length, groups == 1), out))
        # sequences of a group; each round numbers from where the one before it ended
        width = (packed.agg(F.max("sequence")).first()[0] or 0) + 1
        done = packed.filter("closed").select(
            F.col("id").alias(id), "piece", "start", "length", "ids_crc32",
            (F.lit(numbered).cast("long") + F.col("group") * F.lit(width).cast("long") + F.col("sequence")).alias("sequence_id"),
            "offset")
        result = done if result is None else result.unionByName(done)
        left = packed.filter(~F.col("closed")).select(*left.columns)
        pieces, tokens = (0, 0) if groups == 1 else measure(left)
        rounds, numbered = rounds + 1, numbered + groups * width
    return result
