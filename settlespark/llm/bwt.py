"""Burrows-Wheeler transforms of string collections and their merge.

Strings are read over an alphabet of ``width``-byte symbols: the suffix at a byte is the
sequence of symbols from there on, so a string gives ``width`` interleaved symbol
strings and a suffix of every byte is among them.  A transform is the list of symbols
before the sorted suffixes of a shard.

Transforms are merged by refining an interleave, the sequence of shard numbers that
says from which transform the next suffix comes.  It starts as one shard after the
other; each round sorts the symbols in its order stably, which orders the suffixes by
one more symbol.  No suffix is compared again.  Where a round first sees two neighbours
apart is the length of their common prefix; neighbours never seen apart share as many
symbols as there were rounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np

from settlespark.llm.superminhash import mix

#: The symbol of a suffix that has ended, and the one before a string begins.
NONE = 0


def gram_hashes(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each position that has so many."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    part = mix(data + np.uint64(1 + 257 * seed))
    out, held, size = None, 0, 1
    factor = 0x9E3779B97F4A7C15
    while True:
        if width & size:
            # bytes held so far, then the next `size`
            out = part if out is None else (
                out[:len(out) - size] * np.uint64(factor) + part[held:held + len(out) - size])
            held += size
        if size * 2 > width:
            break
        part = part[:-size] * np.uint64(factor) + part[size:]
        size, factor = size * 2, (factor * factor + 2) % (1 << 64)
    return np.maximum(mix(out[:len(data) - width + 1]), np.uint64(1))


def _same_bytes(data: np.ndarray, width: int, at: np.ndarray, other: np.ndarray) -> bool:
    """Whether the ``width`` bytes from ``at`` and ``other`` agree, pair by pair."""
    if width < 8:
        return all(np.array_equal(data[at + i], data[other + i]) for i in range(width))
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    return all(np.array_equal(words[at + i], words[other + i]) for i in [*range(0, width - 7, 8), width - 8])


@dataclass
class Strings:
    """Strings one after another in ``data``; each has a slot per byte and one at its end."""

    data: np.ndarray
    sizes: np.ndarray
    width: int

    def __post_init__(self):
        slots = self.sizes + 1
        #: First slot of each string, and the string and the offset of each slot.
        self.first = np.cumsum(slots) - slots
        self.string = np.repeat(np.arange(len(slots)), slots)
        self.offset = np.arange(len(self.string)) - self.first[self.string]
        self.left = self.sizes[self.string] - self.offset
        self.symbols = self._symbols()

    def _symbols(self) -> np.ndarray:
        """The symbol at each slot, from 1; equal hashes are checked to be equal bytes."""
        whole = np.flatnonzero(self.left >= self.width)
        at = whole - self.string[whole]
        for seed in count():
            hashes = gram_hashes(self.data, self.width, seed)[at]
            order = np.argsort(hashes)
            hashes, placed = hashes[order], at[order]
            same = np.flatnonzero(hashes[1:] == hashes[:-1])
            if _same_bytes(self.data, self.width, placed[same], placed[same + 1]):
                break
        new = np.ones(len(order), bool)
        new[same + 1] = False
        symbols = np.zeros(len(self.string), np.uint32)
        symbols[whole[order]] = np.cumsum(new)
        return symbols


@dataclass
class Transform:
    """``symbols`` before the sorted suffixes of a shard, and the ``slots`` of these."""

    symbols: np.ndarray
    slots: np.ndarray


def _stable_order(ids: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative 32-bit integers, by counting 16 bits at a time."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    if ids.max(initial=0) >> 16:
        order = order[np.argsort((ids >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _ranks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 0 of rows in sorted ``order`` that are equal if their keys are."""
    new = np.zeros(len(order), bool)
    for key in keys:
        placed = key[order]
        new[1:] |= placed[1:] != placed[:-1]
    ranks = np.empty(len(order), np.uint32)
    ranks[order] = np.cumsum(new)
    return ranks


def transform(strings: Strings, start: int, end: int) -> Transform:
    """The transform of the strings in slots ``start`` to ``end``, by doubling ranks."""
    symbols, left = strings.symbols[start:end], strings.left[start:end]
    width = strings.width
    order = _stable_order(symbols)
    ranks = _ranks(order, symbols)
    step = width
    while step <= left.max(initial=0):
        further = np.zeros(len(ranks), np.uint32)
        inside = np.flatnonzero(left >= step)
        further[inside] = ranks[inside + step] + 1
        order = _stable_order(further)
        order = order[_stable_order(ranks[order])]
        ranks = _ranks(order, ranks, further)
        step *= 2
    before = np.zeros(len(order), np.uint32)
    inner = strings.offset[start:end][order] >= width
    before[inner] = symbols[order[inner] - width]
    return Transform(before, order + start)


@dataclass
class Merged:
    """Suffixes of all shards by their first symbols.

    ``slots`` in order, ``common`` symbols with the suffix before (at most the number of
    rounds), and ``interval``: suffixes share it if they agree in as many symbols.
    """

    slots: np.ndarray
    common: np.ndarray
    interval: np.ndarray


def merge(transforms: list[Transform], rounds: int) -> Merged:
    """Merge transforms by ``rounds`` refinements of their interleave."""
    sizes = [len(t.symbols) for t in transforms]
    total = sum(sizes)
    symbols = np.concatenate([t.symbols for t in transforms])
    shard = np.arange(len(transforms), dtype=np.uint16 if len(transforms) > 256 else np.uint8)
    empty = [int(np.count_nonzero(t.symbols == NONE)) for t in transforms]
    ended = np.repeat(shard, empty)
    interleave = np.repeat(shard, sizes)
    apart = np.zeros(total, bool)
    apart[:1] = True
    common = np.zeros(total, np.int32)
    for _ in range(rounds):
        place = np.argsort(interleave, kind="stable")
        before = np.empty(total, np.uint32)
        before[place] = symbols
        block = np.cumsum(apart, dtype=np.int32)
        going = np.flatnonzero(before)
        going = going[_stable_order(before[going])]
        symbol, block = before[going], block[going]
        # ended suffixes come first and equal none
        interleave = np.concatenate((ended, interleave[going]))
        apart = np.ones(total, bool)
        apart[len(ended) + 1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        common += ~apart
    slots = np.empty(total, np.int64)
    slots[np.argsort(interleave, kind="stable")] = np.concatenate([t.slots for t in transforms])
    return Merged(slots, common, np.cumsum(apart))


def merged_order(strings: Strings, rounds: int, shard_bytes: int) -> Merged:
    """Cut the strings into shards of about ``shard_bytes``, transform and merge them."""
    bounds = [0]
    for first, size in zip(strings.first.tolist(), strings.sizes.tolist()):
        if first + size + 1 - bounds[-1] > shard_bytes and first > bounds[-1]:
            bounds.append(first)
    bounds.append(len(strings.string))
    return merge([transform(strings, a, b) for a, b in zip(bounds, bounds[1:])], rounds)
