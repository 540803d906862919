"""SuperMinHash signatures of many sets at once.

Each element draws one value per step for a slot of its own random permutation;
the permutation is built step by step, so values of different slots are correlated
and the estimate has a lower variance than with independent hashes.  Step ``j``
gives values in [j, j + 1), hence a set is finished once all of its slots are below
the next step.  Sets are processed in lockstep with numpy.
"""

from __future__ import annotations

import numpy as np

SLOTS = 125
FRACTION_BITS = 25
EMPTY = np.uint32(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit with equal chance."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int = SLOTS) -> np.ndarray:
    """Array (sets, slots) of 32-bit values; ``owner`` is the set of each (distinct) element.

    The step is in the high bits, the fraction in the low ones; a set without
    elements keeps ``EMPTY`` everywhere.
    """
    table = np.full((sets, slots), EMPTY, np.uint32)
    flat = table.reshape(-1)
    chosen: list[np.ndarray] = []
    for step in range(slots):
        if not len(elements):
            break
        drawn = mix(elements + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        place = step + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        # what the permutation holds at that place after the swaps so far
        slot = place
        for earlier in range(step - 1, -1, -1):
            slot = np.where(chosen[earlier] == slot, earlier, slot)
        value = np.uint32(step << FRACTION_BITS) | (drawn >> np.uint64(64 - FRACTION_BITS)).astype(np.uint32)
        np.minimum.at(flat, owner * slots + slot, value)
        chosen.append(place.astype(np.int16))
        finished = table.max(axis=1) < (step + 1) << FRACTION_BITS
        going = ~finished[owner]
        if not going.all():
            elements, owner = elements[going], owner[going]
            chosen = [c[going] for c in chosen]
    return table


def band_keys(table: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per set and band of ``rows`` slots."""
    sets, slots = table.shape
    bands = table[:, :slots // rows * rows].reshape(sets, -1, rows).astype(np.uint64)
    keys = np.arange(bands.shape[1], dtype=np.uint64)[None, :] + np.zeros((sets, 1), np.uint64)
    for row in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, row] + np.uint64(1))
    return keys.view(np.int64)
