import re

import numpy as np
import pytest
from pyspark.sql import types as T

from settlespark.llm.batches import map_batches


class _Frame:
    """Keeps the function that tasks would run."""

    def mapInArrow(self, run, schema):
        self.run = run


def _held() -> int:
    """MB of this process that no file backs."""
    with open("/proc/self/smaps_rollup") as file:
        return int(re.search(r"\nAnonymous:\s+(\d+)", file.read())[1]) >> 10


def test_a_worker_gives_back_what_a_task_has_freed():
    try:
        _held()
    except OSError:
        pytest.skip("no memory figures here")
    pinned = []

    def fragmented(batches, schema):
        held = [np.ones(2000, np.uint8) for _ in range(100_000)]
        pinned.append(np.ones(2000, np.uint8))
        del held
        yield from batches

    frame = _Frame()
    map_batches(frame, fragmented, T.StructType([T.StructField("n", T.LongType())]))
    before = _held()
    assert list(frame.run(iter([1, 2]))) == [1, 2]
    assert _held() - before < 60
