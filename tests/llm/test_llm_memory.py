"""What the tasks of one operator leave in a Python worker for those of the next."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pytest

from keysift.llm.common import forget, per_process

ROLLUP = Path("/proc/self/smaps_rollup")


def anonymous_mb() -> float:
    return int(re.search(r"\nAnonymous:\s+(\d+)", ROLLUP.read_text())[1]) / 1024


@pytest.mark.skipif(not ROLLUP.exists(), reason="reads the memory of a process of Linux")
@pytest.mark.parametrize(
    "next_operator", [forget, lambda: per_process("memory-test", 1, dict)], ids=["forget", "per_process"]
)
def test_freed_memory_goes_back_before_the_next_operator(next_operator):
    # Small blocks below one that stays: the allocator keeps them when they are freed.
    blocks = [np.ones(100_000, np.uint8) for _ in range(2000)]
    last = blocks[-1]
    blocks.clear()
    freed = anonymous_mb()
    try:
        next_operator()
        assert anonymous_mb() < freed - 100
    finally:
        forget()
    assert last.all()
