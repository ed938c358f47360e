"""What tasks give back to the system when they end."""

import os

import numpy as np
import pyarrow as pa

from vidlake.llm.text import tidy


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_a_task_that_ended_keeps_no_freed_memory():
    kept = []

    @tidy
    def run(batches):
        for batch in batches:
            blocks = [np.ones(8000) for _ in range(4000)]  # each is too small for pages of its own
            kept.append(blocks[-1])  # and the last holds the heap's end
            del blocks
            yield batch

    before = resident()
    assert len(list(run(iter([pa.record_batch({"a": [1]})])))) == 1
    assert resident() - before < 60_000_000
