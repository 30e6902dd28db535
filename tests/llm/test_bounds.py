"""What one task holds at once, whatever the size of the corpus."""

import tracemalloc

import numpy as np

from quoteverify.llm import blocks


def test_a_full_bundle_is_summed_in_little_memory():
    rng, messages, size = np.random.default_rng(1), [], 0
    while size < blocks.BUNDLE_BYTES:
        keys = np.cumsum(rng.integers(1, 1 << 22, 20_000)).astype(np.uint64)
        messages.append(blocks.pack_message(keys, np.ones(len(keys), np.int64)))
        size += len(messages[-1])
    tracemalloc.start()
    asked = [blocks.unpack_message(m) for m in messages]
    keys, place, sums = blocks.summed(asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(place) == sum(len(k) for k, _ in asked) and sums.sum() == len(place)
    assert peak < 120e6
