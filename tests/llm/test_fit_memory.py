"""The fit of the factorization machine runs in the driver, which has to hold no second copy of the training rows."""

import tracemalloc

import numpy as np

from riskloom.llm.toxicity import train


def test_fit_holds_the_buckets_once():
    random = np.random.default_rng(3)
    labels = np.arange(1500) % 2
    rows = [np.append(np.unique(random.integers(10, 40_000, 4000, dtype=np.int32)), np.int32(y)) for y in labels]
    tracemalloc.start()
    machine = train(rows, labels, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {0, 1} <= set(machine.buckets.tolist())
    assert peak < 90e6  # the rows are 24 MB; counted side by side they took 154
