import tracemalloc

import numpy as np
from wireloom.llm import toxicity


def _texts(n, wide):
    rnd = np.random.default_rng(5)
    return [np.unique(rnd.integers(0, 1 << toxicity.BITS, wide).astype(np.uint32)) for _ in range(n)], np.arange(n) % 3 == 0


def test_fit_holds_little_more_than_the_buckets():
    xs, y = _texts(300, 20_000)
    tracemalloc.start()
    toxicity.fit(xs, y.astype(float), rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(map(len, xs))


def test_blocks_change_no_weight(monkeypatch):
    xs, y = _texts(60, 500)
    xs[7] = xs[7][:0]
    one = toxicity.fit(xs, y.astype(float), seen=1)
    monkeypatch.setattr(toxicity, "BLOCK", 700)
    assert np.array_equal(one, toxicity.fit(xs, y.astype(float), seen=1))
    assert np.count_nonzero(one) > 1000
