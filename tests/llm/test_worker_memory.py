"""What a Python worker holds while it compares a block of near copies or decodes windows."""
import tracemalloc

import numpy as np

from tidewatch.llm import jaccard, pii


def _peak(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_links_of_two_blocks():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 62, k % 60).astype(np.uint64)])) for k in range(2 * jaccard.BLOCK)]
    link, peak = _peak(lambda: jaccard._links(sets))
    own = np.array([k % 60 for k in range(len(sets))])
    want = 5 * 200 >= 4 * (200 + own[:, None] + own[None, :])
    np.fill_diagonal(want, False)
    assert (link == want).all() and 0 < want.mean() < 1
    assert peak < 100  # 138 before


def test_decoding_keeps_nothing_for_a_backward_pass():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, pii._N_IN, (4096, pii.WINDOW)), rng.integers(0, 3, (4096, pii.WINDOW))
    net = pii.train(x[:200], y[:200], steps=3)
    tags, peak = _peak(lambda: pii.decode(x, net))
    assert (tags[:50] == pii.decode(x[:50], net)).all()
    assert peak < 250  # 628 before
