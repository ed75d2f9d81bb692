"""Share of isolated pairs at the threshold that the passes meet: by the operator, and by a numpy copy of its passes at larger sizes."""
import numpy as np
import pytest

from tidewatch.llm import neardup

WIDTH, PAIRS = 32, 2000


def planted(n: int, pairs: int = PAIRS):
    """n random vectors, the last `pairs` of them at a cosine just above the threshold to the first ones."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((n, WIDTH))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((pairs, WIDTH))
    off -= (off * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = neardup.COSINE + 1e-6
    x[n - pairs :] = c * x[:pairs] + np.sqrt(1 - c * c) * off
    return x


def met(x: np.ndarray, pairs: int = PAIRS) -> float:
    n, seen = len(x), np.zeros(pairs, bool)
    passes = neardup.passes_for(n)
    planes = np.random.default_rng((0, WIDTH)).standard_normal((passes * neardup.BITS, WIDTH))
    for p in range(passes):
        key = (x @ planes[p * neardup.BITS : (p + 1) * neardup.BITS].T > 0) @ (1 << np.arange(neardup.BITS - 1, -1, -1, dtype=np.int64))
        run = np.empty(n, int)
        run[np.argsort(key, kind="stable")] = np.arange(n) // neardup.RUN
        seen |= abs(run[:pairs] - run[n - pairs :]) <= 1
    return seen.mean()


@pytest.mark.parametrize("n", [50_000, 500_000])
def test_isolated_pairs_are_met_at_larger_sizes(n):
    assert met(planted(n)) >= 0.985


def test_the_operator_finds_isolated_pairs(spark):
    x = planted(12_000, 500)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in neardup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(got[len(x) - 500 + i].component_id == i for i in range(500))
    assert found >= 0.985 * 500 and sum(r.n_links for r in got.values()) == 2 * found
