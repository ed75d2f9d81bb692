"""Links within groups larger than the windows, and passes by table size."""
import numpy as np

from tidewatch.llm import neardup


def test_links_of_a_large_group_are_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((600, 16)), rng.standard_normal(16) + rng.standard_normal((2600, 16)) * 0.2])
    x = np.concatenate([x, x[700:750]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in neardup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    assert [got[i].n_links for i in range(600, len(x))] == hit.sum(1)[600:].tolist()


def test_passes_grow_with_the_table():
    assert neardup.passes_for(0) == neardup.passes_for(50_000) == 12
    assert 12 < neardup.passes_for(500_000) < neardup.passes_for(2_000_000) < neardup.passes_for(1_000_000_000)
