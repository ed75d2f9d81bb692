"""Sort-means against plain assignment in Python integers; nulls, odd vectors, ties, repeats."""
import hashlib
import math
import random

import numpy as np

from tidewatch.llm import clustering

KIND = "vec_id long, embedding array<double>, cluster string, v int, distance string"
LIMIT = clustering.LIMIT


def made(n=400):
    r = random.Random(1)
    near = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    out = [(i, [c + r.gauss(0, 0.1) for c in r.choice(near)]) for i in range(n)]
    out += [(9000, out[3][1]), (3, out[3][1]), (3, out[3][1]), (3, out[4][1]), (None, out[5][1])]
    coarse = [(10_000 + i, [r.choice([0.0, 1 / 64]) for _ in range(64)]) for i in range(150)]  # many equal distances
    return out + coarse + [(20_000, None), (20_001, []), (20_002, [1.0] * 63), (20_003, [1.0] * 65), (20_004, [None] + [1.0] * 63), (20_005, [math.nan] * 64),
                           (20_006, [math.inf] + [0.0] * 63), (20_007, [1e300] + [-1e300] + [5e-324] * 62), (20_008, [-0.0] * 64)]


def expected(rows, k=16, rounds=3):
    kept = [(i, [max(-LIMIT, min(LIMIT, math.floor(64 * max(-LIMIT, min(LIMIT, x))))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in first[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        at = [min((d2(v, x), j) for j, x in enumerate(c)) for _, v in kept]
        if step == rounds:
            break
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a[1] == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    per, every = {}, sum(d for d, _ in at)
    for d, j in at:
        per[j] = per.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, d, fits(per[j]), fits(every), sha[j]) for (i, _), (d, j) in zip(kept, at)), key=str)


def test_clusters_equal_plain_assignment(spark):
    rows = made()
    v = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], KIND).repartition(5)
    assert sorted(map(tuple, clustering.report(*clustering.cluster(v)).collect()), key=str) == expected(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = made(6)[:7]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, clustering.report(*clustering.cluster(v)).collect()), key=str) == expected(rows)
    assert clustering.report(*clustering.cluster(v.limit(0))).count() == 0


def test_the_scan_stops_early_and_loses_nothing():
    r = np.random.default_rng(2)
    c = r.integers(-500, 500, (16, 64))
    x = (c[r.integers(0, 16, 3000)] + r.integers(-40, 40, (3000, 64)))
    between = ((c[:, None] - c[None]) ** 2).sum(2)
    order = np.argsort(between, axis=1, kind="stable")
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    best, least, looked = clustering.nearest(x, every.argmin(1), c, order, between)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all() and looked < 3000 * 3
    best, least, _ = clustering.nearest(x, np.zeros(3000, np.int64), c, order, between)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
