"""Centroid clustering by sort-means, in whole numbers.

Vectors of WIDTH finite components become integers floor(SCALE * x), which makes every distance, sum
and tie exact. Each round sorts, for every centroid, the other centroids by their distance from it.
A vector starts from the centroid it was assigned to in the round before (the first one in round 1)
and looks at the others in that order, and stops at the first that lies strictly beyond twice its
distance from its own centroid: no later one can be as near (triangle inequality; squared distances,
hence a factor of 4). Ties go to the smaller number.

Rounds run as one map over a table (row, components, last assignment) in the shared folder, which each
round writes anew, so that a lost executor costs a few tasks. Sums are combined map-side and only
k x WIDTH of them come to the driver. Centroids are k x WIDTH whole numbers in the tasks' closure.

Vectors of another width, null ones and those with null or non-finite components are left out.
Integers beyond LIMIT either way are held at it: four squared distances then fit 64 bits. A null vec_id
is clustered like others but never starts a centroid. Rows that repeat a vec_id are vectors of their
own; of those the start prefers the smallest components. With fewer than k vectors there are fewer
centroids; an empty table gives an empty one. Other columns are ignored, whatever their names.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

CENTROIDS, ROUNDS, WIDTH, SCALE, LIMIT = 16, 3, 64, 64, 1 << 26


def whole(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as integers."""
    ok = F.expr(f"embedding is not null and size(embedding) = {width} and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))")
    held = f"transform(embedding, x -> cast(greatest(least(floor(greatest(least(cast(x as double), {LIMIT}D), -{LIMIT}D) * {scale}), {LIMIT}L), -{LIMIT}L) as int))"
    return vectors.where(ok).select("vec_id", F.expr(held).alias("v"))


def start(vectors: DataFrame, k: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order."""
    named = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    return np.array([r.v for r in named.orderBy("hash", "v").limit(k).collect()], np.int64)


def nearest(x: np.ndarray, last: np.ndarray, centroids: np.ndarray, order: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(assignment, squared distance) of every row of x, and how many distances were worked out."""
    best = last.copy()
    own = ((x - centroids[last]) ** 2).sum(axis=1)
    least, live, looked = own.copy(), np.arange(len(x)), len(x)
    for nth in range(1, len(centroids)):
        c = order[last[live], nth]
        near = between[last[live], c] <= 4 * own[live]
        live, c = live[near], c[near]
        if not len(live):
            break
        looked += len(live)
        d = ((x[live] - centroids[c]) ** 2).sum(axis=1)
        better = (d < least[live]) | ((d == least[live]) & (c < best[live]))
        best[live[better]], least[live[better]] = c[better], d[better]
    return best, least, looked


def _assign(frames, centroids: np.ndarray):
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(between, axis=1, kind="stable")
    for k in range(len(order)):  # equal centroids lie at distance 0 from each other too
        order[k] = np.concatenate([[k], order[k][order[k] != k]])
    for f in frames:
        if len(f):
            x = np.stack(f["v"].to_numpy()).astype(np.int64)
            cluster, distance, _ = nearest(x, f["cluster"].to_numpy(), centroids, order, between)
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "cluster": cluster.astype(np.int32), "distance": distance})


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (vec_id, v, cluster) with cluster, distance from their nearest centroid; cluster is where the scan starts."""
    kind = f"vec_id {dict(vectors.dtypes)['vec_id']}, v array<int>, cluster int, distance long"
    return cut(vectors.select("vec_id", "v", "cluster").mapInPandas(lambda frames: _assign(frames, centroids), kind))


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their vectors' exact means; those without vectors stay."""
    out = centroids.copy()
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("v", F.lit(k)).cast("long")) for k in range(centroids.shape[1])]).alias("s"))
    for r in sums.collect():  # one row per centroid
        out[r.cluster] = [s // r.n for s in r.s]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1, width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, cluster, distance) of every kept vector, the final centroids)."""
    d = cut(whole(vectors.select("vec_id", "embedding"), width, scale).withColumn("cluster", F.lit(0)))
    centroids = start(d, k, seed)
    if not len(centroids):
        return d.withColumn("distance", F.lit(0).cast("long")).limit(0), centroids
    for _ in range(rounds):
        d = assign(d, centroids)
        centroids = moved(d, centroids)
    return assign(d, centroids), centroids


def op13_clusters(spark, sf_dir):
    return report(*cluster(table(spark, sf_dir, "embeddings")))


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; sums that no long holds are null."""
    spark, fits = assigned.sparkSession, lambda x: x if x < 1 << 63 else None
    of = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, fits(s), fits(sum(of.values())), sha[c]) for c, s in of.items()]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    """The same clustering over all pairs of vectors and centroids."""
    near = """a{t} AS (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT x.r, c.k, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x, c{t} c) GROUP BY r)"""
    move = """m{t} AS (SELECT k, list(m ORDER BY i) AS v FROM (SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT a.k, i, sum(x.v[i]) AS s, count(*) AS n
  FROM a{t} a JOIN x USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY a.k, i)) GROUP BY k),
c{u} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN m{t} m USING (k))"""
    steps = ",\n".join(f"{near.format(t=t)},\n{move.format(t=t, u=t + 1)}" for t in range(rounds))
    return f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),
{steps},
{near.format(t=rounds)}
SELECT x.vec_id, CAST(a.k AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN x USING (r) JOIN c{rounds} c USING (k)"""


ORACLES = {"op13_clusters": _sql()}
