"""Embedding near-dedup by sorted projection passes.

Each pass orders the distinct vectors lexicographically by BITS concatenated random hyperplane
hashes and cuts the order into runs of RUN; every vector meets those of its own run and of the one
before, and pairs are verified by cosine in double precision. Every vector carries its runs of all
passes, so a pair is verified in the first pass it meets in. A task gives a spanning forest of its
new links, which components() unites across passes: rows grow with vectors, not with pairs.

The number of passes follows from the number of vectors, so that an isolated pair at the threshold
is met with probability RECALL at any size (passes_for). Links are then counted exactly within every
found component: its members are dealt into blocks of BLOCK and every pair of blocks is compared.

Null, zero and non-finite vectors link with nothing; vectors of different widths neither. Vectors
equal bit for bit are one class (they link with each other), so a vector repeated without bound
costs one row. Rows of one vec_id with different vectors are separate members; equal rows give equal
rows. Rows with a null vec_id link with nothing. An empty table gives an empty one; other columns are
ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, table

#: PASSES is the least number of passes.
COSINE, PASSES, BITS, RUN, BLOCK, RECALL = 0.9, 12, 32, 256, 1024, 0.99
#: Components above BLOCK members that are broadcast at most; more of them are joined by a shuffle.
SMALL = 1_000_000


def passes_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Passes that meet a pair at the threshold with probability recall, among n vectors.

    A pair meets when its first L bits agree, where n / 2**L vectors fill the 1.5 runs a vector sees on average.
    """
    bit = 1 - np.arccos(min(cosine, 1.0)) / np.pi
    one = min(bit ** max(np.log2(max(n, 1) / (1.5 * RUN)), 0.0), 0.99)
    return max(PASSES, int(np.ceil(np.log(1 - recall) / np.log(1 - one))))


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, float) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verify(f: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """A forest of the new links of the vectors of one run, among themselves and with those of the run before."""
    out = []
    for (p, _), g in f.groupby(["pass", f["embedding"].map(len)]):
        own = g["own"].to_numpy()
        ids, runs = g["cls"].to_numpy(), np.stack(g["runs"].to_numpy())
        x = _unit(g["embedding"])
        hit = (x @ x.T >= cosine) & (own[:, None] | own[None, :])
        np.fill_diagonal(hit, False)
        for q in range(p):  # verified already, in an earlier pass
            hit &= abs(runs[:, q][:, None] - runs[:, q][None, :]) > 1
        hit |= hit.T
        some = np.flatnonzero(hit.any(axis=1))
        seen = np.zeros(len(ids), bool)
        for s in some:
            todo = [] if seen[s] else [s]
            seen[s] = True
            while todo:
                v = todo.pop()
                new = np.flatnonzero(hit[v] & ~seen)
                seen[new] = True
                out += [(ids[v], ids[u]) for u in new]
                todo += new.tolist()
    return pd.DataFrame({"cls": [r[0] for r in out], "other": [r[1] for r in out]}, dtype="int64")


def links(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, seed: int = 0) -> DataFrame:
    """(cls, other) from distinct finite vectors (cls, embedding): forests of the links found."""
    def project(frames):
        planes = {}
        for f in frames:
            for n, g in f.groupby(f["embedding"].map(len)):
                if n not in planes:
                    planes[n] = np.random.default_rng((seed, n)).standard_normal((passes * BITS, n))
                bits = (_unit(g["embedding"]) @ planes[n].T > 0).reshape(len(g), passes, BITS)
                key = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pd.DataFrame({"cls": np.repeat(g["cls"].to_numpy(), passes), "pass": np.tile(np.arange(passes), len(g)), "key": key.ravel()})

    keyed = vectors.select("cls", "embedding").mapInPandas(project, "cls long, pass int, key long")
    # a global order without one task: ranges of (pass, key), then offsets from the ranges' sizes
    ranged = cut(keyed.repartitionByRange("pass", "key", "cls").withColumn("part", F.spark_partition_id()))
    start, total = [], 0
    for r in ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        start.append((r.part, total))
        total += r.n
    first = F.broadcast(vectors.sparkSession.createDataFrame(start, "part int, first long"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("pass", "key", "cls")) - 1
    order = ranged.withColumn("at", at).join(first, "part")
    runs = order.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("pass", ((F.col("at") + F.col("first")) / RUN).cast("long").alias("run")))).alias("r"))
    v = vectors.join(runs, "cls").select("cls", "embedding", F.col("r.run").alias("runs"))
    both = v.select("*", F.posexplode("runs").alias("pass", "run")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("own"))
    both = both.withColumn("run", F.col("run") + F.when(F.col("own"), 0).otherwise(1))
    return both.groupBy("run").applyInPandas(lambda f: _verify(f, cosine), "cls long, other long")


def _count(f: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Copies linked with every vector, over one pair of blocks of a component or over whole small components."""
    ids, n = [], []
    for _, g in f.groupby("comp"):
        first, second = (g[g["block"] == g[k].iloc[0]] for k in ("i", "j"))
        x, y = _unit(first["embedding"]), _unit(second["embedding"])
        hit = x @ y.T >= cosine
        if g["i"].iloc[0] == g["j"].iloc[0]:
            np.fill_diagonal(hit, False)
        else:
            ids.append(second["cls"].to_numpy())
            n.append(hit.T @ first["copies"].to_numpy())
        ids.append(first["cls"].to_numpy())
        n.append(hit @ second["copies"].to_numpy())
    return pd.DataFrame({"cls": np.concatenate(ids), "links": np.concatenate(n)})


def count(members: DataFrame, n: int, cosine: float = COSINE) -> DataFrame:
    """(cls, n): the copies linked with each of members (comp, cls, copies, embedding), n vectors at most."""
    large = members.groupBy("comp").agg(F.count("*").alias("size")).where(f"size > {BLOCK}").select(F.col("comp").alias("_c"), F.ceil(F.col("size") / BLOCK).alias("blocks"))
    # n vectors have n / BLOCK such components at most, which bounds the broadcast
    large = F.broadcast(large) if n <= SMALL * BLOCK else large
    m = members.join(large, F.col("comp") == F.col("_c"), "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("cls"), "blocks"), F.lit(0)))
    m = m.withColumn("o", F.explode(F.expr("sequence(0L, coalesce(blocks, 1L) - 1)")))
    # small components share tasks by hash
    batch = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("comp"), F.lit(n // (4 * BLOCK) + 1))).otherwise(F.col("comp"))
    m = m.select("comp", "cls", "copies", "embedding", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.col("blocks").isNull().alias("small"), batch.alias("batch"))
    got = m.groupBy("small", "batch", "i", "j").applyInPandas(lambda f: _count(f, cosine), "cls long, links long")
    return got.groupBy("cls").agg(F.sum("links").alias("n"))


def link(emb: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of (vec_id, embedding): vec_id, n_links, component_id, kept."""
    ok = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    # a class is known by the hash of its vector
    d = emb.select("vec_id", "embedding", F.when(F.coalesce(ok, F.lit(False)), F.xxhash64("embedding")).alias("cls"))
    cls = cut(d.where("cls is not null").groupBy("cls").agg(
        F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("copies"), F.first("embedding").alias("embedding")))
    size = cls.count()
    found = links(cls, cosine, passes_for(size, cosine))
    comp = cut(components(found.select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cls"))
    n = count(comp.join(cls, "cls"), size, cosine)
    of = cls.join(comp, "cls", "left").select("cls", "least", "copies", F.coalesce("comp", "cls").alias("comp"))
    info = of.join(of.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").join(n, "cls", "left").select(
        "cls", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = d.select("vec_id", "cls").join(info, "cls", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id"))


def op4_neardup(spark, sf_dir):
    return link(table(spark, sf_dir, "embeddings"))
