"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share all words; a target
stops at CAP times its source's size and the excess is shared again by weight. The words to take are
cut into equal blocks (seats) of BLOCK words, smaller where a target has few words; highest quotients
give them to the sources, then those of a source to its shards, at most CAP times the size of each.
A shard holds about SHARD_WORDS words of one source, by hash of (doc_id, text). Of every shard whole
rounds of its quota take all texts; the rest takes the blocks of its texts with the lowest seeded
hash, the last one in part.

Equal rows are chosen alike, and count as often as they occur, so however many of them share a shard
its quota holds to a word each. Only hashes and sizes are shuffled; the choice is applied to the
texts where they lie, through one row per shard.

Null or wordless texts have size 0 and are never taken. An empty table gives an empty one. A column
of docs named like one of the computed columns is replaced by it. The list of sources is collected:
it is as long as the mix has weights.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEP, cut, table, words

CAP, BLOCK, SHARD_WORDS = 3, 64, 500_000
COLUMNS = ("size", "source_size", "target", "rounds", "parts", "taken")


def targets(sizes: list[float], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap times its size."""
    sizes, weights = np.array(sizes, float), np.array(weights, float)
    out, free, left = np.zeros(len(sizes)), sizes > 0, float(sizes.sum())
    while free.any():
        share = left * weights / weights[free].sum()
        over = free & (share > cap * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = cap * sizes[over]
        left -= float(out[over].sum())
        free &= ~over
    return out.tolist()


def sainte_lague(votes, seats: int, most) -> np.ndarray:
    """Integer quotas by the highest quotients votes / (2 j + 1); none above most, ties to the first."""
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    lo, hi = 0.0, float(votes.max(initial=0)) + 1
    given = lambda q: np.minimum(np.ceil(np.maximum(votes / q - 1, 0) / 2), most).astype(np.int64)
    for _ in range(60):  # the least quotient q whose seats strictly above it fit
        q = (lo + hi) / 2
        if q < 1e-9:
            break
        lo, hi = (q, hi) if given(q).sum() > seats else (lo, q)
    got = given(hi) if hi else np.zeros(len(votes), np.int64)
    left = seats - int(got.sum())
    while left > 0:
        quotient = np.where(got < most, votes / (2 * got + 1), -1)
        best = np.argsort(-quotient, kind="stable")[: max(1, min(left, int((quotient == quotient.max()).sum())))]
        got[best] += 1
        left -= len(best)
    return got


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs with size, source_size, target, rounds, parts, taken.

    A row is taken rounds times whole; parts are the word ranges [f, t) of its chosen blocks besides.
    """
    spark = docs.sparkSession
    docs = docs.drop(*COLUMNS)
    d = docs.withColumn("size", F.size(words(F.col("text"))).cast("long")).withColumn("_k", F.xxhash64("doc_id", "text"))
    kinds = cut(d.groupBy("source", "_k", "size").agg(F.count("*").alias("_m")))
    per = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("_m")).alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    want = targets([r.n for r in per], [1 + i % 3 for i in range(len(per))])
    seat = max(1, min(BLOCK, int(min((t for t in want if t > 0), default=0) // 256)))
    seats = sainte_lague(want, round(sum(want) / seat), [CAP * r.n // seat for r in per]).tolist()
    info = spark.createDataFrame(
        [(r.source, r.n, t, -(-r.n // SHARD_WORDS) or 1, q) for r, t, q in zip(per, want, seats)],
        "_s string, source_size long, target double, _shards long, _seats long")

    def sharded(df):
        j = df.join(info, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return j.withColumn("_shard", F.pmod(F.xxhash64("_k", F.lit(seed + 1)), F.col("_shards")))

    def quotas(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_shard")
        q = sainte_lague(f["_words"], int(f["_seats"].iloc[0]), CAP * f["_words"] // seat)
        return pd.DataFrame({"_q_source": f["source"], "_q_shard": f["_shard"], "_words": f["_words"], "_take": q * seat})

    of = sharded(kinds).where("size > 0")
    shards = of.groupBy("source", "_shard").agg(F.sum(F.col("size") * F.col("_m")).alias("_words"), F.first("_seats").alias("_seats"))
    q = shards.groupBy("source").applyInPandas(quotas, "_q_source string, _q_shard long, _words long, _take long")
    # block j of nb covers words [j * size div nb, (j + 1) * size div nb) of its text
    of = of.withColumn("_nb", F.ceil(F.col("size") / BLOCK)).withColumn("j", F.explode(F.expr("sequence(0L, _nb - 1)")))
    of = of.select("source", "_shard", F.expr(f"xxhash64(_k, j, {seed + 2}L)").alias("_u"), "_k", "j", "_m", F.expr("_m * ((j + 1) * size div _nb - j * size div _nb)").alias("_w"))
    w = Window.partitionBy("source", "_shard").orderBy("_u", "_k", "j").rowsBetween(Window.unboundedPreceding, 0)
    of = of.withColumn("_upto", F.sum("_w").over(w)).join(q, F.col("source").eqNullSafe(F.col("_q_source")) & (F.col("_shard") == F.col("_q_shard")))
    # a row per shard: its rounds, and the block at which the rest of its quota ends, taken for _x words
    last = of.withColumn("_rest", F.expr("_take % _words")).where("_upto - _w <= _rest and _rest < _upto")
    last = cut(last.select("_q_source", "_q_shard", F.expr("_take div _words").alias("_rounds"), "_u", F.expr("(_rest - _upto + _w) div _m").alias("_x")))

    d = sharded(d).join(last, F.col("source").eqNullSafe(F.col("_q_source")) & (F.col("_shard") == F.col("_q_shard")), "left")
    d = d.withColumn("_nb", F.greatest(F.ceil(F.col("size") / BLOCK), F.lit(1).cast("long")))
    u = lambda b: f"xxhash64(_k, {b}, {seed + 2}L)"
    chosen = lambda b: f"({u(b)} < _u or ({u(b)} = _u and _x > 0))"
    # chosen blocks that follow each other are one range; a block taken in part ends its range
    parts = F.expr(f"""if(size = 0 or _u is null, cast(array() as array<struct<f:bigint,t:bigint>>), zip_with(
        filter(sequence(0L, _nb - 1), b -> {chosen('b')} and (b = 0 or not {chosen('b - 1')} or {u('b - 1')} = _u)),
        filter(sequence(0L, _nb - 1), b -> {chosen('b')} and (b = _nb - 1 or not {chosen('b + 1')} or {u('b')} = _u)),
        (x, y) -> named_struct('f', x * size div _nb, 't', if({u('y')} = _u, y * size div _nb + _x, (y + 1) * size div _nb))))""")
    d = d.withColumn("rounds", F.expr("if(size = 0, 0L, coalesce(_rounds, 0L))")).withColumn("parts", parts)
    taken = F.expr("size * rounds + aggregate(parts, 0L, (a, x) -> a + x.t - x.f)")
    return d.select(*docs.columns, "size", "source_size", "target", "rounds", "parts", taken.alias("taken"))


def taken_texts(mixed: DataFrame) -> DataFrame:
    """A row per whole copy and per range that mix() takes; a range keeps the separators between its words."""
    # a generator's output: the pieces are cut once a text, not once a range
    pieces = F.expr(rf"if(exists(parts, p -> p.t - p.f < size), regexp_extract_all(text, r'[^\x20\x09-\x0D]+{SEP[:-1]}*', 0), cast(array() as array<string>))")
    m = mixed.where("taken > 0").withColumn("_p", F.explode(F.array(pieces)))
    piece = F.transform("parts", lambda p: F.when(p["t"] - p["f"] == F.col("size"), F.col("text")).otherwise(
        F.rtrim(F.array_join(F.slice("_p", (p["f"] + 1).cast("int"), (p["t"] - p["f"]).cast("int")), ""), F.lit(" \t\n\v\f\r"))))
    texts = F.concat(F.array_repeat("text", F.col("rounds").cast("int")), piece)
    return m.withColumn("text", F.explode(texts)).drop("_p")


def op3_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sizes(spark, sf_dir):
    """The columns of op3_mix that SQL can express."""
    return op3_mix(spark, sf_dir).select("doc_id", "size", "source_size")


ORACLES = {"mix_sizes": r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents)
SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM d"""}
