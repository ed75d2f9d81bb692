"""N-gram Jaccard join by MinHash banding.

Shingles are SHINGLE consecutive words, A-Z lower-cased; a shorter text is one shingle of all its
words, and texts without words link with nothing but their exact copies. Equal texts are one class,
known by the hash of the text and worked on once. banding() chooses bands and rows for the target
recall. Classes meet in the shuffle on band hashes; candidates() turns buckets into units of work: a
group of classes that buckets connect is one unit where that compares fewer pairs than its buckets,
else each bucket is. So a shingle set travels once for nearly all groups, however many bands agree.
A unit of more than BLOCK classes is dealt into blocks and each pair of blocks is a task of its own:
nothing is collected whole and nothing is capped. Pairs are verified on full shingle sets inside the
task, in a bucket only in the first band they share. A task gives per class its number of links, and
a spanning forest of them: rows grow with classes, not with pairs.

Null text counts as empty. Equal rows are copies; rows of one doc_id with different texts are members
of different classes; a null doc_id names a class only where it has no other. An empty table gives an
empty one; other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, table

SHINGLE, SIMILARITY, RECALL, BLOCK = 5, 0.8, 0.9995, 1024
#: Most hash functions of a signature, and words worked on at once.
HASHES, CHUNK = 100, 1 << 15
#: Shingles, and rows of links, that a matrix of links is worked out for at once.
COLUMNS, ROWS_AT_ONCE = 1024, 128


def banding(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): most rows, so fewest chance candidates, that find a pair at the similarity with the recall."""
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("too few hash functions for the recall")


BANDS, ROWS = banding()


def _mix(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: bytes | None) -> np.ndarray:
    import xxhash

    w = (text or b"").lower().split()  # of bytes: A-Z, and the separators space and \t to \r
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def shingles(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles end to end, starts), repeated ones included, of texts of word hashes."""
    size = np.array([len(w) for w in texts], np.int64)
    n = np.where(size > 0, np.maximum(size - SHINGLE + 1, 1), 0)
    at, first = np.concatenate([[0], np.cumsum(n)]), np.cumsum(size) - size
    flat = np.concatenate([*texts, np.zeros(SHINGLE, np.uint64)])
    where = np.repeat(first - at[:-1], n) + np.arange(at[-1])
    left = np.repeat(size, n)  # a short text ends before the shingle does
    g = np.zeros(len(where), np.uint64)
    for k in range(SHINGLE):
        more = _mix(g * np.uint64(0x9E3779B97F4A7C15) + flat[where + k])
        g = more if k == 0 else np.where(left > k, more, g)
    return g, at


def band_keys(texts: list[np.ndarray]) -> np.ndarray:
    """(texts, BANDS) band hashes of texts of word hashes that have words."""
    g, at = shingles(texts)
    odd = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(texts), 0)
    for b in range(BANDS):
        for k in odd[b * ROWS : (b + 1) * ROWS]:
            out[:, b] = _mix(out[:, b] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(g * k, at[:-1]))
    return out


def _text_hash():
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16)


def signed(docs: DataFrame) -> DataFrame:
    """(h, doc_id, keys): per row the hash of its text and the band hashes, none for a text without words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, counts, part, size = [], [], [], 0
            for t in [*batch.column(2).cast(pa.binary()), None]:
                if t is not None:
                    w = word_hashes(t.as_py())
                    counts.append(BANDS if len(w) else 0)
                    if len(w):
                        part.append(w)
                        size += len(w)
                if part and (t is None or size >= CHUNK):
                    keys.append(band_keys(part).ravel())
                    part, size = [], 0
            values = np.concatenate(keys).view("i8") if keys else np.zeros(0, "i8")
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype("i4"), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["h", "doc_id", "keys"])

    return docs.select(_text_hash().alias("h"), F.col("doc_id").cast("long"), "text").mapInArrow(run, "h binary, doc_id long, keys array<long>")


def candidates(cls: DataFrame) -> DataFrame:
    """(h, unit, band, n): the classes (h, keys) of every unit of n classes; band is -1 for a whole group."""
    keys = cls.select("h", F.posexplode("keys").alias("band", "key"))
    size = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("head")).where("n > 1")
    met = cut(keys.join(size, "key"))
    of = cut(components(met.where("h <> head").select(F.col("head").alias("a"), F.col("h").alias("b"))).withColumnRenamed("id", "h"))
    met = met.join(of, "h")
    cost = met.groupBy("comp").agg(F.sum("n").alias("cost")).join(of.groupBy("comp").agg(F.count("*").alias("m")), "comp").withColumn("whole", F.expr("m * m <= cost"))
    whole = of.join(cost.where("whole"), "comp").select("h", F.xxhash64("comp").alias("unit"), F.lit(-1).alias("band"), F.col("m").alias("n"))
    return whole.unionByName(met.join(cost.where("not whole").select("comp"), "comp").select("h", F.col("key").alias("unit"), "band", "n"))


def _links(sets: list[np.ndarray]) -> np.ndarray:
    """Which of the shingle sets have SIMILARITY at least, exactly in whole numbers."""
    sizes = np.array([len(x) for x in sets])
    kind = np.float32 if sizes.max() < 1 << 23 else np.float64
    uniq, inv = np.unique(np.concatenate(sets), return_inverse=True)
    owner, common = np.repeat(np.arange(len(sets)), sizes), np.zeros((len(sets), len(sets)), kind)
    order = np.argsort(inv, kind="stable")
    cuts = np.searchsorted(inv[order], np.arange(0, len(uniq) + COLUMNS, COLUMNS))
    for lo, (a, b) in zip(range(0, len(uniq), COLUMNS), zip(cuts, cuts[1:])):
        m = order[a:b]
        x = np.zeros((len(sets), min(COLUMNS, len(uniq) - lo)), kind)
        x[owner[m], inv[m] - lo] = 1
        common += x @ x.T
    link = np.empty(common.shape, bool)
    for k in range(0, len(sets), ROWS_AT_ONCE):  # the sums take several times the room of the links
        part = common[k : k + ROWS_AT_ONCE]
        link[k : k + ROWS_AT_ONCE] = 5 * part >= 4 * (sizes[k : k + ROWS_AT_ONCE, None] + sizes[None, :] - part)
    np.fill_diagonal(link, False)
    return link


def _verify(f: pd.DataFrame) -> pd.DataFrame:
    """Links inside the units of one task: whole small units, or one pair of blocks of a large one."""
    own, n, edges = [], [], []
    f = f.sort_values("h").reset_index(drop=True)
    for (band, _), u in f.groupby(["band", "unit"]):
        ids, blk, copies = u["h"].tolist(), u["blk"].to_numpy(), u["copies"].to_numpy()
        g, at = shingles([word_hashes(t.encode()) for t in u["text"]])
        link = _links([np.unique(g[a:b]) for a, b in zip(at, at[1:])])
        if u["i"].iloc[0] != u["j"].iloc[0]:
            link &= blk[:, None] != blk[None, :]
        if band > 0:  # counted already, in an earlier band
            keys = np.stack(u["keys"].to_numpy())
            for b in range(band):
                link &= keys[:, b][:, None] != keys[:, b][None, :]
        hit = np.flatnonzero(link.any(axis=1))
        own += [ids[k] for k in hit]
        n += [int(copies[link[k]].sum()) for k in hit]
        # a spanning forest of the links keeps their components
        seen = np.zeros(len(ids), bool)
        for s in hit:
            todo = [] if seen[s] else [s]
            seen[s] = True
            while todo:
                v = todo.pop()
                new = np.flatnonzero(link[v] & ~seen)
                seen[new] = True
                edges += [(ids[v], ids[u2]) for u2 in new]
                todo += new.tolist()
    return pd.DataFrame({"h": own + [a for a, _ in edges], "links": n + [0] * len(edges), "other": [None] * len(own) + [b for _, b in edges]})


def classes(docs: DataFrame) -> DataFrame:
    """(h, least, copies, n_links, comp): every distinct text, its least doc_id, and the hash that names its group."""
    cls = cut(signed(docs).groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("keys").alias("keys")))
    c = cut(candidates(cls))
    batches = c.count() // 4096 + 1
    c = c.withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("h"), F.col("g")).cast("int"))
    c = c.withColumn("o", F.explode(F.expr("sequence(0, g - 1)")))
    batch = F.when(F.col("g") == 1, F.pmod(F.xxhash64("unit"), F.lit(batches))).otherwise(F.xxhash64("unit", "band"))
    c = c.select("h", "unit", "band", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), (F.col("g") == 1).alias("small"), batch.alias("batch"))
    # equal texts are one before they are shuffled
    texts = docs.select(_text_hash().alias("h"), F.coalesce("text", F.lit("")).alias("text")).groupBy("h").agg(F.first("text").alias("text"))
    rows = c.join(cls.select("h", "copies", "keys"), "h").withColumn("keys", F.when(F.col("band") >= 0, F.col("keys"))).join(texts, "h")
    found = cut(rows.groupBy("small", "batch", "i", "j").applyInPandas(_verify, "h binary, links long, other binary"))
    n = found.where("other is null").groupBy("h").agg(F.sum("links").alias("n_links"))
    comp = components(found.where("other is not null").select(F.col("h").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "h")
    return cut(cls.drop("keys").join(n, "h", "left").join(comp, "h", "left").select(
        "h", "least", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("comp", "h").alias("comp")))


def link(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id, component_id, n_links (links to other texts, copies counted), kept.

    class_id is the smallest doc_id of the exact copies, component_id the smallest reachable by
    links; the row with doc_id = component_id is kept.
    """
    c = classes(docs)
    info = c.join(c.groupBy("comp").agg(F.min("least").alias("component_id")), "comp")
    return docs.select("doc_id", _text_hash().alias("h")).join(info, "h").select(
        "doc_id", F.col("least").alias("class_id"), "component_id", "n_links", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One whole row of every group of near or exact copies: that with the least doc_id, nulls last."""
    rank = F.struct(F.col("least").isNull(), "least", "h")
    best = classes(docs).groupBy("comp").agg(F.min(rank).alias("r")).select("r.h")
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *rest)
    one = docs.select(_text_hash().alias("h"), F.struct(*docs.columns).alias("row"), order.alias("order")).groupBy("h").agg(F.min_by("row", "order").alias("row"))
    return one.join(best, "h", "left_semi").select("row.*")


def op8_jaccard(spark, sf_dir):
    return link(table(spark, sf_dir, "documents"))
