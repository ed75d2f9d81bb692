"""Exact deduplication with a heavy-hitter split. Native.

Texts are equal when they are so after every run of `[\\x20\\x09-\\x0D]` became one space; a text is
known by the SHA-256 of that form. Each text is read once, where it lies, and only (doc_id, digest,
row number) goes on, as a table in the shared folder.

1. Misra-Gries: every task keeps the frequent-items summary of its digests' hashes (TRACKED counters,
   all of them lowered where they run out, so a count is too low by 3.5 / TRACKED of the rows at most),
   and summaries are merged in three levels. Every digest with more than 1 / SHARE of the rows is
   certain to be among the candidates.
2. The candidates' rows are counted exactly by their whole digests, combined map-side. Those with more
   than 1 / SHARE of the rows win; there are SHARE of them at most, at any size.
3. The winners are broadcast and their rows settled where they lie. The rest is shuffled by digest
   once; no group of it has more than 1 / SHARE of the rows.

Null and empty texts are equal to each other, and a text of nothing but separators equals one space.
Of equal texts the row with the smallest doc_id stays, a null doc_id counting as larger than all; of
rows that share that id one stays, so exactly one row per group is kept, whatever is repeated. Very
long texts are texts like others. An empty table gives an empty one. Columns of documents other than
doc_id and text are ignored by copies() and returned by remove_copies(), whatever their names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEP, cut, table

#: Digests with more than 1 / SHARE of the rows are heavy; a multiple of 7 * SHARE counters finds all of them.
SHARE, TRACKED = 8192, 65_536


def digest(text):
    """SHA-256 of a text with single spaces, as bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SEP, " "), 256))


def candidates(digests: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """(hash): hashes of digests, among them all of those with more than 1 / share of the rows; tracked at most."""
    if tracked < 7 * share:
        raise ValueError(f"{tracked} counters cannot tell shares of 1 / {share}")
    d = digests.select(F.xxhash64("digest").alias("hash"), F.pmod(F.spark_partition_id(), F.lit(1024)).alias("g"))
    s = d.groupBy("g").agg(F.expr(f"approx_top_k_accumulate(hash, {tracked})").alias("s"))
    for n in (32, 1):  # groups, or an empty table would have one
        s = s.groupBy((F.col("g") % n).alias("g")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    return s.select(F.explode(F.expr(f"approx_top_k_estimate(s, {tracked})")).alias("t")).select("t.item")


def winners(digests: DataFrame, rows: int, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """(digest, keep, group_size) of the digests with more than 1 / share of the rows, counted exactly."""
    c = candidates(digests, share, tracked).where("item is not null").select(F.col("item").alias("hash"))
    d = digests.join(F.broadcast(c), F.xxhash64("digest") == F.col("hash"), "left_semi")  # `tracked` longs at most
    return d.groupBy("digest").agg(F.min(_row()).alias("keep"), F.count("*").alias("group_size")).where(F.col("group_size") * share > rows)


def _row():
    """The order in which rows of one text are preferred."""
    return F.struct(F.col("doc_id").isNull(), "doc_id", "row")


def settle(digests: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """digests (doc_id, digest, row) with keep_id, group_size and kept."""
    heavy = cut(winners(digests, digests.count(), share, tracked))  # share rows at most
    own = digests.columns
    found = digests.join(F.broadcast(heavy), "digest").select(*own, "keep", "group_size")
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        *own, F.min(_row()).over(group).alias("keep"), F.count("*").over(group).alias("group_size"))
    return found.unionByName(rest).select(*own, F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"))


def copies(docs: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    d = cut(docs.select("doc_id", digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")))
    return settle(d, share, tracked).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def remove_copies(docs: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    d = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row")))
    t = cut(d.select(F.col("_doc.doc_id"), digest(F.col("_doc.text")).alias("digest"), F.col("_row").alias("row")))
    stay = settle(t, share, tracked).where("kept").select(F.col("row").alias("_row"))
    return d.join(stay, "_row", "left_semi").select("_doc.*")


def op11_exactdedup(spark, sf_dir):
    return copies(table(spark, sf_dir, "documents"))


ORACLES = {"op11_exactdedup": r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY doc_id NULLS LAST, r)"""}
