"""Shared helpers: table reading, lineage cuts, words, connected components."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of a word: space and \t \n \v \f \r.
SEP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary folder serves only where driver and executors are one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def cut(df: DataFrame) -> DataFrame:
    """df as a compressed table written to the shared folder, which ends its lineage."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def words(text):
    """Column of words `[^\\x20\\x09-\\x0D]+`; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEP), "")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every endpoint of edges (a, b): comp is the smallest id reachable.

    Alternating large-star and small-star rounds; each is one min per vertex and one join, so a
    hub costs one row per neighbour. Rounds end when the edge set stops changing; every one before that
    moves an edge to a smaller id, so they do end.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("a", "b", "m")
        e = cut(
            small.select(F.col("m").alias("a"), "b")
            .unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
            .where("a < b")
            .distinct()
        )
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("comp")).unionByName(
        e.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct().join(
            e.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
