"""Corpus pipeline: quality rules, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir); run() writes every result as Parquet to the shared folder
and reads it again as the next stage's docs. Null and empty texts fail the quality rules; rows of a
null or a repeated doc_id are documents of their own, unless their texts are near or exact copies;
a stage given an empty table returns an empty one.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.llm import bpe, jaccard, mixing, pii, quality
from tidewatch.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return quality.judge(docs.select(COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near or exact copies stays, that with the smallest doc_id, nulls last."""
    return jaccard.one_of_each(docs.select(COLUMNS))


def personal_data(spark, docs, sf_dir):
    """Found spans are replaced by their kinds."""
    return pii.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark, docs, sf_dir):
    """Each document occurs as often as the mix takes it whole; every range of chosen blocks besides is a row, as it stands in the text."""
    return mixing.taken_texts(mixing.mix(docs.select(COLUMNS))).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encode_bytes(spark, docs, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every row."""
    import public_tokenizers as P

    return bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("encode_bytes", encode_bytes),
]

#: Hash-driven choices, trained spans and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    where, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
