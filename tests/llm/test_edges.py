"""Odd rows: infinite, huge and mixed vectors, texts of a million letters, null ids, clashing names, tables of one repeated row."""
import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidewatch.llm import bpe, exactdedup, jaccard, licenses, lm, neardup
from tidewatch.llm.sharding import Store

CLASH = ("x", "h", "g", "cls", "comp", "run", "block", "kept", "n_links", "component_id", "group_size", "label", "first", "n_tokens", "_d", "version")


def clashing(df):
    """df with further columns that are named like those that operators work with."""
    return df.select("*", *[F.lit("own").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def long_texts(spark):
    rows = [(None, "a" * 1_000_000), (1, "7" * 300_000), (2, "mit license " * 20_000), (3, None), (4, "plain words here")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_vectors_that_are_infinite_huge_tiny_or_of_other_widths(spark):
    inf = float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1e300, 2e300]), (3, [1e-300, 2e-300]), (4, [inf, 1.0]), (5, [-inf, inf]), (6, [1.0, 2.0, 0.0]),
            (7, [2.0, 4.0, 0.0]), (8, [None, 1.0]), (9, [-1.0, -2.0]), (9, [-1.0, -2.0])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.link(clashing(emb)).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True),
                   (7, 1, 6, False), (8, 0, 8, True), (9, 0, 9, True), (9, 0, 9, True)]


def test_long_texts_are_encoded_as_the_library_does(long_texts):
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(clashing(long_texts), path, P.PATTERN).collect()}
    for r in long_texts.collect():
        ids = enc.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_long_texts_are_scored(long_texts):
    got = {r.doc_id: r for r in lm.score(clashing(long_texts), lambda d: d == 4).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == {None: 2, 1: 2, 2: 40_001, 3: 1, 4: 4}
    assert {r.train_tokens for r in got.values()} == {2 + 2 + 40_001 + 1}
    assert got[4].n_known == 1 and all(np.isfinite(r.score) and r.score < 0 for r in got.values())


def test_license_places_in_long_texts_and_repeated_rows_without_id(spark, long_texts):
    rows = clashing(long_texts.unionByName(spark.createDataFrame([(None, "MIT  License, cc-by")] * 2, "doc_id long, text string")))
    got = licenses.scan(rows).where("base").groupBy("doc_id", "label").count().collect()
    assert sorted((str(r.doc_id), r.label, r["count"]) for r in got) == [("2", "mit", 20_000), ("None", "cc-by", 1), ("None", "mit", 1)]


def test_a_table_of_one_repeated_text(spark):
    docs = clashing(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the same few words in every one of them").alias("text")))
    got = jaccard.link(docs).select("component_id", "n_links").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 0)]  # links are those between different texts
    assert [r.doc_id for r in jaccard.one_of_each(docs).collect()] == [0]
    assert [r.doc_id for r in exactdedup.remove_copies(docs).collect()] == [0]


def test_an_empty_arrival_and_extra_columns(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    docs = clashing(spark.createDataFrame([(1, "a"), (None, None), (None, None)], "doc_id long, text string")).drop("version")
    store.append([docs.limit(0)])
    assert store.read().count() == 0 and store.manifest()[0].rows == 0
    store.append([docs])
    assert store.read().count() == 3 and set(docs.columns) < set(store.read().columns)
