"""Exact deduplication against plain grouping; frequent and rare texts, nulls, ties, repeats."""
import hashlib
import random
import re

import pytest

from tidewatch.llm import exactdedup

KIND = "doc_id long, text string, digest string, row int, keep string"


def made():
    r = random.Random(3)
    texts = ["", None, " ", "\t\n ", "a b", "a\x0b b", "a  b", "A b", "a b", "word " * 100_000]
    out = [(r.choice([None, *range(400)]), r.choice(texts)) for _ in range(300)]
    out += [(1000 + i, "hot  text" if i % 2 else "hot text") for i in range(500)] + [(1000, "hot text")] * 40  # half of all rows, the first of them repeated
    return out + [(5000 + i, f"text {i % 150}") for i in range(300)] + [(None, "of no id"), (None, "of no id")]


def known(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(known(text), []).append(doc_id)
    out = []
    for sha, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), n == 0, sha) for n, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("share, tracked", [(exactdedup.SHARE, exactdedup.TRACKED), (16, 128), (2, 16)])
def test_copies(spark, share, tracked):
    rows = made()
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], KIND).repartition(5)
    got = exactdedup.copies(docs, share, tracked)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    stay = exactdedup.remove_copies(docs, share, tracked)
    assert stay.columns == docs.columns
    assert sorted((str(r.doc_id), known(r.text)) for r in stay.collect()) == sorted((str(e[1]), e[4]) for e in expected(rows) if e[3])


def test_every_frequent_digest_is_a_winner(spark):
    rows = [(i, f"t{i % 40}" if i % 3 else f"rare {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    d = docs.select("doc_id", exactdedup.digest(docs["text"]).alias("digest"), docs["doc_id"].alias("row"))
    got = {(r.keep.doc_id, r.group_size) for r in exactdedup.winners(d, len(rows), 100, 1024).collect()}
    n, least = {}, {}
    for i, t in rows:
        n[t], least[t] = n.get(t, 0) + 1, min(i, least.get(t, i))
    assert got == {(least[t], c) for t, c in n.items() if c * 100 > len(rows)} and got
    with pytest.raises(ValueError):
        exactdedup.candidates(d, 100, 600)


def test_empty_table(spark):
    docs = spark.createDataFrame([], KIND)
    assert exactdedup.copies(docs).count() == 0 and exactdedup.remove_copies(docs).count() == 0


def test_main_path_is_native(spark):
    plan = exactdedup.copies(spark.createDataFrame(made(), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan
