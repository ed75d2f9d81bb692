"""The stages of the pipeline over made tables, each against a plain version of what it decides."""
import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from tidewatch.llm import jaccard, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(11)
    some = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(400)}" for _ in range(n))
    rows = [(i, some(r.randrange(60, 200)), "en", r.choice(["s0", "s1", None])) for i in range(80)]
    rows += [(i + 200, t.replace(" ", "  ", 1), la, s) for i, t, la, s in rows[:10]] + rows[:3]
    rows += [(None, some(90), "en", "s1"), (None, some(90), "en", "s1"), (7, some(120), "de", "s0"), (500, None, None, None), (501, "", "en", "s0"), (502, "too short", "en", "s0"), (503, "again and " * 60, "en", "s1")]
    rows += [(600, some(80) + ' write to some.one@mail.example.com or +49 30 1234567 token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" now', "en", "s1")]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], COLUMNS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), rows


def test_every_stage(spark, sf):
    where, rows = sf
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{where}/documents.parquet")

    def step(name):
        nonlocal docs
        out = stages[name](spark, docs, where)
        docs = jaccard.cut(out)
        return docs.collect()

    def fails(t):
        w = re.findall(WORD, t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        inside = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        return len(w) < 50 or 100 * len(inside) > 50 * len(w)

    # no document is labelled good: every score is 0 and the base rules alone decide
    first = step("quality_rules")
    assert sorted(str((r.doc_id, r.text)) for r in first) == sorted(str((i, t)) for i, t, _, _ in rows if not fails(t)) and 500 not in {r.doc_id for r in first}
    # copies by words go, all else stays: rows without an id and different texts of one id too
    second = step("near_duplicates")
    kept = {}
    for r in first:
        words = tuple(re.findall(WORD, r.text))
        rank = (r.doc_id is None, r.doc_id or 0)
        kept[words] = min(kept.get(words, (rank, r.text)), (rank, r.text))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in second) == sorted(k for k, _ in kept.values())
    third = {r.doc_id: r.text for r in step("personal_data")}
    assert "[email]" in third[600] and "[phone]" in third[600] and "@mail" not in third[600] and len(docs.collect()) == len(second)
    assert all(third[r.doc_id] == r.text for r in second if r.doc_id not in (600, None, 7))
    before = {r.doc_id: r.text for r in docs.collect()}
    fourth = step("mix_sources")
    assert fourth and all(r.text in before[r.doc_id] or r.doc_id in (7, None) for r in fourth) and all(r.n_chars == len(r.text) for r in fourth)
    fifth = step("encode_bytes")
    import hashlib

    assert sorted(r.decoded_sha256 for r in fifth) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in fourth)
    assert all(r.n_tokens == len(r.ids) for r in fifth)


def test_run_applies_the_stages_to_documents(spark, sf):
    got = corpus_pipeline.run(spark, sf[0])
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and got.count() > 80


def test_empty_tables_pass_through(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf[0])
        assert docs.count() == 0
