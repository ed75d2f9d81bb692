"""A few toxic words reject a text whose mean score is good; words that share a bucket with one do not."""
import math
import random

from tidewatch.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def test_toxic_words_are_learnt_from_labels(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    clean = [(i, some(120)) for i in range(300)]
    toxic = [(i, f"{some(80)} Vilefoo, {some(60)} ({rng.choice(['vilebar', 'VILEBAZ'])}). {some(60)}") for i in range(300, 380)]
    docs = spark.createDataFrame(clean + toxic + [(None, "vilefoo " + some(60)), (None, some(60)), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(i, 1, 1) for i in range(300, 380, 2)], LABELS)
    got = quality.judge(docs, labels).select("doc_id", "text", "kept", "peak").collect()
    for r in got:
        assert r.kept == (r.text is not None and "vile" not in r.text.lower()), (r.doc_id, r.peak)
    # fitted the other way round, unlabelled rows are judged as labelled ones are
    again = {r.doc_id: r.peak for r in quality.judge(docs.repartition(7), labels).collect() if r.doc_id is not None}
    assert again == {r.doc_id: r.peak for r in got if r.doc_id is not None}


def test_odds_are_those_of_the_formula(spark):
    docs = spark.createDataFrame([(1, "bad day"), (2, "bad bad night!"), (3, "good day"), (4, "good night"), (5, "Bad")], "doc_id long, text string")
    known = quality.labelled(spark.createDataFrame([(1, 1, 1), (2, 0, 1), (3, 1, 0), (4, 1, 0), (2, 1, 0), (None, 1, 1), (6, 1, None)], LABELS))
    assert sorted((r._d, r._toxic) for r in known.collect()) == [(1, True), (2, True), (3, False), (4, False)]
    odds, _ = quality.toxic_odds(docs, known)
    peaks = {r.doc_id: r.peak for r in quality.measured(docs, None, odds).collect()}
    bad = math.log((2 + quality.EVEN) / quality.EVEN)
    assert all(abs(peaks[i] - bad) < 1e-6 for i in (1, 2, 5)) and peaks[3] == peaks[4] == 0


def test_without_toxic_labels_or_held_out_ones_nothing_is_rejected_by_its_words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(60))) for i in range(4)], "doc_id long, text string")
    for rows in ([], [(0, 0, 1)], [(i, 1, 0) for i in range(4)]):
        out = quality.judge(docs, spark.createDataFrame(rows, LABELS))
        assert {r.kept for r in out.collect()} == {True}
        assert not any(word in out._jdf.queryExecution().toString() for word in ("Python", "Pandas"))
