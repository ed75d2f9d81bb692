"""The threshold is fitted on held-out good documents."""
import random

from tidewatch.llm import quality


def test_threshold_follows_the_labels(spark, monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 1 << 12)  # little smoothing on few texts
    rng = random.Random(2)
    some = lambda k, n: " ".join(f"{k}{rng.randrange(30)}" for _ in range(n))
    good, bad = [(i, some("g", 160)) for i in range(600)], [(i, some("g", 142) + " " + some("b", 18)) for i in range(600, 800)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 600, 2)] + [(i, 0, 0) for i in range(600, 800, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).select("doc_id", "score", "kept").collect()}
    # kept at the constant threshold of before
    assert sum(got[i].score >= -0.4 and not got[i].kept for i in range(600, 800)) > 50
    assert sum(got[i].kept for i in range(600, 800)) <= 10
    assert sum(got[i].kept for i in range(600)) >= 590


def test_one_rule_at_every_size(spark):
    """With few held-out documents the threshold lies lower, with none nothing is rejected by score."""
    rng = random.Random(3)
    some = lambda k, n: " ".join(f"{k}{rng.randrange(300)}" for _ in range(n))
    rows = [(i, some("g", 90)) for i in range(40)] + [(100, some("odd", 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {}
    for n in (0, 2, 40):
        labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
        kept[n] = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept[0] == {r[0] for r in rows} and kept[40] >= set(range(40))
