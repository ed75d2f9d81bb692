"""Every label counts, however many there are."""
import random

from tidewatch.llm import quality


def test_all_labels_are_used(spark):
    n = 21_000
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic").unionByName(spark.range(n, 2 * n).selectExpr("id as doc_id", "0 as quality", "1 as toxic"))
    assert quality.target(labels).count() == n
    assert {r[0]: r[1] for r in quality.labelled(labels).groupBy("_toxic").count().collect()} == {False: n, True: n}


def test_counts_are_those_of_a_shuffled_join(spark):
    """The same model whether the labelled ids are broadcast or not."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(50)}" for _ in range(60))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    both = []
    for most in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        both.append((quality.ratios(docs, quality.target(labels)), quality.toxic_odds(docs, quality.labelled(labels))))
    assert both[0] == both[1]
