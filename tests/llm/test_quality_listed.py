"""The driver gets one string a table, and fitting works out only what it reads."""
from tidewatch.llm import quality


def test_tables_are_one_string_each(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    tables = (*quality.ratios(docs, quality.target(labels)), *sum(map(list, quality.toxic_odds(docs, quality.labelled(labels))), []))
    assert len(tables) == 6 and all(isinstance(t, str) and t.count(",") == quality.BUCKETS - 1 for t in tables)
    assert quality.measured(docs, only=("peak",)).columns == ["doc_id", "text", "peak"]
