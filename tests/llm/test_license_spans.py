"""Repeated pairs are no license; real passages are, with small slips."""
from tidewatch.llm import licenses


def test_spans_are_verified_in_order(spark):
    mit = licenses.LONG[0][0]
    w = mit.split()
    texts = ["2.0 " * 6, "of this " * 5, mit, " ".join(w[:6] + ["now"] + w[6:]), "of this " * 40 + licenses.LONG[3][0], " ".join(reversed(w)), mit + " x " * 9 + mit]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.label, round(r.share, 2)) for r in licenses.scan(docs).where("not base").collect())
    assert got == [(2, "mit-text", 1.0), (3, "mit-text", 0.93), (4, "all-rights-reserved", 1.0), (6, "mit-text", 1.0), (6, "mit-text", 1.0)]
