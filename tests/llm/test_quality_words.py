"""Words are split once a table, and windows that agree only in lower case or by half a hash are not found again."""
from tidewatch.llm import quality


def test_keys_are_worked_out_once(spark, monkeypatch):
    plans, cut = [], quality.cut
    monkeypatch.setattr(quality, "cut", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or cut(d))
    docs = spark.createDataFrame([(1, "a b"), (2, "a a")], "doc_id long, text string")
    known = cut(quality.labelled(spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")))
    quality.toxic_odds(docs, known)
    assert len(plans) == 1 and plans[0].count("split(") == 1  # twice before


def test_windows_in_other_case_are_others(spark):
    rows = [(1, "a b c x a b c", 6), (2, "a b c x A b c", 0), (3, "A b c a b c A b c", 6), (4, "a a a a", 4), (5, "a b a b", 0), (6, "a b", 0), (7, "", 0), (8, None, 0), (9, "x y z y z x y z", 6)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.measured(docs).collect()}
    assert got == {i: n for i, _, n in rows}
