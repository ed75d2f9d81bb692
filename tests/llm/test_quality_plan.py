"""Plans do not spell out the tables of ratios, which the driver would copy for every description of them."""
from tidewatch.llm import quality


def test_plan_text_is_small(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a a")], "doc_id long, text string")
    numbers = lambda k: ",".join(str(1_000_003 * (x % 5 + k)) for x in range(quality.BUCKETS))
    out = quality.measured(docs, numbers(0), [numbers(1), numbers(2)])
    assert len(out._jdf.queryExecution().toString()) < 100_000
    # any lookup is a multiple of 1,000,003 parts of a million, whichever bucket it hits
    for r in out.collect():
        assert abs(r.score * 1e6 / 1_000_003 * 2 * r.n_words - round(r.score * 1e6 / 1_000_003 * 2 * r.n_words)) < 1e-6 and r.peak >= 1.000003
