"""The stage emits the words of the chosen blocks, as they stand in the text."""
import corpus_pipeline
from tidewatch.llm import mixing


def test_mixed_rows_are_the_chosen_ranges(spark):
    text = lambda i, n: "  " + "".join(f"d{i}w{k}" + ("\n" if k % 7 == 0 else " \t" if k % 5 == 0 else " ") for k in range(n))
    rows = [(i, text(i, n), "en", s, 0) for i, (n, s) in enumerate([(700, "a"), (300, "a"), (500, "b"), (20, "b"), (900, "c"), (400, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    original = {r[0]: r[1] for r in rows}
    assert all(r.text in original[r.doc_id] and r.n_chars == len(r.text) for r in got)
    mixed = mixing.mix(docs).collect()
    want = []
    for r in mixed:
        assert r.taken == r.rounds * r.size + sum(p.t - p.f for p in r.parts)
        want += r.rounds * [(r.doc_id, 0, r.size)] + [(r.doc_id, p.f, p.t) for p in r.parts]
    place = lambda w: int(w.split("w")[1])
    assert sorted((r.doc_id, place(r.text.split()[0]), place(r.text.split()[-1]) + 1) for r in got) == sorted(want)
    assert any(f > 0 for _, f, _ in want)  # not only heads
