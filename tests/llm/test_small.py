"""Small tables with nulls, empty texts and repeated rows, and brute-force comparisons."""
import numpy as np
import pytest

from tidewatch.llm import bpe, chat, jaccard, licenses, mixing, pii, quality

DOC = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    w = [f"w{i}" for i in range(60)]
    near = w[:59] + ["other"]
    rows = [(0, None, None), (1, "", "a"), (2, " ".join(w), "a"), (3, " ".join(near), "b"), (4, " ".join(w), "b"), (4, " ".join(w), "b"), (5, "mail me@x.org or +1 (202) 555-0100\nMIT  License", "b")]
    return spark.createDataFrame(rows, DOC)


def test_bpe_matches_the_library(docs):
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, path, P.PATTERN).collect())
    want = []
    for r in docs.collect():
        t = r.text or ""
        want.append((r.doc_id, hashlib.sha256(np.array(enc.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode(docs.limit(0), path, P.PATTERN).count() == 0


def test_near_copies_and_exact_copies(docs):
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in jaccard.link(docs).collect())
    # 56 shingles each, 55 shared: 55 / 57; three copies of one text
    assert got == [(0, 0, 0), (1, 0, 0), (2, 2, 1), (3, 2, 3), (4, 2, 1), (4, 2, 1), (5, 5, 0)]


def test_quality_rules(spark, docs):
    labels = spark.createDataFrame([(2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.n_words, r.base_failed) for r in quality.judge(docs, labels).collect()}
    assert got == {(0, 0, True), (1, 0, True), (2, 60, False), (3, 60, False), (4, 60, False), (5, 8, True)}


def test_mix_stays_within_the_cap(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 7 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sainte_lague_matches_one_seat_at_a_time():
    votes, most = [5, 3, 3, 1], [4, 9, 9, 1]
    for seats in range(25):
        want = [0] * 4
        for _ in range(seats):
            open_ = [(-votes[i] / (2 * want[i] + 1), i) for i in range(4) if want[i] < most[i]]
            if open_:
                want[min(open_)[1]] += 1
        assert mixing.sainte_lague(votes, seats, most).tolist() == want


def test_chat_tree_picks_the_best_branch_and_reads_back(spark):
    rows = [(1, 1, None, "user", "a<\\|b", 0.0), (1, 2, 1, "assistant", "low", 0.1), (1, 3, 1, "assistant", "<|im_end|>", 0.9)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double"))
    turns = out.select(chat.read_back(out["formatted"]).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [("user", "a<\\|b"), ("assistant", "<|im_end|>")]


def test_pattern_spans():
    text = "me@x.org 999.1.1.1 10.0.0.1, 4111 1111 1111 1111"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "me@x.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111")]


def test_license_phrase(docs):
    assert [(r.doc_id, r.label) for r in licenses.scan(docs).collect()] == [(5, "mit")]


def test_near_vectors_match_brute_force(spark):
    from tidewatch.llm import neardup

    rng = np.random.default_rng(3)
    base = rng.standard_normal((700, 16))
    x = np.concatenate([base, base[:40] + rng.standard_normal((40, 16)) * 0.1, base[:1] + rng.standard_normal((60, 16)) * 0.05, base[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (None, [1.0] * 16), (9004, [])]
    got = {r.vec_id: r for r in neardup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    want = hit.sum(1)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= want).all() and links.sum() >= 0.98 * want.sum()
    assert all(got[i].component_id == 0 for i in range(740, 800)) and got[800].component_id == 0
    for i in (9001, 9002, 9003, 9004):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert neardup.link(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
