"""Brute-force versions of the operators over tables of nulls, empty and long texts, ties, repeated rows and clashing names."""
import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import bpe, chat, jaccard, licenses, lm, mixing, pii, quality

WORD = r"[^\x20\x09-\x0D]+"
DOC = "doc_id long, text string, source string"


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    some = lambda n, k=40: " ".join(r.choice(["w", "É", "x-", "#"]) + str(r.randrange(k)) for _ in range(n))
    near = [f"v{i}" for i in range(120)]
    out = [(None, None, None), (None, "Null id  text\n\nñ", "a"), (1, "", "a"), (2, " \t\n", "b"), (3, "One", "b"), (2**60 + 1, some(60), "a"),
           (4, "same row " * 30, "a"), (4, "same row " * 30, "a"), (4, "another text of id four", "c"), (5, "\x00nul\x00 Ünïcode \U0001f600 𝔘", "c"),
           (6, "line one\nline one\n \nLine one\n" * 9 + some(40), "c"), (7, "q" * 20_000, "c"), (8, "A b C d\n" * 4000, None), (9, " ".join(near), "a"),
           (10, " ".join(near[:-1] + ["z"]), "b"), (11, " ".join(["y"] + near[1:]), "b"), (12, "MIT\tLicense, mit license; GNU General PUBLIC License. cc by-sa", "b"),
           (13, "mail A.b@c.de and 10.0.0.1 or 300.1.1.1, 4111 1111 1111 1111, +1 (202) 555-0143; 1.2.3.4.5 a@b@c.org 4111111111111112", "a")]
    return out + [(100 + i, some(r.randrange(1, 90)), r.choice(["a", "b", "c", None])) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def key(x):
    return tuple(str(v) for v in x)


def test_lm_equals_the_model_with_exact_counts(docs, rows):
    said = [(i, re.findall(WORD, ascii_lower(t)) + ["\n"]) for i, t, _ in rows]
    c, p = Counter(), Counter()
    for i, w in said:
        if not lm.held_out(i):
            c.update(w)
            p.update(zip(["\n"] + w, w))
    n, v = sum(c.values()), len(c)
    floor = lambda x: 2 ** (x.bit_length() - 1) if x else 0
    prob = lambda a, b: (floor(p[a, b]) + lm.MU * (c[b] + 1) / (n + v + 1)) / (c[a] + lm.MU)
    want = sorted(((i, lm.held_out(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6),
                    round(sum(math.log10(prob(a, b)) for a, b in zip(["\n"] + w, w)), 6)) for i, w in said), key=key)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, lm.held_out).collect()), key=key)
    assert got == want
    # the words that can follow have no more than all of the probability, new words being one event
    for a in ["\n", "same", "row", "v3"]:
        assert 0.5 < sum(prob(a, b) for b in c) + prob(a, "never seen") <= 1 + 1e-9
    assert lm.score(docs.limit(0), lm.held_out).count() == 0


def test_filter_gives_the_levels_back():
    h = lm._mix(np.arange(1, 20_001, dtype=np.uint64))
    count = np.random.default_rng(1).zipf(1.6, len(h)).clip(max=10**6)
    f = lm.Filter(h, count)
    assert (f.levels(h) >= lm._levels(count)).all() and (f.levels(h) != lm._levels(count)).sum() <= 2
    assert (lm.Filter(h, count).levels(lm._mix(np.arange(1_000_000, 1_100_000, dtype=np.uint64))) > 0).sum() <= 2


def test_bpe_equals_the_library(docs, rows):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    coded = bpe.encode(docs, path, P.PATTERN, with_ids=True)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, hexed(bytes(r["decoded"]))) for r in bpe.decode(coded, path).collect()), key=key)
    want = []
    for i, t, _ in rows:
        ids, raw = enc.encode_ordinary(t or ""), hexed((t or "").encode())
        want.append((i, len(ids), hexed(np.array(ids, "<u4").tobytes()), raw, raw))
    assert got == sorted(want, key=key)


def test_quality_base_columns(spark, docs, rows):
    def base(t):
        t = t or ""
        w, c, inside = re.findall(WORD, t), None, set()
        c = Counter(zip(w, w[1:], w[2:]))
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                inside |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)

    labels = spark.createDataFrame([(9, 1, 0), (None, 1, 0), (10, 1, 1)], "doc_id long, quality int, toxic int")
    clash = docs.selectExpr("*", "1 as score", "'x' as kept", "2 as n_words")
    out = quality.judge(clash, labels)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()), key=key)
    assert got == sorted(((i, *base(t)) for i, t, _ in rows), key=key)
    assert all(not r.kept for r in out.where("base_failed").collect())
    assert "Python" not in out._jdf.queryExecution().toString() and quality.judge(docs.limit(0), labels).count() == 0


def test_quality_score_is_the_mean_ratio(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "c d e")], "doc_id long, text string")
    good = quality.cut(quality.target(spark.createDataFrame([(1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")))
    ratio, _ = quality.ratios(docs, good)
    grams = {1: ["a", "b", "a b", "b $"], 2: ["a", "a", "a a", "a $"], 3: ["c", "d", "e", "c d", "d e", "e $"]}
    raw, own = Counter(g for x in grams.values() for g in x), Counter(grams[1])
    one = lambda g: math.log((own[g] + 1) / (4 + quality.BUCKETS)) - math.log((raw[g] + 1) / (14 + quality.BUCKETS))
    for r in quality.measured(docs, ratio).collect():
        assert r.score == pytest.approx(sum(map(one, grams[r.doc_id])) / len(grams[r.doc_id]), abs=1e-5)


def test_license_base_phrases(docs, rows):
    want = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
        want += [(i, label, at, at + len(p.split())) for p, label in licenses.BASE for at in range(len(w)) if w[at : at + len(p.split())] == p.split()]
    got = [(r.doc_id, r.label, r["first"], r["last"]) for r in licenses.scan(docs).where("base").collect()]
    assert sorted(got) == sorted(want) and len(want) == 4


def test_whole_notices_are_found_with_slips_and_not_from_their_words(spark):
    text = {label: t for t, label in licenses.LONG}
    w = text["mit-full"].split()
    cut_up = w[:40] + ["inserted", "words"] + w[40:80] + w[82:]
    mixed = w[:]
    random.Random(3).shuffle(mixed)
    docs = spark.createDataFrame([(1, "intro " * 9 + " ".join(cut_up).upper() + " end"), (2, " ".join(mixed)), (3, " ".join(w[:60])), (4, text["isc"] + "\n" + text["gpl-notice"])], "doc_id long, text string")
    got = {(r.doc_id, r.label) for r in licenses.scan(docs).where("not base").collect()}
    assert {x for x in got if "full" in x[1] or x[0] in (2, 4)} == {(1, "mit-full"), (4, "isc"), (4, "gpl-notice")}


def brute_links(rows):
    def shingles(t):
        w = ascii_lower(t).encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    copies, least = Counter(t or "" for _, t, _ in rows), {}
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", math.inf), math.inf if i is None else i)
    texts = sorted(copies)
    sets, root, n = [shingles(t) for t in texts], list(range(len(texts))), Counter()
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                n[a] += copies[texts[b]]
                n[b] += copies[texts[a]]
                root = [root[b] if x == root[a] else x for x in root]
    best = {r: min(least[t] for t, x in zip(texts, root) if x == r) for r in set(root)}
    return sorted(((i, n[texts.index(t or "")], best[root[texts.index(t or "")]]) for i, t, _ in rows), key=key)


@pytest.mark.parametrize("block", [1024, 8])
def test_jaccard_equals_all_pairs(spark, rows, monkeypatch, block):
    """With small blocks, groups are dealt into several; copies of one doc_id with different texts stay apart."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r, base = random.Random(1), [f"b{i}" for i in range(150)]
    more = []
    for i in range(40):
        w = list(base)
        w[r.randrange(150)], w[r.randrange(150)] = f"u{i}", f"t{i}"
        more.append((200 + i % 30, " ".join(w), "a"))
    got = jaccard.link(spark.createDataFrame(rows + more, DOC)).collect()
    assert sorted(((x.doc_id, x.n_links, math.inf if x.component_id is None else x.component_id) for x in got), key=key) == brute_links(rows + more)


def test_jaccard_recall_at_the_threshold(spark):
    """Pairs of similarity just above 0.8: 200 words share all but 10 in a row, 186 of 206 + ... shingles."""
    docs = []
    for k in range(150):
        w = [f"k{k}w{i}" for i in range(200)]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:90] + [f"o{k}x{i}" for i in range(17)] + w[107:]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert 1 - (1 - 0.8**jaccard.ROWS) ** jaccard.BANDS >= 0.999
    assert jaccard.link(d).where("n_links = 1").count() >= 0.99 * len(docs)


def test_one_of_each_group_stays_and_keeps_its_columns(docs, rows):
    got = sorted(((r.doc_id, r.text, r.source) for r in jaccard.one_of_each(docs).collect()), key=key)
    want = {key(r): r for r in rows}.values()
    drop = {(1, ""), (10, rows[14][1]), (11, rows[15][1])}
    # "", null and the repeated row are copies; of texts without words only equal ones are
    want = [r for r in want if (r[0], r[1]) not in drop and r[:2] != (None, None)] + [(1, "", "a")]
    assert got == sorted(want, key=key)


def test_mix_meets_its_targets_and_reruns_agree(spark, docs, rows):
    more = [(1000 + i, f"doc {i} " + "word " * (i % 170), "abc"[i % 3] if i % 4 else None) for i in range(300)] + [(5000, "copied text of six words here " * 20, "b")] * 60
    d = spark.createDataFrame(rows + more, DOC).selectExpr("*", "'clash' as size", "1 as taken")
    out = mixing.mix(d).collect()
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in out:
        assert r.size == len(re.findall(WORD, r.text or "")) and 0 <= r.taken <= 3 * r.size
        assert r.taken == r.rounds * r.size + sum(p.t - p.f for p in r.parts) and all(0 <= p.f < p.t <= r.size for p in r.parts)
        assert all(a.t < b.f or a.t == b.f for a, b in zip(r.parts, r.parts[1:]))
        by[r.source] = [by[r.source][0] + r.taken, r.target, r.source_size]
    sizes = {s: sum(len(re.findall(WORD, t or "")) for _, t, x in rows + more if x == s) for s in by}
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = mixing.targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])
    for s, t in zip(order, want):
        assert by[s][2] == sizes[s] and by[s][1] == pytest.approx(t) and abs(by[s][0] - t) <= max(64, 0.02 * t)
    again = mixing.mix(spark.createDataFrame((rows + more)[::-1], DOC).repartition(7)).collect()
    assert sorted((str(r.doc_id), str(r.text), r.taken) for r in again) == sorted((str(r.doc_id), str(r.text), r.taken) for r in out)


def test_targets_by_filling_up():
    rng = np.random.default_rng(4)
    for _ in range(50):
        size, weight = rng.integers(0, 50, 6).astype(float), rng.integers(1, 4, 6).astype(float)
        got = mixing.targets(size, weight)
        # the level at which capped sources are full and the others have weight * level
        lo, hi = 0.0, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.minimum(weight * mid, 3 * size).sum() < size.sum() else (lo, mid)
        assert got == pytest.approx(np.minimum(weight * lo, 3 * size).tolist(), abs=1e-6)


def test_pii_base_spans(docs, rows):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0

    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s)),
          "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15}
    got = sorted(((r.doc_id, [tuple(s) for s in r.base]) for r in pii.find(docs.selectExpr("*", "1 as base"), None).collect()), key=key)
    want = sorted(((i, [(k, m.start(), m.end()) for k in rx for m in re.finditer(rx[k], t or "") if ok[k](m.group())]) for i, t, _ in rows), key=key)
    assert got == want and sum(len(s) for _, s in want) >= 6


@pytest.fixture(scope="module")
def net():
    r = random.Random(5)
    carriers = [" ".join("".join(r.choice("abcdefghij klmnop") for _ in range(r.randint(2, 9))) for _ in range(30))[:128] for _ in range(1500)]
    return pii.train(*pii.made(carriers[:1200])), carriers[1200:]


def test_network_finds_held_out_spans(net):
    model, carriers = net
    x, y = pii.made(carriers, seed=42, copies=2)
    z = pii.decode(x, model)
    assert (z[y > 0] == y[y > 0]).mean() >= 0.8 and (z[z > 0] == y[z > 0]).mean() >= 0.85


def test_network_adds_what_the_patterns_miss_and_redaction_removes_it(net):
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    lead = "some plain words before it and " * 4
    texts = [lead + f'token = "{secret}" and more words after', lead + "call (202) 555-0143 today please", lead + "nothing of that kind in here, 12 or 2024-05-06", ""]
    base, every = pii.spans_of(texts, net[0])
    assert [len(b) for b in base] == [0, 0, 0, 0]
    assert [(k, texts[0][a:b]) for k, a, b in every[0]] == [("secret", secret)] and every[2:] == [[], []]
    # windows are reconciled to one result wherever a value lies
    for shift in range(0, 64, 5):
        t = "x " * shift + texts[0]
        assert [(k, t[a:b]) for k, a, b in pii.spans_of([t], net[0])[1][0]] == [("secret", secret)]


def test_chat_chains_cycles_and_empty_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    long = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(70)] + [(None, 0, "user", None), (None, 0, "user", None), (2, 5, None, "<|im_start|>")]
    got = {r.conv_id: r for r in chat.format_chats(chat.from_turns(spark.createDataFrame(long, kind))).withColumn("t", chat.read_back(chat.F.col("formatted"))).collect()}
    assert [x.text for x in got[1].t] == [f"t{i}" for i in range(70)] and len(got[None].t) == 2 and got[2].t[0].text == "<|im_start|>"
    assert chat.format_chats(chat.from_turns(spark.createDataFrame([], kind))).count() == 0
    with pytest.raises(ValueError):
        chat.format_chats(spark.createDataFrame([(1, 1, 2, "a", "x", 0.0), (1, 2, 1, "a", "y", 0.0)], "conv_id long, node long, parent long, role string, text string, score double")).count()
