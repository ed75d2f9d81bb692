"""Windows that are not decoded have no say: the same spans as when every window is."""
import random

import numpy as np
import pytest

from tidewatch.llm import pii


@pytest.fixture(scope="module")
def net():
    r = random.Random(1)
    carriers = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(30))[:128] for _ in range(400)]
    return pii.train(*pii.made(carriers), steps=150)


def decoded_whole(text, net, base):
    half, quarter = pii.WINDOW // 2, pii.WINDOW // 4
    codes = pii._codes(text)
    n = -(-max(len(codes), 1) // half)
    padded = np.full((n + 1) * half, pii._N_IN - 1)
    padded[: len(codes)] = codes
    got, tags = pii.decode(np.stack([padded[w * half : w * half + pii.WINDOW] for w in range(n)]), net), np.zeros(len(padded), np.int8)
    for w, g in enumerate(got):
        f, t = 0 if w == 0 else quarter, pii.WINDOW if w == n - 1 else pii.WINDOW - quarter
        tags[w * half + f : w * half + t] = g[f:t]
    out = []
    for k, a, b in sorted(pii.candidates(text), key=lambda c: (c[1], pii.KINDS.index(c[0]))):
        if (tags[a:b] == pii.KINDS.index(k) + 1).any() and all(b <= x or a >= y for _, x, y in [*base, *out]):
            out.append((k, a, b))
    return out


def test_skipped_windows_change_nothing(net):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    values = ["555-123-4567", "0044 20 7946 0958", "jane[at]site.org", "abcd:dead:beef:cafe:abcd:dead:beef:cafe", "4111/1111/1111/1111", "sk9" + word(300) + "A7b8", "9" * 5000, "a" * 5000, "@" * 3000,
              "10-20-30-40", "me@x.org", "q1w2e3r4t5y6u7i8o9p0", "12.12.2024 10:30", ""]
    texts = ["", "x"] + [" ".join(r.choice([word(r.randrange(1, 12)), word(4), r.choice(values)]) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    base, every = pii.spans_of(texts, net)
    want = [decoded_whole(t, net, b) for t, b in zip(texts, base)]
    assert [[s for s in e if s not in b] for b, e in zip(base, every)] == [sorted(w, key=lambda s: (pii.KINDS.index(s[0]), s[1])) for w in want]
    assert sum(map(len, want)) > 20
