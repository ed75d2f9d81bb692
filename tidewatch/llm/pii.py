"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The network finds forms that they miss: phone numbers without a
plus, cards and addresses with other separators, masked `@` signs, and secrets (keys and tokens). It
reads one-hot character kinds and is trained in numpy on labelled spans: made() puts generated values
of all kinds, and numbers that are none, into windows of text of about TRAIN_DOCS documents (lowest
hash of doc_id), CARRIERS windows each. It reads every whole text: windows of WINDOW characters, every
WINDOW / 2, are all decoded, and each character takes its tag from the window it lies deepest in. An exact
check follows: a stretch of the characters a kind can have, of any length, is a span where the network
marks a character of it as that kind, where it is plausible for it and where it touches no base span.

Null text counts as empty; a null doc_id stays null; equal rows give equal results; an empty table
gives an empty one; an empty sample trains nothing and only the patterns speak. Columns of docs named
base or spans are replaced.
"""
from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("secret",)
TRAIN_DOCS, CARRIERS, WINDOW, HIDDEN, STEPS, BATCH = 2000, 4, 64, 16, 300, 96
#: Windows decoded at once, and those of them that go through one product; lengths up to which equal beginnings are shared.
GROUP, BLOCK, SHARED = 32768, 992, (4, 8, 12, 16, 20)
_RX = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_MARKS = "@.-+%_()[]:=\"/ \n"
_N_IN = len(_MARKS) + 5


def _luhn(d: str) -> bool:
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plausible(kind: str, s: str) -> bool:
    d = re.sub("[^0-9]", "", s)
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    return 13 <= len(d) <= 19 and _luhn(d) if kind == "card" else 9 <= len(d) <= 15


def _emails(text: str):
    """Leftmost matches of the email pattern; only runs that reach an `@` are tried, so long words stay linear."""
    end = 0
    for m in re.finditer(r"[A-Za-z0-9._%+-]+(?![A-Za-z0-9._%+-])@?", text):
        if m.group().endswith("@") and (x := _RX["email"].match(text, max(m.start(), end))):
            yield x
            end = x.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    # every match holds a sign or a digit that most texts lack
    digits = re.search("[0-9]", text) is not None
    for k in BASE_KINDS:
        if not ("@" in text if k == "email" else digits):
            continue
        found = _emails(text) if k == "email" else _RX[k].finditer(text)
        out += [(k, m.start(), m.end()) for m in found if plausible(k, m.group())]
    return out


def _points(text: str) -> np.ndarray:
    """Code points of a text; those above ASCII are 128."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), 128).astype(np.uint8)


def _code_of(c: str) -> int:
    """The network's input for a character; "" is any other."""
    if c and c in _MARKS:
        return _MARKS.index(c)
    for k, rx in enumerate(("[a-f]", "[0-9]", "[A-Z]", "[g-z]")):
        if re.match(rx, c):
            return _N_IN - 5 + k
    return _N_IN - 1


_CODE = np.array([_code_of(chr(c)) for c in range(128)] + [_code_of("")], np.uint8)


def _codes(text: str) -> np.ndarray:
    return _CODE[_points(text)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x, p):
    """Hidden states of x (T, B) of codes, and what the backward pass needs."""
    h = c = np.zeros((x.shape[1], HIDDEN))
    hs, keep = [], []
    for t in range(len(x)):
        z = p["W"][x[t]] + h @ p["U"] + p["b"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        keep.append((*before, i, f, o, g, tc))
        hs.append(h)
    return np.array(hs), keep


def _lstm_back(x, dh, keep, p):
    d = {k: np.zeros_like(v) for k, v in p.items()}
    nh = nc = np.zeros_like(dh[0])
    for t in reversed(range(len(x))):
        h, c, i, f, o, g, tc = keep[t]
        a = dh[t] + nh
        dc = nc + a * o * (1 - tc * tc)
        z = np.hstack([dc * g * i * (1 - i), dc * c * f * (1 - f), a * tc * o * (1 - o), dc * i * (1 - g * g)])
        np.add.at(d["W"], x[t], z)
        d["U"] += h.T @ z
        d["b"] += z.sum(0)
        nh, nc = z @ p["U"].T, dc * f
    return d


def _lse(a, axis):
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _emit(x, net):
    hf, kf = _lstm(x, net["f"])
    hb, kb = _lstm(x[::-1], net["r"])
    h = np.concatenate([hf, hb[::-1]], 2)
    return h @ net["o"]["V"] + net["o"]["c"], h, kf, kb


def train(x: np.ndarray, y: np.ndarray, seed: int = 0, steps: int = STEPS) -> dict:
    """Net fitted to windows x (n, WINDOW) of codes and tags y by Adam on the CRF likelihood."""
    rng, k = np.random.default_rng(seed), len(KINDS) + 1
    one = lambda: {"W": rng.normal(0, 0.3, (_N_IN, 4 * HIDDEN)), "U": rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN)), "b": np.zeros(4 * HIDDEN)}
    net = {"f": one(), "r": one(), "o": {"V": rng.normal(0, 0.3, (2 * HIDDEN, k)), "c": np.zeros(k), "T": np.zeros((k, k))}}
    m = {(a, b): [np.zeros_like(v), np.zeros_like(v)] for a in net for b, v in net[a].items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), BATCH)
        xs, ys = x[pick].T, y[pick].T
        e, h, kf, kb = _emit(xs, net)
        tr, n = net["o"]["T"], len(e)
        al, be = np.zeros_like(e), np.zeros_like(e)
        al[0] = e[0]
        for t in range(1, n):
            al[t] = e[t] + _lse(al[t - 1][:, :, None] + tr, 1)
        for t in range(n - 2, -1, -1):
            be[t] = _lse(tr + (e[t + 1] + be[t + 1])[:, None, :], 2)
        z = _lse(al[-1], 1)
        de = np.exp(al + be - z[None, :, None]) - np.eye(k)[ys]
        dt = np.zeros_like(tr)
        for t in range(1, n):
            dt += np.exp(al[t - 1][:, :, None] + tr + (e[t] + be[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(dt, (ys[t - 1], ys[t]), -1)
        dh = de @ net["o"]["V"].T
        grads = {"f": _lstm_back(xs, dh[:, :, :HIDDEN], kf, net["f"]), "r": _lstm_back(xs[::-1], dh[::-1, :, HIDDEN:], kb, net["r"]),
                 "o": {"V": np.einsum("tbh,tbk->hk", h, de), "c": de.sum((0, 1)), "T": dt}}
        for (a, b), (u, v) in m.items():
            g = np.clip(grads[a][b] / BATCH, -5, 5)
            u[:] = 0.9 * u + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            net[a][b] -= 0.03 * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _sorted(x: np.ndarray) -> np.ndarray:
    """Order of the rows of x (n, WINDOW) by their codes."""
    return np.lexsort(np.ascontiguousarray(x, np.uint8).view(">u8").astype(np.uint64).T[::-1])


def _scores(x: np.ndarray, p: dict, v: np.ndarray):
    """(place, scores) of blocks of distinct sorted windows x (n, WINDOW): what the states of one direction add to tags, (WINDOW, tags, BLOCK).

    States of windows that begin alike are worked out once: steps up to each of SHARED are made for the
    distinct beginnings of that length. Widths are multiples of 32, so that a window's scores do not hang
    on its neighbours. By s(x) = 1 / (1 + exp(-x)) and tanh(x) = 2 s(2x) - 1; cells and states are held halved.
    """
    k, gates, used = v.shape[1], 4 * HIDDEN, np.flatnonzero(np.bincount(x.ravel(), minlength=_N_IN)).astype(np.uint8)
    a = np.zeros((gates + k, HIDDEN + len(used)), np.float32)
    a[:gates, :HIDDEN], a[:gates, HIDDEN:] = -2 * p["U"].T, -(p["W"][used] + p["b"]).T
    a[3 * HIDDEN : gates] *= 2
    a[gates:, :HIDDEN] = 2 * v.T
    for at in range(0, len(x), BLOCK):
        w = np.ascontiguousarray(x[at : at + BLOCK].T)
        n, first, heads = w.shape[1], np.argmax(w[:, 1:] != w[:, :-1], 0), np.zeros(1, np.int64)
        out = np.empty((WINDOW, k, n), np.float32)
        s, c = np.zeros((HIDDEN, 1), np.float32), np.zeros((HIDDEN, 1), np.float32)
        for lo, hi in zip((0, *SHARED), (*SHARED, WINDOW)):
            before, heads = heads, np.flatnonzero(np.concatenate([[True], first < hi]))
            m, came = len(heads), np.zeros(-(-len(heads) // 32) * 32, np.int64)
            came[:m] = np.searchsorted(before, heads, "right") - 1
            s, c = np.concatenate([np.take(s[:HIDDEN], came, 1), np.zeros((len(used), len(came)), np.float32)]), np.take(c, came, 1)
            z, tc = np.empty((gates + k, len(came)), np.float32), np.empty_like(c)
            e, i, f, o, g = z[:gates], *(z[q * HIDDEN : (q + 1) * HIDDEN] for q in range(4))
            hot = np.take(w[lo:hi], heads, 1)[:, None, :] == used[:, None]
            spread = np.repeat(np.arange(m), np.diff(np.append(heads, n))) if m < n else slice(0, m)
            for t in range(lo, hi):
                s[HIDDEN:, :m] = hot[t - lo]
                # a state's scores come with the next step's product
                np.matmul(a, s, out=z)
                if t:
                    out[t - 1] = z[gates:, spread]
                np.exp(e, out=e)
                e += 1
                np.reciprocal(e, out=e)
                c *= f
                g -= 0.5
                g *= i
                c += g
                np.multiply(c, -4, out=tc)
                np.exp(tc, out=tc)
                tc += 1
                np.reciprocal(tc, out=tc)
                tc -= 0.5
                np.multiply(o, tc, out=s[:HIDDEN])
        out[-1] = np.matmul(a, s)[gates:, spread]
        yield slice(at, at + n), out


def _viterbi(e: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Best tags (T, n) by scores e (T, tags, n), which are overwritten, and transitions tr."""
    for t in range(1, len(e)):
        e[t] += (e[t - 1][:, None] + tr[:, :, None]).max(0)
    out = np.empty((len(e), e.shape[2]), np.int8)
    out[-1] = e[-1].argmax(0)
    for t in range(len(e) - 2, -1, -1):
        out[t] = (e[t] + tr[:, out[t + 1]]).argmax(0)
    return out


def decode(x: np.ndarray, net: dict) -> np.ndarray:
    """Viterbi tags of windows x (n, WINDOW)."""
    x, out, tr = np.ascontiguousarray(x, np.uint8), np.zeros(x.shape, np.int8), net["o"]["T"].astype(np.float32)
    # scores are those above no tag's; where none makes up for the best ways in and out of its tag, the best path has no tags
    v, bias = net["o"]["V"][:, 1:] - net["o"]["V"][:, :1], (net["o"]["c"][1:] - net["o"]["c"][0]).astype(np.float32)[:, None]
    ways = (np.maximum(tr.max(0) - tr[0, 0], 0) + np.maximum(tr[:, 0] - tr[0, 0], 0) + np.float32(0.01))[1:, None]
    # windows of few different characters make narrower products
    often = np.zeros(_N_IN, bool)
    often[np.argsort(np.bincount(x.ravel(), minlength=_N_IN))[-10:]] = True
    few = often[x].all(1)
    for rows in (np.flatnonzero(few), np.flatnonzero(~few)):
        for at in range(0, len(rows), GROUP):
            here = rows[at : at + GROUP]
            here = here[_sorted(x[here])]
            part = x[here]
            new = np.concatenate([[True], (part[1:] != part[:-1]).any(1)])
            part = part[new]
            tags, r = np.zeros(part.shape, np.int8), np.empty((WINDOW, len(bias), len(part)), np.float32)
            order = _sorted(part[:, ::-1])
            with np.errstate(over="ignore"):
                for place, s in _scores(part[order][:, ::-1], net["r"], v[HIDDEN:]):
                    r[:, :, order[place]] = s[::-1]
                for place, s in _scores(part, net["f"], v[:HIDDEN]):
                    s += r[:, :, place]
                    s += bias
                    doubt = np.flatnonzero((s + ways).max((0, 1)) >= 0)
                    e = np.zeros((WINDOW, len(tr), len(doubt)), np.float32)
                    e[:, 1:] = s[:, :, doubt]
                    tags[place.start + doubt] = _viterbi(e, tr).T
            out[here] = tags[np.cumsum(new) - 1]
    return out


#: The characters a value of a kind can have.
_OF = {"email": r"[A-Za-z0-9._%+@()\[\]-]", "ip": r"[0-9A-Fa-f.:-]", "card": r"[0-9 ./-]", "phone": r"[0-9()+ ./-]", "secret": r"[A-Za-z0-9_+/=-]"}
#: Whole stretches of them that are long enough for one; an email address is looked for from its `@` instead.
_LONG = {"ip": 4, "card": 13, "phone": 9, "secret": 20}
_MAIL, _AT = re.compile(_OF["email"]), re.compile(r"@|\(at\)|\[at\]")
#: A bit for each of these kinds that a code point is of.
_KIND = np.array([sum(1 << i for i, k in enumerate(_LONG) if re.match(_OF[k], chr(c))) for c in range(128)] + [0], np.uint8)
#: Names and numbers joined by signs.
_PLAIN = re.compile(r"(?:(?:[A-Z]?[a-z]++)*+[0-9]*+(?:[-_=/+]++|$))*+")


def likely(kind: str, s: str) -> bool:
    """Whether the network's span can be a value of its kind."""
    if kind == "email":
        return re.fullmatch(r"[A-Za-z0-9._%+-]+(@|\(at\)|\[at\])[A-Za-z0-9-]+((\.|\(dot\)|\[dot\])[A-Za-z0-9-]+)*", s) is not None
    if kind == "ip":
        if s.count(".") + s.count("-") != 3 and s.count(":") < 3:
            return False
        part = re.split("[.-]", s)
        four = len(part) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in part)
        return four or re.fullmatch(r"([0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}", s) is not None
    d = re.sub("[^0-9]", "", s)
    if kind == "card":
        return 13 <= len(d) <= 19 and _luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9()+ ./-]*[0-9]", s) is not None and len(set(d)) > 2
    if len(s) < 20 or len(re.sub("[^A-Za-z]", "", s)) < 3:
        return False
    # keys may hold few digits or none
    return not re.fullmatch("[A-Za-z]+[-_=/+][0-9]+", s) if len(d) >= 3 else not _PLAIN.fullmatch(s)


def _stretches(points: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the long stretches of each kind's characters; points are those of _points()."""
    of, out = np.concatenate([[0], _KIND[points], [0]]).astype(np.uint8), []
    for i, (k, n) in enumerate(_LONG.items()):
        edge = np.flatnonzero(np.diff((of & (1 << i)).view(np.int8)))
        a, b = edge[::2], edge[1::2]
        out += [(k, int(x), int(y)) for x, y in zip(a[b - a >= n], b[b - a >= n])]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every stretch of a text that can be a value, trimmed of signs at its ends."""
    return _candidates(text, _stretches(_points(text)))


def _candidates(text: str, stretches: list) -> list[tuple[str, int, int]]:
    found, end = list(stretches), 0
    for m in _AT.finditer(text):
        if m.start() >= end:
            a, end = m.start(), m.end()
            while a > 0 and _MAIL.match(text, a - 1):
                a -= 1
            while end < len(text) and _MAIL.match(text, end):
                end += 1
            found.append(("email", a, end))
    out = []
    for k, a, b in found:
        s = text[a:b].lstrip(" .,:/-=")
        a, s = b - len(s), s.rstrip(" .,:/-(")
        if s and likely(k, s):
            out.append((k, a, a + len(s)))
    return out


def model_spans(texts: list[str], net: dict, base: list | None = None) -> list[list[tuple[str, int, int]]]:
    """Candidates of each text that touch no base span and hold a character which the network gives their kind; of those that overlap the first stays.

    The network reads every window of every text.
    """
    out, at = [], 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size < GROUP * WINDOW // 2:
            to, size = to + 1, size + len(texts[to])
        out += _group_spans(texts[at:to], net, base[at:to] if base else [()] * (to - at))
        at = to
    return out


def _group_spans(texts: list[str], net: dict, base: list) -> list[list[tuple[str, int, int]]]:
    """model_spans() of texts that are laid beside each other, in rows of half a window, each with a row left free behind it."""
    half, quarter, out = WINDOW // 2, WINDOW // 4, []
    end = np.cumsum([-(-len(t) // half) + 1 for t in texts])
    begin, last = np.concatenate([[0], end[:-1]]), end - 1
    points = np.full(end[-1] * half, 128, np.uint8)
    for t, a in zip(texts, begin * half):
        points[a : a + len(t)] = _points(t)
    # a window starts at every row but a free one
    windows, tags = np.setdiff1d(np.arange(end[-1]), last), np.zeros((end[-1], half), np.int8)
    if len(windows):
        got = decode(np.lib.stride_tricks.sliding_window_view(_CODE[points], WINDOW)[::half][windows], net)
        # a character takes its tag from the window it lies deepest in; the ends of a text from its first and its last window
        first, final = (np.searchsorted(windows, w[begin < last]) for w in (begin, last - 1))
        tags[windows, quarter:], tags[windows + 1, :quarter] = got[:, quarter:half], got[:, half:-quarter]
        tags[windows[first], :quarter], tags[windows[final] + 1, quarter:] = got[first, :quarter], got[final, -quarter:]
    tags, stretches = tags.ravel(), [[] for _ in texts]
    for k, a, b in _stretches(points):
        n = int(np.searchsorted(end, a // half, "right"))
        stretches[n].append((k, a - int(begin[n]) * half, b - int(begin[n]) * half))
    for n, text in enumerate(texts):
        spans, own = [], tags[begin[n] * half :]
        free = [c for c in _candidates(text, stretches[n]) if all(c[2] <= x or c[1] >= y for _, x, y in base[n])]
        for k, a, b in sorted(free, key=lambda c: (c[1], KINDS.index(c[0]))):
            if (own[a:b] == KINDS.index(k) + 1).any() and all(b <= x or a >= y for _, x, y in spans):
                spans.append((k, a, b))
        out.append(spans)
    return out


def _value(r: random.Random) -> tuple[str | None, str, str, str]:
    """(kind or None, text before, value, text after) of one generated example."""
    dig = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    low = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    pick = r.randrange(12)
    if pick < 2:
        at, dot = r.choice([("@", "."), ("@", "."), ("(at)", "."), ("[at]", "."), ("[at]", "[dot]"), ("(at)", "(dot)")])
        return "email", "", low(2, 8) + r.choice(["", ".", "_"]) + r.choice(["", dig(2)]) + at + low(3, 8) + dot + r.choice(["com", "org", "net", "example.com", "de"]), ""
    if pick == 2:
        sep = r.choice([".", ".", "-"])
        four = sep.join(str(r.randrange(256)) for _ in range(4))
        return "ip", "", r.choice([four, ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))]), ""
    if pick < 5:
        d = dig(15)
        d += next(c for c in "0123456789" if _luhn(d + c))
        return "card", "", r.choice(["", " ", "-", "."]).join(d[i : i + 4] for i in range(0, 16, 4)), ""
    if pick < 7:
        a, b, c = str(r.randint(2, 9)) + dig(2), dig(3), dig(4)
        return "phone", "", r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+{r.randint(20, 99)} {a} {b}{c}", f"00{r.randint(20, 99)} {a} {b}{c}"]), ""
    if pick < 10:
        alphabet = r.choice(["0123456789abcdef", "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-"])
        v = "".join(r.choice(alphabet) for _ in range(r.choice([24, 32, 36, 40, 40, 48])))
        name, quote = r.choice(["token", "api_key", "secret", "password", "key", low(3, 8)]), r.choice(['"', '"', "", "'"])
        return "secret", r.choice([f"{name} = {quote}", f"{name}={quote}", f"{name}: {quote}", f"{quote}"]), v, quote
    return None, "", r.choice([dig(r.randint(1, 8)), f"{dig(2)}.{dig(2)}", f"20{dig(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"v{dig(1)}.{dig(1)}.{dig(1)}", f"{dig(1)},{dig(3)}",
                               low(22, 40), f"({low(3, 9)})", f"[{dig(1)}]", f"{low(4, 9)}-{dig(4)}", f"{dig(1)}:{dig(2)}", low(3, 6) + "@"]), ""


def made(carriers: list[str], seed: int = 0, copies: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(codes, tags) of windows: each carrier text with a generated value put in, cut to WINDOW characters, copies times."""
    r, xs, ys = random.Random(seed), [], []
    for c in carriers * copies:
        kind, before, v, after = _value(r)
        at = r.randrange(len(c) + 1)
        gap = r.choice([" ", " ", " ", "", "\n", "### "]) if kind != "secret" else " "
        left = c[:at] + gap + before
        text = (left + v + after + r.choice([" ", " ", ". ", "\n", ", "]) + c[at:]).ljust(WINDOW)
        tag = np.zeros(len(text), np.int64)
        if kind:
            tag[len(left) : len(left) + len(v)] = KINDS.index(kind) + 1
        for k, a, b in base_spans(text):
            tag[a:b] = KINDS.index(k) + 1
        lo = r.randint(max(0, min(len(left) - WINDOW + 8, len(text) - WINDOW)), min(len(left) + len(v), len(text) - WINDOW))
        xs.append(_codes(text)[lo : lo + WINDOW])
        ys.append(tag[lo : lo + WINDOW])
    return np.array(xs), np.array(ys)


def fit(docs: DataFrame) -> dict | None:
    """Net trained on values put into pieces of the sample's texts."""
    n = docs.count()
    share = int(min(1.0, TRAIN_DOCS / max(n, 1)) * (1 << 30))
    sample = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share)
    at = lambda k: F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(F.length("text") - 2 * WINDOW, F.lit(1))).cast("int") + 1
    pieces = sample.where("length(text) > 0").select(F.explode(F.array(*[F.substring(F.col("text"), at(k), F.lit(2 * WINDOW)) for k in range(CARRIERS)])).alias("c"))
    carriers = sorted(r.c for r in pieces.collect())
    return train(*made(carriers)) if carriers else None


def find(docs: DataFrame, net: dict | None) -> DataFrame:
    """docs with base and spans, arrays of (kind, start, end): the pattern spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.drop("base", "spans")
    kind = "array<struct<kind:string,start:int,end:int>>"

    def run(batches):
        import pyarrow as pa

        of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            base, every = spans_of(texts, shared.value)
            as_rows = lambda l: pa.array([[{"kind": k, "start": a, "end": e} for k, a, e in s] for s in l], of)
            yield pa.RecordBatch.from_arrays([*batch.columns, as_rows(base), as_rows(every)], [*batch.schema.names, "base", "spans"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *_parse_datatype_string(f"base {kind}, spans {kind}").fields]))


def spans_of(texts: list[str], net: dict | None) -> tuple[list, list]:
    """(base spans, all spans) of every text, ordered by kind and start."""
    base = [base_spans(t) for t in texts]
    more = model_spans(texts, net, base) if net else [[] for _ in texts]
    return base, [sorted(b + x, key=lambda s: (KINDS.index(s[0]), s[1])) for b, x in zip(base, more)]


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts, out = batch.column(k).to_pylist(), []
            for t, spans in zip(texts, spans_of([t or "" for t in texts], shared.value)[1]):
                end, parts = 0, []
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= end:
                        parts += [t[end:a], f"[{kind}]"]
                    end = max(end, b)
                out.append("".join(parts) + t[end:] if spans else t)
            yield batch.set_column(k, "text", pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, fit(docs))
    n = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias("n_" + k) for k in BASE_KINDS]
    secret = F.expr("size(filter(spans, s -> s.kind = 'secret'))").cast("long").alias("n_secret")
    return out.select("doc_id", *n, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), secret)
