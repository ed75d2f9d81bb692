"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts.

Texts are cut into blocks that send their distinct words and word pairs, as hashes with their counts
in the training texts, to buckets by hash range (blocks.py). The task of a bucket adds the counts up,
quantises those of the pairs to q = 1 + floor(log2 count), enters a pair once for each level 1..q into
its part of the filter, and answers the blocks by repeated membership probes: levels until one is
missing. The filter grows with the corpus and has no bounded size, so it isn't broadcast whole; every
part of it stays with its probes.

p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU), where p(w) = (c(w) + 1) / (N + V + 1). c(v w) is the
lower end 2 ** (q - 1) of the level found, and 0 where v or w is new, so the mass of a context is at
most 1 but for false hits of the filter, at most 2 ** -21 an unseen pair. New words are one event. A
text begins after an end mark.

Word counts are exact but for equal 64-bit hashes. Null text counts as empty and has one token, the
end. A null doc_id trains and is returned null. Equal rows are separate texts; an empty table gives
an empty one; other columns are ignored.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ROWS, blocks, buckets, by_rank, dump, dump_ids, load, load_ids, starts
from .common import cut, table

BITS_PER_ENTRY, PROBES, MU, END = 32, 16, 5.0, b"\n"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(_mix(first) * np.uint64(0x9E3779B97F4A7C15) + second)


def _levels(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count), 0 for none."""
    return np.frexp(count.astype(float))[1]


class Filter:
    """Log-frequency Bloom filter over hashes and their counts."""

    def __init__(self, h: np.ndarray, count: np.ndarray):
        q = _levels(count)
        self.bits = np.uint64(64 * max(1, math.ceil(int(q.sum()) * BITS_PER_ENTRY / 64)))
        bit = np.zeros(int(self.bits), bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            for s in self._slots(h[q >= level], level):
                bit[s] = True
        self.words = np.packbits(bit)

    def _slots(self, h: np.ndarray, level: int):
        a = _mix(h + np.array([level], np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        step = _mix(a) | np.uint64(1)
        for k in range(PROBES):
            yield ((a + np.uint64(k) * step) % self.bits).astype(np.int64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level without a missing one below it."""
        out, live, level = np.zeros(len(h), np.uint8), np.arange(len(h)), 1
        while len(live):
            own, kept = h[live], np.ones(len(live), bool)
            for s in self._slots(own, level):
                kept &= (self.words[s >> 3] << (s & 7).astype(np.uint8)) & 128 > 0
            live = live[kept]
            out[live] = level
            level += 1
        return out


def _pairs(pos: np.ndarray, lens: np.ndarray, n: int, end: int):
    """(pair number of every token, first and second word of every pair); a text begins after end."""
    code = np.empty(len(pos), np.int64)
    code[1:] = pos[:-1]
    code[starts(lens)[:-1]] = end
    code *= n
    code += pos
    code, pairs = pd.factorize(code)
    return code.astype("i4"), (pairs // n).astype("i4"), (pairs % n).astype("i4")


def _gaps(h: np.ndarray) -> np.ndarray:
    return np.diff(h, prepend=np.uint64(0))


def score(docs: DataFrame, held) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the texts whose held(doc_id) is false train."""
    n = buckets(docs)

    def pack(words, ids, at):
        import xxhash

        order, lens, pos = by_rank(at, len(words))
        h = np.array([xxhash.xxh64_intdigest(words[i], 42) for i in order], np.uint64)
        end = int(np.flatnonzero(order == words.index(END))[0])
        code, first, second = _pairs(pos, lens, len(h), end)
        hp = pair_hash(h[first], h[second])
        train = np.repeat([not held(i) for i in ids], lens)
        yield -1, dump(*dump_ids(ids), lens, pos, h, np.array([end]))
        parts = []
        for x, c in ((h, np.bincount(pos[train], minlength=len(h))), (hp, np.bincount(code[train], minlength=len(hp)))):
            o = np.argsort(x, kind="stable")
            cuts = np.searchsorted(((x[o] >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
            parts.append((x[o], c[o].astype("<u4"), cuts))
        for b in range(n):
            own = [(x[k[b] : k[b + 1]], c[k[b] : k[b + 1]]) for x, c, k in parts]
            if len(own[0][0]) or len(own[1][0]):
                yield b, dump(_gaps(own[0][0]), own[0][1], _gaps(own[1][0]), own[1][1])

    def answer(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(n=0, v=0)
        if f["bucket"].iloc[0] < 0:
            return f
        parts = [load(d) for d in f["data"]]
        found = []
        for k in (0, 2):
            h, inv = np.unique(np.concatenate([np.cumsum(p[k], dtype=np.uint64) for p in parts]), return_inverse=True)
            c = np.bincount(inv, np.concatenate([p[k + 1] for p in parts]), len(h)).astype(np.int64)
            if k == 0:
                f.iloc[0, f.columns.get_indexer(["n", "v"])] = int(c.sum()), int((c > 0).sum())
            got = c if k == 0 else Filter(h[c > 0], c[c > 0]).levels(h)
            found.append(np.split(got[inv], starts(np.array([len(p[k]) for p in parts]))[1:-1]))
        return f.assign(data=[dump(a, b) for a, b in zip(*found)])

    rows = blocks(docs, lambda t: [*t.lower().split(), END], pack, binary=True)
    rows = cut(rows.groupBy("bucket").applyInPandas(lambda f: answer(f), ROWS + ", n long, v long"))
    total, distinct = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def of_block(f: pd.DataFrame) -> pd.DataFrame:
        head = f["bucket"] < 0
        value, null, lens, pos, h, end = load(f.loc[head, "data"].iloc[0])
        got = [load(d) for d in f[~head].sort_values("bucket")["data"]]
        code, first, second = _pairs(pos, lens, len(h), int(end[0]))
        c = np.empty(len(h))
        c[np.argsort(h, kind="stable")] = np.concatenate([g[0] for g in got])
        level = np.empty(len(first), np.uint8)
        level[np.argsort(pair_hash(h[first], h[second]), kind="stable")] = np.concatenate([g[1] for g in got])
        both = np.where((level > 0) & (c[first] > 0) & (c[second] > 0), np.ldexp(1.0, level.astype("i4") - 1), 0)
        prob = np.log10((both + MU * (c[second] + 1) / (total + distinct + 1)) / (c[first] + MU))
        base, known, at, ids = np.log10((c + 1) / (total + 1 * (distinct + 1))), c > 0, starts(lens), load_ids(value, null)
        out = [(held(i), b - a, int(known[pos[a:b]].sum()), total, math.fsum(base[pos[a:b]]), math.fsum(prob[code[a:b]])) for i, a, b in zip(ids, at, at[1:])]
        d = pd.DataFrame(out, columns=["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        d.insert(0, "doc_id", pd.array(ids, "Int64"))
        return d

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").applyInPandas(of_block, kind)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def op2_lm(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), held_out)
