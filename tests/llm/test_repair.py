"""Repair against a plain search over every edit, on made conversations and on the whole table."""
import hashlib
import random
import zlib
from functools import lru_cache

import pandas as pd
import pytest

from tidewatch.llm import repair

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string, key string, symbol string, row string"
BLANKS = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if what == 1:
            text = ""
        if what == 2:
            text = "".join(c for c in text if c not in ".!?")
        if what == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def expected(rows, conv):
    """By plain recursion: every edit at every row, of equal costs the least audit."""
    rows = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(r[3].encode()).digest()))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        kinds.append("blank" if not text.strip(BLANKS) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANKS)[-1] not in ".!?" else None)
        seen.add((role, text))

    @lru_cache(None)
    def go(i, said, inserted):
        """(cost, audit, lines) of rows i.. after the initial `said`; at most two inserts in a row are ever of use."""
        ways = [(0, "", ())] if i == len(rows) and said in ("", "a") else []
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[said]
        add = lambda cost, letter, lines, rest: (cost + rest[0], letter + rest[1], lines + rest[2])
        if inserted < 2:
            for r in ("user", "assistant"):
                if r[0] in following:
                    ways.append(add(3, "I", (r + ":",), go(i, r[0], inserted + 1)))
        if i < len(rows):
            ways.append(add(4, "D", (), go(i + 1, said, 0)))
            if kinds[i] not in ("blank", "duplicate"):
                more, (_, _, role, text) = 3 * (kinds[i] == "truncated"), rows[i]
                if role[:1] and role[0] in following:
                    ways.append(add(more, "K", (f"{role}:{text}",), go(i + 1, role[0], 0)))
                for r in ("user", "assistant"):
                    if r[0] in following:
                        ways.append(add(3 + more, "R", (f"{r}:{text}",), go(i + 1, r[0], 0)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = go(0, "", 0)
    turns = [t for _, t, _, _ in rows if t is not None]
    heads = [r[2][:1] for r in rows]
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), bad, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made():
    r, out = random.Random(5), []
    for conv in range(60):
        for turn in range(r.randrange(1, 14)):
            text = r.choice(["Yes.", "No!", "and then", " ", "", "Well? ", f"t{turn}.", f"t{turn}", "Yes."])
            out.append((conv, r.choice([turn, turn, turn, turn + 3, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice([text, text, text, None])))
    return out + [(None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, None, None), (77, 0, "system", "Only this."), (78, 2, "user", "long " * 60_000 + "."), (78, 3, "assistant", "Ok.")]


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_by_plain_search(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in conv.collect()]
    assert tuples(repair.op12_repair(spark, SF)) == sorted((expected(rows, c) for c in {r[0] for r in rows}), key=str)


@pytest.mark.parametrize("piece", [512, 2])
def test_nulls_ties_repeats_and_split_conversations(spark, piece, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = made()
    conv = spark.createDataFrame([(*r, "k", "s", "x") for r in rows], KIND).repartition(3)
    got = tuples(repair.report(conv, repair.damage(conv)))
    assert got == sorted((expected(rows, c) for c in {r[0] for r in rows}), key=str)


def test_pieces_chain_to_the_whole_search():
    r = random.Random(9)
    for _ in range(60):
        s = "".join(r.choice("suaxSUAX0123uaua") for _ in range(r.randrange(1, 40)))
        cuts = sorted({0, len(s), *[r.randrange(len(s) + 1) for _ in range(3)]})
        parts = [s[a:b] for a, b in zip(cuts, cuts[1:])]
        f = next(repair._tables([pd.DataFrame({"key": "k", "part": 0, "seq": range(len(parts)), "symbols": parts})]))
        got = repair._chain(f)
        assert ("".join(got["audit"]), got["cost"].sum(), got["illegal"].sum()) == (*repair.best(s)[::-1], repair.illegal(s))


def test_empty_table(spark):
    conv = spark.createDataFrame([], KIND)
    assert repair.report(conv, repair.damage(conv)).count() == 0


def test_a_conversation_of_dropped_rows(spark):
    turn = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    conv = spark.createDataFrame([(5, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert tuples(repair.report(conv, repair.damage(conv))) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
