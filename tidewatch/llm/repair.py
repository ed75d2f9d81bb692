"""Conversation structure repair by A* on the edit lattice.

The rows of a conversation, by turn, are to become `system? (user assistant)+` or nothing. A node of
the lattice is (rows read, state); states are the last role kept: none, system, user or assistant.
Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (blank and duplicate rows must be deleted),
Insert an empty user or assistant row 3; a truncated row that is not deleted adds 3. Inserted and
reroled rows have the one role their state allows, so the edits' initials (the audit) fix the result.

A* keys are (cost plus heuristic, audit). The heuristic of a node is a suffix sum over the rows not
read: 4 for each that must be deleted, 3 for each truncated one, which costs that at least whether it
stays or goes. It never falls by more than an edit costs, so the first time a node is taken it has
its least cost, and of equal ones the ASCII-least audit.

Only a symbol per row is searched, never its text. Rows are put in order by range, so that a long
conversation lies over many tasks and none holds it, and cut into pieces of PIECE rows at most. A
conversation that is one piece is searched once, and equal symbol strings of a task once. Of the other
ones each piece is searched from all four states to all four, in parallel, and the conversation's
tables of 16 audits are chained in order; that needs memory in proportion to the audit itself. The
repaired rows are shuffled once and hashed as a stream.

Rows of equal turn are ordered by role, text (its first 64 characters, then its SHA-256) and row.
A null turn comes first; a null role or text is one space. Null conv_ids are one conversation. Equal
rows are duplicates. An empty role is no known one. An empty table gives an empty one. Other columns
are ignored, whatever their names.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

PIECE = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: the last role kept.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant row leads to, by state, and the roles of states.
TURN, ROLE = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}, {USER: "user", ASSISTANT: "assistant"}
#: Symbols: initials of rows without a fault; truncated ones are upper-case, those to delete are digits. x is any other role.
INITIALS = "suax"
DOOMED = "0123"
NO_TEXT = r"[^\x20\x09-\x0D]"


def _kept(state: int, initial: str) -> int | None:
    """The state after a row is kept as it is, None where it may not be."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    return TURN[state] if initial == ROLE[TURN[state]][0] else None


def search(symbols: str, entry: int, exits: frozenset) -> dict[int, tuple[int, str]]:
    """(least cost, ASCII-least audit) of reading all symbols from state entry, per state of exits.

    With several exits each has its own; a caller that wants the best of them takes the least.
    """
    ahead = [0]
    for c in reversed(symbols):
        ahead.append(ahead[-1] + (DELETE if c in DOOMED else TRUNCATED if c.isupper() else 0))
    ahead.reverse()
    n, taken, out = len(symbols), set(), {}
    heap = [(ahead[0], "", 0, entry)]
    while heap and len(out) < len(exits):
        f, audit, i, state = heappop(heap)
        if (i, state) in taken:
            continue
        taken.add((i, state))
        cost = f - ahead[i]
        if i == n and state in exits:
            out[state] = (cost, audit)
        steps = [(INSERT, "I", i, TURN[state])]
        if i < n:
            c = symbols[i]
            steps.append((DELETE, "D", i + 1, state))
            if c not in DOOMED:
                more = TRUNCATED if c.isupper() else 0
                to = _kept(state, c.lower())
                if to is not None:
                    steps.append((KEEP + more, "K", i + 1, to))
                steps.append((REROLE + more, "R", i + 1, TURN[state]))
        for extra, letter, j, to in steps:
            if (j, to) not in taken:
                heappush(heap, (cost + extra + ahead[j], audit + letter, j, to))
    return out


@lru_cache(maxsize=1 << 15)
def best(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return min(search(symbols, NONE, frozenset((NONE, ASSISTANT))).values())


def illegal(symbols: str) -> int:
    """Neighbours whose initials are not system-user, user-assistant or assistant-user."""
    s = [INITIALS[int(c)] if c in DOOMED else c.lower() for c in symbols]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(s, s[1:]))


def decode(symbols: str, entry: int, audit: str) -> list[tuple[list[str], str, str | None, list[str]]]:
    """Per row: roles inserted before it, its edit, its new role (None: its own), roles inserted after it (the last row alone)."""
    out, state, before, i = [], entry, [], 0
    for letter in audit:
        if letter == "I":
            state = TURN[state]
            before.append(ROLE[state])
            continue
        c, role = symbols[i], None
        if letter == "K":
            state = _kept(state, c.lower())
        elif letter == "R":
            state = TURN[state]
            role = ROLE[state]
        out.append((before, letter, role, []))
        before, i = [], i + 1
    if before:
        out[-1][3].extend(before)
    return out


def damage(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, cut short, repeated and reroled by crc32(`conv_id:turn`) % 20."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conv.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20).alias("_x")).where("_x <> 0")
    text = F.when(F.col("_x") == 1, "").when(F.col("_x") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.withColumn("text", text).withColumn("role", F.when(F.col("_x") == 4, "user").otherwise(F.col("role")))
    return d.withColumn("_copy", F.explode(F.expr("if(_x = 3, array(0, 1), array(0))"))).drop("_x", "_copy")


def faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, key, turn, role, head, digest, fault) and rows (conv_id, turn, role, text) with key and row; fault is blank, duplicate, truncated or null."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    d = cut(rows.select("conv_id", "turn", "role", "text", key.alias("key"), F.left("text", F.lit(64)).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    first = d.groupBy("key", "role", "digest").agg(F.min(F.struct("turn", "head", "row")).alias("f")).select("f.row", F.lit(True).alias("first"))
    end = F.right(F.rtrim("text", F.lit(" \t\n\v\f\r")), F.lit(1))
    fault = F.when(~F.regexp_like("text", F.lit(NO_TEXT)), "blank").when(F.col("first").isNull(), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    flags = d.join(first, "row", "left").select("row", "key", "turn", "role", "head", "digest", fault.alias("fault"))
    return cut(flags), d


def _pieces(frames):
    """Pieces of the conversations of a sorted partition, in order."""
    part = TaskContext.get().partitionId()
    key, symbols, rows, seq, opening, out = None, [], [], 0, True, []

    def piece(whole):
        out.append((key, part, seq, whole, "".join(symbols), rows))

    for f in frames:
        for k, s, r in zip(f["key"], f["symbol"], f["row"]):
            if k != key:
                if symbols:
                    piece(not opening and seq == 0)
                    opening = False
                key, symbols, rows, seq = k, [], [], 0
            elif len(symbols) == PIECE:
                piece(False)
                symbols, rows, seq = [], [], seq + 1
            symbols.append(s)
            rows.append(r)
        if out:
            yield pd.DataFrame(out, columns=_PIECE)
            out.clear()
    if symbols:
        piece(False)  # it may go on in the next task
        yield pd.DataFrame(out, columns=_PIECE)


_PIECE = ["key", "part", "seq", "whole", "symbols", "rows"]
_SOLVED = "key string, part int, seq int, entry int, audit string, cost long, illegal long"


def _whole(frames):
    for f in frames:
        got = [best(s) for s in f["symbols"]]
        yield pd.DataFrame({"key": f["key"], "part": f["part"], "seq": f["seq"], "entry": NONE, "audit": [a for _, a in got], "cost": [c for c, _ in got], "illegal": [illegal(s) for s in f["symbols"]]})


def _tables(frames):
    """Per piece the (entry, exit, cost, audit) of all its ways."""
    for f in frames:
        ways = [[(e, x, c, a) for e in TURN for x, (c, a) in search(s, e, frozenset(TURN)).items()] for s in f["symbols"]]
        yield pd.DataFrame({"key": f["key"], "part": f["part"], "seq": f["seq"], "first": [s[0] for s in f["symbols"]], "last": [s[-1] for s in f["symbols"]],
                            "illegal": [illegal(s) for s in f["symbols"]], "ways": [[dict(zip(("entry", "exit", "cost", "audit"), w)) for w in x] for x in ways]})


def _chain(f: pd.DataFrame) -> pd.DataFrame:
    """The way through all pieces of one conversation that costs least and has the ASCII-least audit."""
    f = f.sort_values(["part", "seq"])
    reached, back = {NONE: (0, "")}, []
    for ways in f["ways"]:
        step = {}
        for w in ways:
            if w["entry"] in reached:
                cost, audit = reached[w["entry"]]
                new = (cost + w["cost"], audit + w["audit"], w["entry"], w["cost"], w["audit"])
                step[w["exit"]] = min(new, step.get(w["exit"], new))
        reached = {x: v[:2] for x, v in step.items()}
        back.append({x: v[2:] for x, v in step.items()})
    state, chosen = min((NONE, ASSISTANT), key=lambda x: reached.get(x, (1 << 62, ""))), []
    for step in reversed(back):
        entry, cost, audit = step[state]
        chosen.append((entry, audit, cost))
        state = entry
    chosen.reverse()
    borders = [0] + [illegal(a + b) for a, b in zip(f["last"][:-1], f["first"][1:])]
    return pd.DataFrame({"key": f["key"], "part": f["part"], "seq": f["seq"], "entry": [c[0] for c in chosen], "audit": [c[1] for c in chosen],
                         "cost": [c[2] for c in chosen], "illegal": [a + b for a, b in zip(f["illegal"], borders)]})  # a piece counts the pair with the piece before


def solve(flags: DataFrame) -> DataFrame:
    """Pieces (key, part, seq, symbols, rows) of conversations with entry, audit, cost and illegal, from faults()."""
    initial = F.left("role", F.lit(1))
    nth = F.when(initial.isin("s", "u", "a"), F.instr(F.lit(INITIALS), initial) - 1).otherwise(3)
    plain = F.substring(F.lit(INITIALS), nth + 1, F.lit(1))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), nth.cast("string")).when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)
    order = ["key", "turn", "role", "head", "digest", "row"]
    p = flags.withColumn("symbol", symbol).repartitionByRange(*order).sortWithinPartitions(*order).select("key", "symbol", "row")
    p = cut(p.mapInPandas(_pieces, "key string, part int, seq int, whole boolean, symbols string, rows array<long>"))
    whole = p.where("whole").select("key", "part", "seq", "symbols").mapInPandas(_whole, _SOLVED)
    ways = p.where("not whole").select("key", "part", "seq", "symbols").mapInPandas(
        _tables, "key string, part int, seq int, first string, last string, illegal long, ways array<struct<entry:int, exit:int, cost:long, audit:string>>")
    chained = ways.groupBy("key").applyInPandas(_chain, _SOLVED)
    return cut(p.drop("whole").join(whole.unionByName(chained), ["key", "part", "seq"]))


def _edits(frames):
    for f in frames:
        out = []
        for key, part, seq, symbols, rows, entry, audit in zip(f["key"], f["part"], f["seq"], f["symbols"], f["rows"], f["entry"], f["audit"]):
            out += [(key, part, seq, i, row, *e) for i, (row, e) in enumerate(zip(rows, decode(symbols, entry, audit)))]
        yield pd.DataFrame(out, columns=["key", "part", "seq", "nth", "row", "before", "edit", "role", "after"])


def repaired(solved: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, conv_id, part, seq, nth, sub, role, text, edit): the rows of the repaired conversations, in that order."""
    kind = "key string, part int, seq int, nth int, row long, before array<string>, edit string, role string, after array<string>"
    e = solved.select("key", "part", "seq", "symbols", "rows", "entry", "audit").mapInPandas(_edits, kind).withColumnRenamed("role", "new")
    e = e.where("edit <> 'D' or size(before) > 0 or size(after) > 0")
    d = e.join(rows.select("row", "conv_id", "role", "text"), "row")
    made = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    own = F.when(F.col("edit") == "D", F.expr("cast(array() as array<struct<role:string,text:string,edit:string>>)")).otherwise(F.array(F.struct(F.coalesce("new", "role").alias("role"), "text", "edit")))
    d = d.select("key", "conv_id", "part", "seq", "nth", F.posexplode(F.concat(made("before"), own, made("after"))).alias("sub", "r"))
    return d.select("key", "conv_id", "part", "seq", "nth", "sub", "r.role", "r.text", "r.edit")


def _hashes(frames):
    """SHA-256 of the lines of every conversation of a sorted partition; a conversation is never held."""
    key, h = None, None
    for f in frames:
        done = []
        for k, role, text in zip(f["key"], f["role"], f["text"]):
            line = f"{role}:{text}".encode()
            if k == key:
                h.update(b"\n" + line)
            else:
                if h:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(line)
        if done:
            yield pd.DataFrame(done, columns=["key", "repaired_sha256"])
    if h:
        yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "repaired_sha256"])


def report(original: DataFrame, damaged: DataFrame) -> DataFrame:
    """Per conv_id of original: gaps and faults of the damaged rows, and what their repair is and costs."""
    flags, rows = faults(damaged)
    solved = solve(flags)
    lines = repaired(solved, rows).select("key", "part", "seq", "nth", "sub", "role", "text")
    order = ["key", "part", "seq", "nth", "sub"]
    sha = lines.repartition("key").sortWithinPartitions(*order).select("key", "role", "text").mapInPandas(_hashes, "key string, repaired_sha256 string")
    count = lambda what: F.count_if(F.col("fault") == what).alias(what)
    seen = flags.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    cost = solved.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    every = original.select("conv_id").distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    out = every.join(seen, "key", "left").join(cost, "key", "left").join(sha, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op12_repair(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return report(conv, damage(conv))
