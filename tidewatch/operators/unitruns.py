"""Runs of units from their events, with a unit's events split over many tasks.

What a run of events does to a unit depends on four numbers only: how many runs are open, how many of
them no `started` has confirmed yet (the youngest ones, as the oldest is always confirmed first), and
when and with which details the run that ended last did so. Runs end in the order they were opened in,
so the n-th ending that closes a run closes the n-th run opened, and no queue is ever carried.

Events are put in order by range and cut into segments; a unit that is one segment is walked as it is
cut, so no more than a batch of its task's events is held. The segments of other units are walked in parallel, from nothing open and from more open runs than can
end. A walk gives a summary: the state it came from, the state it leads to, and how far the state
before it may differ with every decision staying the same. Summaries of a unit are chained in order.
Where none holds for the state that reaches a segment, the segment is walked again from that state,
and the nearest summary is the guess for what comes after; so one more walk is the rule. Each round
settles at least one more segment, so any stream ends.
"""
from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written

#: Seconds after a run's end in which an ending event still speaks of that run.
NEAR_US = 5_000_000
SEGMENT = 16_384  # 65,536 at most
#: No time; and more open runs than any segment ends.
NEVER, MANY = 1 << 62, 1 << 40

_KEY = "scan string, unit string, part int, seq int"
_EVENTS = "ts array<long>, kind array<string>, exit_code array<int>, result array<string>"
_CUT = f"{_KEY}, nth int, ts long, kind string, exit_code int, result string, run long"
_STATE = "open long, fresh long, end long, coded boolean, bad boolean"
_COUNTS = "opened long, closed long, orphans long"
_COLUMNS = ["open", "fresh", "end", "coded", "bad"]


def _walk(kinds, times, codes, results, state, counts=(0, 0, 0), last=0):
    """(state, counts, last, run of each event, margins) after the events.

    state: (open, fresh, end, coded, bad), as _STATE, end NEVER where nothing has ended. last is the run
    that ended last. Runs opened are numbered from 1 on, those without a start from -1 down; 0 is no run.
    margins are the least numbers that decisions saw: runs open at an ending, fresh runs at a `started`,
    confirmed ones at a closing, and whether any of the three was 0.
    """
    (open_, fresh, end, coded, bad), (opened, closed, orphans), run = state, counts, []
    low = [NEVER, NEVER, NEVER]
    zero = [False, False, False]

    def saw(what, n):
        if n:
            low[what] = min(low[what], n)
        else:
            zero[what] = True

    for kind, t, code, result in zip(kinds, times, codes, results):
        if kind == "started":
            saw(1, fresh)
            if fresh:
                fresh -= 1
                run.append(0)
                continue
        if kind in ("start", "started"):
            opened, open_, fresh = opened + 1, open_ + 1, fresh + (kind == "start")
            run.append(opened)
            continue
        has_code, has_result = code is not None and code == code, isinstance(result, str)
        near = end != NEVER and t - end <= NEAR_US
        fits = near and (not coded if has_code else not bad if has_result else True)
        if not fits:
            saw(0, open_)
        if not fits and not (near and not open_):
            coded = bad = False
            if open_:
                saw(2, open_ - fresh)
                open_, closed = open_ - 1, closed + 1
                fresh, last = min(fresh, open_), closed
            else:
                orphans += 1
                last = -orphans
        run.append(last)
        end, coded, bad = t, coded or has_code, bad or (has_result and result != "success")
    return (open_, fresh, end, coded, bad), (opened, closed, orphans), last, run, low + zero


def _holds(delta_open, delta_fresh, low, zero) -> bool:
    """Whether all decisions stay when so many more runs are open and fresh before a segment."""
    return all((d == 0 or not z) and (n == NEVER or n + d > 0) for d, n, z in zip((delta_open, delta_fresh, delta_open - delta_fresh), low, zero))


def _cut(frames):
    """The events of a sorted partition, a row each, with their place in a segment of one unit.

    A unit that is one segment for certain is walked at once, and its events have their runs. Not more than
    a batch and a segment are held.
    """
    part, key, seq, rows, out, opening = TaskContext.get().partitionId(), None, 0, [], [], True
    columns = [c.split()[0] for c in _CUT.split(", ")]

    def segment(whole):
        runs = _walk(*zip(*((k, t, c, r) for t, k, c, r in rows)), (0, 0, NEVER, False, False))[3] if whole else [None] * len(rows)
        out.extend((*key, part, seq, n, *event, run) for n, (event, run) in enumerate(zip(rows, runs)))

    def table():
        f = pd.DataFrame(out, columns=columns)
        out.clear()
        return f.astype({"exit_code": "Int32", "run": "Int64"})

    for f in frames:
        codes = f["exit_code"].astype("Int32").astype(object).where(f["exit_code"].notna(), None)
        for scan, unit, *event in zip(f["scan"], f["unit"], f["us"], f["kind"], codes, f["result"]):
            if (scan, unit) != key or len(rows) == SEGMENT:
                same = (scan, unit) == key
                if rows:
                    segment(not (same or opening or seq))
                    opening &= same
                seq = seq + 1 if same else 0
                key, rows = (scan, unit), []
            rows.append(event)
        if out:
            yield table()
    if rows:
        segment(False)  # the unit may go on in the next task
        yield table()


_SUMMARY = f"{_KEY}, again boolean, start long, {_STATE}, to_open long, to_fresh long, to_end long, to_coded boolean, to_bad boolean, ended boolean, {_COUNTS}, last long, low array<long>, zero array<boolean>"
_CHAINED = f"{_KEY}, {_STATE}, {_COUNTS}, last long, holds boolean"


def _summaries(frames, again):
    """Walks of segments from the states they come with (again), or from none open and from many open, confirmed or not."""
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            states = [(r.open, r.fresh, r.end, r.coded, r.bad)] if again else [(n, m, NEVER, False, False) for n, m in ((0, 0), (MANY, 0), (MANY, MANY))]
            for state in states:
                to, counts, last, _, margins = _walk(r.kind, r.ts, r.exit_code, r.result, state)
                ended = any(k not in ("start", "started") for k in r.kind)
                out.append((r.scan, r.unit, r.part, r.seq, again, r.ts[0], *state, *to, ended, *counts, last, margins[:3], margins[3:]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SUMMARY.split(", ")])


def _chain(f: pd.DataFrame) -> pd.DataFrame:
    """The state and the counts that reach every segment of a unit, and whether a summary holds for them."""
    state, counts, last, out = (0, 0, NEVER, False, False), (0, 0, 0), 0, []
    for (part, seq), walks in f.groupby(["part", "seq"]):
        walks = list(walks.itertuples(index=False))
        open_, fresh, *ending = state
        if ending[0] == NEVER or walks[0].start - ending[0] > NEAR_US:
            ending = [NEVER, False, False]
        fit = [w for w in walks if ending == [w.end, w.coded, w.bad] and _holds(open_ - w.open, fresh - w.fresh, w.low, w.zero)]
        # without one that holds, the nearest gives a guess
        w = fit[0] if fit else min(walks, key=lambda w: (bool(w.open) != bool(open_), bool(w.fresh) != (fresh == open_), w.again))
        out.append((w.scan, w.unit, part, seq, open_, fresh, *ending, *counts, last, bool(fit)))
        after = [w.to_end, w.to_coded, w.to_bad] if w.ended else list(state[2:])
        if w.last:
            last = counts[1] + w.last if w.last > 0 else -(counts[2] - w.last)
        to = max(w.to_open + open_ - w.open, 0)
        state = (to, min(max(w.to_fresh + fresh - w.fresh, 0), to), *after)
        counts = tuple(a + b for a, b in zip(counts, (w.opened, w.closed, w.orphans)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _CHAINED.split(", ")])


def _label(frames):
    for f in frames:
        f["run"] = [_walk(r.kind, r.ts, r.exit_code, r.result, (r.open, r.fresh, r.end, r.coded, r.bad), (r.opened, r.closed, r.orphans), r.last)[3] for r in f.itertuples(index=False)]
        yield f[[*(c.split()[0] for c in f"{_KEY}, {_EVENTS}".split(", ")), "run"]]


def unit_runs(events: DataFrame) -> DataFrame:
    """(scan, unit, start, end, exit_code, result) from unit_events (unit, ts, lineno, kind, exit_code, result).

    A start opens a run; `started` confirms the oldest unconfirmed one or opens one. An ending event
    belongs to the run that ended at most 5 seconds before, where no run is open or it tells something
    new of it; else it ends the oldest open run, or is a run without length. A run ends with its last
    ending event, has the first exit code given, and the first verdict other than success; success is
    implied by a finish without a failing exit code before it. Events of no unit are left out.
    """
    d = events.where("unit is not null")
    has = set(events.columns)
    place = [F.col(c) if c in has else F.lit("").alias(c) for c in ("src", "source") if c in has or c == "source"]
    # a scan's own type is kept for the result
    scan = d.select(F.col("scan") if "scan" in has else F.lit(0).alias("scan")).schema["scan"].dataType
    d = d.select((F.col("scan") if "scan" in has else F.lit(0)).cast("string").alias("scan"), "unit", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.struct(*place, "lineno").alias("at"), "kind", F.col("exit_code").cast("int").alias("exit_code"), "result")
    d, order = written(d), ["scan", "unit", "us", "at"]  # ranges are sampled before events are dealt out
    cut = written(d.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_cut, _CUT))
    key = ["scan", "unit", "part", "seq"]
    # the few segments of units that others may go on in, or that are long
    event = F.array_sort(F.collect_list(F.struct("nth", "ts", "kind", "exit_code", "result")))
    parts = cut.where("run is null").groupBy(*key).agg(event.alias("e")).select(*key, *[F.col(f"e.{c.split()[0]}").alias(c.split()[0]) for c in _EVENTS.split(", ")])
    walked = written(parts.mapInPandas(lambda frames: _summaries(frames, False), _SUMMARY))
    while True:
        chained = written(walked.groupBy("scan", "unit").applyInPandas(_chain, _CHAINED))
        again = chained.where("not holds")
        if again.isEmpty():
            break
        more = parts.join(again.select(*key, *_COLUMNS), key).mapInPandas(lambda frames: _summaries(frames, True), _SUMMARY)
        walked = written(walked.join(again.select(*key, F.lit(True).alias("again")), [*key, "again"], "left_anti").unionByName(more))
    labelled = parts.join(chained.drop("holds"), key).mapInPandas(_label, f"{_KEY}, {_EVENTS}, run array<long>")
    labelled = labelled.select(*key, F.posexplode(F.arrays_zip("ts", "kind", "exit_code", "result", "run")).alias("nth", "e")).select(*key, "nth", "e.*")
    d = cut.where("run is not null").unionByName(labelled)
    d = d.withColumn("at", F.expr("shiftleft(cast(part as bigint), 40) + shiftleft(cast(seq as bigint), 16) + nth")).where("run <> 0")
    ends, coded = F.col("kind").isin("finish", "fail"), F.when(F.col("exit_code").isNotNull(), F.col("at"))
    r = d.groupBy("scan", "unit", "run").agg(
        F.min("ts").alias("start"), F.max(F.when(ends, F.col("ts"))).alias("end"), F.min_by("exit_code", coded).alias("exit_code"), F.min(coded).alias("_coded"),
        F.min_by("result", F.when(F.col("result") != "success", F.col("at"))).alias("_bad"), F.max(F.coalesce(F.col("result") == "success", F.lit(False))).alias("_good"),
        F.min(F.when(F.col("kind") == "finish", F.col("at"))).alias("_finish"))
    fine = F.col("_finish").isNotNull() & (F.col("exit_code").isNull() | (F.col("exit_code") == 0) | (F.col("_finish") < F.col("_coded")))
    result = F.coalesce("_bad", F.when(F.col("_good") | F.coalesce(fine, F.lit(False)), "success"))
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return r.select(F.col("scan").cast(scan).alias("scan"), "unit", time("start"), time("end"), "exit_code", result.alias("result"))
