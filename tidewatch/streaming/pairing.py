"""Runs of cron and of units, and overlaps, of a stream of log lines.

runs() closes cron commands by their sessions as batch pairing does. A machine's (scan's) lines wait
in its state until the watermark has passed them and are then taken in the order of the merged stream,
so lines may come late by the watermark's delay; later ones are late data and dropped. A run is told
when its session ends, or at once where it has none. The state holds the lines that wait and the live
sessions, one per pid.

unit_runs() takes a unit's events in the same way and walks them as the batch does. A run is told once
no later event can belong to it: when another run has ended, or when the watermark is 5 seconds past
its end. The state holds the events that wait, the open runs, and the one that ended last.

overlaps() joins a stream of runs with itself; runs are no longer than `longest`, which bounds how
long a run is kept for runs that end later.
"""
from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import unitruns
from ..operators.runs import NEAR_S
from ..sources import logs

_NEAR_US = NEAR_S * 1_000_000


def settle(live: dict, lines: Iterable) -> list[tuple]:
    """Runs (user, command, start, end, pid) that lines (us, src, lineno, pid, user, command, action), in order, bring to an end; live, by pid, is carried on."""
    out = []
    for us, _, _, pid, user, command, action in lines:
        if action:
            ended = live.pop(str(pid), None)
            if ended and ended["run"]:
                out.append((*ended["run"][:3], us if action == "closed" else None, ended["run"][3]))
            if action == "opened":
                live[str(pid)] = {"us": us, "user": user, "run": None}
            continue
        run = [user, command, us, pid]
        own = live.get(str(pid)) if pid is not None else None
        near = [own] if own and not own["run"] else [s for s in live.values() if not s["run"] and s["user"] == user and 0 <= us - s["us"] <= _NEAR_US]
        if near:
            max(near, key=lambda s: s["us"])["run"] = run
        else:
            out.append((user, command, us, None, pid))
    return out


def runs(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of (scan, user, command, start, end, pid) from a stream of lines (scan, src, source, lineno, value) with full stamps."""
    d = logs.cron_lines(logs.parse(lines, None))
    d = d.select("scan", "src", "lineno", "pid", "user", "command", "action", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", delay).withColumn("us", F.unix_micros("at"))

    def step(key, frames, state: GroupState):
        waiting, live = map(json.loads, state.get) if state.exists else ([], {})
        for f in frames:
            for us, src, lineno, pid, user, command, action in zip(f["us"], f["src"], f["lineno"], f["pid"], f["user"], f["command"], f["action"]):
                waiting.append([int(us), int(src), int(lineno), None if pd.isna(pid) else int(pid), user, None if pd.isna(command) else command, None if pd.isna(action) else action])
        passed = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda x: x[:3])
        due = [x for x in waiting if x[0] <= passed * 1000]
        told = settle(live, due)
        waiting = waiting[len(due):]
        state.update((json.dumps(waiting), json.dumps(live)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, max(passed, 0)) + 1)
        f = pd.DataFrame(told, columns=["user", "command", "start", "end", "pid"])
        yield f.assign(scan=key[0], **{c: f[c].astype("Int64") for c in ("start", "end", "pid")})[["scan", "user", "command", "start", "end", "pid"]]

    kind = "scan string, user string, command string, start long, end long, pid long"
    return _timed(d.groupBy("scan").applyInPandasWithState(step, kind, "waiting string, live string", "append", GroupStateTimeout.EventTimeTimeout))


def _timed(d: DataFrame) -> DataFrame:
    """start and end from microseconds, in the session's zone as they were taken."""
    return d.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("start", "end")})


def _note(run: dict | None, us: int, kind: str, code: int | None, result: str | None) -> dict:
    """A run with one more of its events."""
    run = run or {"start": us, "end": None, "code": None, "bad": None, "good": False}
    if kind in ("finish", "fail"):
        run["end"] = us
        run["code"] = code if run["code"] is None else run["code"]
        run["bad"] = run["bad"] or (result if result != "success" else None)
        # a finish means success but after a failing exit code
        run["good"] |= result == "success" or (kind == "finish" and not run["code"])
    return run


def walked(carried: dict, events: list) -> None:
    """carried (state, counts, last, runs by number) after events (us, src, source, lineno, kind, code, result), in order."""
    kinds, times, codes, results = ([e[k] for e in events] for k in (4, 0, 5, 6))
    carried["state"], carried["counts"], carried["last"], numbers, _ = unitruns._walk(kinds, times, codes, results, carried["state"], carried["counts"], carried["last"])
    for number, e in zip(numbers, events):
        if number:
            carried["runs"][str(number)] = _note(carried["runs"].get(str(number)), e[0], *e[4:])


def unit_runs(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of (scan, unit, start, end, exit_code, result), as the batch's runs that have ended, from a stream of logs.unit_events (scan, src, source, lineno, ts, unit, kind, exit_code, result).

    Events of no unit are left out; those later than the watermark are late data and dropped. A null scan is one of its own.
    """
    d = events.where("unit is not null").select("scan", "unit", F.col("ts").cast("timestamp").alias("at"), "src", "source", "lineno", "kind", "exit_code", "result")
    d = d.withWatermark("at", delay).withColumn("us", F.unix_micros("at"))

    def step(key, frames, state: GroupState):
        empty = {"state": (0, 0, unitruns.NEVER, False, False), "counts": (0, 0, 0), "last": 0, "runs": {}}
        waiting, carried = map(json.loads, state.get) if state.exists else ([], empty)
        for f in frames:
            for us, src, source, lineno, kind, code, result in zip(f["us"], f["src"], f["source"], f["lineno"], f["kind"], f["exit_code"], f["result"]):
                waiting.append([int(us), int(src), source or "", int(lineno), kind, None if pd.isna(code) else int(code), None if pd.isna(result) else result])
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda x: x[:4])
        due = [x for x in waiting if x[0] <= passed]
        waiting = waiting[len(due):]
        walked(carried, due)
        settled = lambda number, run: run["end"] is not None and (int(number) != carried["last"] or run["end"] + unitruns.NEAR_US <= passed)
        told = [carried["runs"].pop(n) for n in [n for n, run in carried["runs"].items() if settled(n, run)]]
        state.update((json.dumps(waiting), json.dumps(carried)))
        ahead = [x[0] for x in waiting[:1]] + [run["end"] + unitruns.NEAR_US for run in carried["runs"].values() if run["end"] is not None]
        if ahead:
            state.setTimeoutTimestamp(max(min(ahead), passed, 0) // 1000 + 1)
        f = pd.DataFrame([(*key, r["start"], r["end"], r["code"], r["bad"] or ("success" if r["good"] else None)) for r in told], columns=["scan", "unit", "start", "end", "exit_code", "result"])
        yield f.astype({c: "Int64" for c in ("start", "end", "exit_code")})

    kind = "scan string, unit string, start long, end long, exit_code int, result string"
    return _timed(d.groupBy("scan", "unit").applyInPandasWithState(step, kind, "waiting string, carried string", "append", GroupStateTimeout.EventTimeTimeout))


def overlaps(runs: DataFrame, longest: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Stream of (job_id, previous, started, overlap_s) from a stream of runs (job_id, start, end, ord) that have ended, as detect.overlaps."""
    side = lambda p: runs.select(F.col("job_id").alias(f"{p}job"), F.col("start").alias(f"{p}start"), F.col("end").cast("timestamp").alias(f"{p}end"), F.col("ord").alias(f"{p}ord")).withWatermark(f"{p}end", delay)
    # runs of at most `longest` that overlap end within it of each other: what bounds the state
    near = F.expr(f"p_job = c_job AND c_end >= p_end - INTERVAL {longest} AND c_end <= p_end + INTERVAL {longest}")
    d = side("p_").join(side("c_"), near).where(F.col("p_end").cast("timestamp_ntz") > F.col("c_start"))
    d = d.where(F.struct("p_start", "p_end", "p_ord") < F.struct("c_start", "c_end", "c_ord"))
    seconds = F.timestamp_diff("SECOND", "c_start", F.least("p_end", "c_end").cast("timestamp_ntz"))
    return d.select(F.col("p_job").alias("job_id"), F.col("p_start").alias("previous"), F.col("c_start").alias("started"), seconds.alias("overlap_s"))
