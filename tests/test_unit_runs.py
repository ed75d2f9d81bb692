"""Unit runs cut into segments against one walk that keeps the open runs in lists."""
import random
from datetime import datetime, timedelta

import pytest

from tidewatch.operators import unitruns

T = datetime(2026, 3, 1)
EVENT = "scan string, unit string, ts timestamp_ntz, source string, lineno long, kind string, exit_code int, result string, title string"


def expected(rows):
    """Runs (unit, start, end, code, result), each event looking at explicit runs."""
    out = []
    for key in {(r[0], r[1]) for r in rows}:
        every, last = [], None
        for _, _, ts, _, _, kind, code, result, _ in sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (r[2], r[3], r[4])):
            running = [x for x in every if x["end"] is None]
            unconfirmed = [x for x in running if x["fresh"]]
            if kind == "started" and unconfirmed:
                unconfirmed[0]["fresh"] = False
            elif kind in ("start", "started"):
                every.append(dict(start=ts, end=None, code=None, result=None, fresh=kind == "start"))
            else:
                told = last and (last["code"] is not None if code is not None else last["result"] not in (None, "success") if result is not None else False)
                if not (last and ts - last["end"] <= timedelta(seconds=5) and not (running and told)):
                    if not running:
                        every.append(dict(start=ts, code=None, result=None, fresh=False))
                    last = running[0] if running else every[-1]
                last["end"] = ts
                if last["code"] is None:
                    last["code"] = code
                if result is not None:
                    if last["result"] in (None, "success"):
                        last["result"] = result
                elif last["result"] is None and kind == "finish" and not last["code"]:
                    last["result"] = "success"
        out += [(*key, x["start"], x["end"], x["code"], x["result"]) for x in every]
    return sorted(out, key=str)


def made(r, units, span):
    rows = []
    for unit in range(units):
        likes = r.choice([["start", "started", "finish", "fail"], ["start", "finish", "fail", "fail"], ["start", "started"], ["started", "finish"], ["start"], ["start", "start", "started", "fail"]])
        for n in range(r.randrange(1, 60)):
            kind = r.choice(likes)
            code, result = (r.choice([None, None, 0, 1]), r.choice([None, None, "success", "exit-code", "signal"])) if kind in ("finish", "fail") else (None, None)
            rows.append(("s", f"u{unit}", T + timedelta(seconds=r.randrange(span)), r.choice("ab"), n, kind, code, result, "x"))
    return rows


def found(spark, rows):
    got = unitruns.unit_runs(spark.createDataFrame(rows, EVENT).repartition(5))
    return sorted(((x.scan, x.unit, x.start, x.end, x.exit_code, x.result) for x in got.collect()), key=str)


@pytest.mark.parametrize("segment, span", [(16_384, 100), (3, 40), (5, 600), (1, 200)])
def test_segments_equal_one_walk(spark, monkeypatch, segment, span):
    monkeypatch.setattr(unitruns, "SEGMENT", segment)
    rows = made(random.Random(segment), 40, span)
    assert found(spark, rows) == expected(rows)


def test_a_unit_that_never_ends_needs_one_walk(spark, monkeypatch):
    """Open runs pile up over all segments; each summary holds for any number of them."""
    monkeypatch.setattr(unitruns, "SEGMENT", 4)
    rows = [("s", "u", T + timedelta(seconds=n), "a", n, "start", None, None, None) for n in range(200)]
    rows += [("s", "u", T + timedelta(seconds=1000 + 60 * n), "a", n, "finish", 0, None, None) for n in range(150)]
    assert found(spark, rows) == expected(rows)
    walks = []
    real = unitruns.written
    monkeypatch.setattr(unitruns, "written", lambda df: walks.append(1) or real(df))
    found(spark, rows[:200])
    assert len(walks) == 4  # events, segments, summaries and one chain


def test_a_unit_that_is_always_open_needs_one_walk_more(spark, monkeypatch):
    monkeypatch.setattr(unitruns, "SEGMENT", 50)
    r, rows = random.Random(4), []
    for n in range(1500):
        for s, kind, code in ((0, "start", None), (r.choice([3, 600]), "started", None), (2000 + r.randrange(900), "fail", 1)):
            rows.append(("s", "u", T + timedelta(seconds=20 * n + s), "a", 3 * n + len(rows) % 3, kind, code, None, None))
    walks, real = [], unitruns.written
    monkeypatch.setattr(unitruns, "written", lambda df: walks.append(1) or real(df))
    assert found(spark, rows) == expected(rows)
    assert len(walks) <= 8


def test_no_events(spark):
    assert unitruns.unit_runs(spark.createDataFrame([], EVENT)).count() == 0
    assert unitruns.unit_runs(spark.createDataFrame([("s", None, T, "a", 1, "start", None, None, "x")], EVENT)).count() == 0


def test_whole_units_are_walked_where_they_are_cut(spark, monkeypatch):
    """Their events are rows, not arrays of which a batch holds thousands."""
    rows = [("s", f"u{u:03}", T + timedelta(seconds=60 * n), "a", n, "finish" if n % 2 else "start", 0 if n % 2 else None, None, None) for u in range(300) for n in range(6)]
    tables, real = [], unitruns.written
    monkeypatch.setattr(unitruns, "written", lambda df: tables.append(real(df)) or tables[-1])
    assert found(spark, rows) == expected(rows)
    cut = tables[1]
    assert cut.count() == len(rows)
    # the first and the last unit of a task may go on in another
    assert cut.where("run is null").select("unit").distinct().count() <= 2 * cut.select("part").distinct().count() < 20
