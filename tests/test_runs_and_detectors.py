"""Runs from events, and detectors against plain loops over lists."""
import random
from datetime import datetime, timedelta

import pytest

from tidewatch.functions import calendar, cron, text
from tidewatch.operators import detect, runs

T = datetime(2026, 3, 1)
EVENT = "unit string, ts timestamp_ntz, lineno long, kind string, exit_code int, result string"


def at(s):
    return T + timedelta(seconds=s)


#: events (kind, second, exit code, result) of a unit, and its runs (start, end, exit code, result)
UNITS = {
    "plain": ([("start", 0, None, None), ("finish", 9, 0, "success")], [(0, 9, 0, "success")]),
    "three lines of one failure": ([("start", 0, None, None), ("fail", 7, 2, None), ("fail", 8, None, "exit-code"), ("fail", 9, None, "failed-to-start")], [(0, 9, 2, "exit-code")]),
    "started confirms": ([("start", 0, None, None), ("started", 3, None, None), ("finish", 20, 0, "success")], [(0, 20, 0, "success")]),
    "started alone opens": ([("started", 0, None, None), ("finish", 20, 0, "success"), ("started", 50, None, None)], [(0, 20, 0, "success"), (50, None, None, None)]),
    "started after the end opens": ([("start", 0, None, None), ("fail", 4, 1, "exit-code"), ("started", 70, None, None)], [(0, 4, 1, "exit-code"), (70, None, None, None)]),
    "oldest ends first": ([("start", 0, None, None), ("start", 30, None, None), ("finish", 50, 0, "success"), ("finish", 90, 0, "success")], [(0, 50, 0, "success"), (30, 90, 0, "success")]),
    "no start": ([("fail", 5, 3, None)], [(5, 5, 3, None)]),
    "a finish tells nothing new of the run that is open": ([("start", 0, None, None), ("start", 1, None, None), ("finish", 10, 0, "success"), ("finish", 10, None, None), ("finish", 40, 0, "success")], [(0, 10, 0, "success"), (1, 40, 0, "success")]),
    "a signal": ([("start", 0, None, None), ("fail", 6, None, "killed/9"), ("fail", 6, None, "signal")], [(0, 6, None, "killed/9")]),
    "finish implies success": ([("start", 0, None, None), ("finish", 6, None, None)], [(0, 6, None, "success")]),
    "late detail is another run": ([("start", 0, None, None), ("finish", 6, 0, "success"), ("fail", 12, None, "timeout")], [(0, 6, 0, "success"), (12, 12, None, "timeout")]),
}


def test_unit_runs(spark):
    rows = [(u, at(s), n, k, c, r) for u, (ev, _) in UNITS.items() for n, (k, s, c, r) in enumerate(ev)]
    got = {}
    for r in runs.unit_runs(spark.createDataFrame(rows, EVENT)).orderBy("start").collect():
        got.setdefault(r.unit, []).append((r.start, r.end, r.exit_code, r.result))
    assert got == {u: [(at(a), at(b) if b is not None else None, c, r) for a, b, c, r in want] for u, (_, want) in UNITS.items()}


def test_sessions_across_files_and_by_preference(spark):
    c = [("a", 2, at(1), 11, "root", "first"), ("a", 3, at(2), 12, "root", "second"), ("a", 4, at(3), 31, "root", "own pid, another user's"), ("a", 9, at(99), 40, "root", "too late for any")]
    s = [("a", 0, at(0), 21, "opened", "root"), ("a", 1, at(1), 22, "opened", "root"), ("b", 0, at(1), 31, "opened", "bob"), ("b", 1, at(60), 21, "closed", "root"), ("b", 2, at(61), 22, "closed", "root"),
         ("b", 3, at(62), 31, "closed", "bob"), ("b", 4, at(90), 50, "opened", "root"), ("b", 5, at(91), 50, "opened", "root"), ("b", 6, at(120), 50, "closed", "root")]
    cs = spark.createDataFrame(c, "source string, lineno long, ts timestamp_ntz, pid long, user string, command string")
    ss = spark.createDataFrame(s, "source string, lineno long, ts timestamp_ntz, pid long, action string, user string")
    got = {r.command: r.end for r in runs.pair_sessions(cs, ss).collect()}
    # the newest session of the user serves the first command
    assert got == {"first": at(61), "second": at(60), "own pid, another user's": at(62), "too late for any": None}


def test_missed_and_overlaps_equal_loops_over_lists(spark, monkeypatch):
    monkeypatch.setattr(detect, "SMALL", 12)
    r, occ, run = random.Random(3), [], []
    for job in range(60):
        occ += {(job, at(r.randrange(0, 2000, 10))) for _ in range(r.randrange(9))}
        run += [(job, at(s), r.choice([None, at(s + r.randrange(400))]), n) for n, s in enumerate(r.choices(range(2000), k=r.randrange(9)))]
    want = []
    for job in range(60):
        free = sorted(s for j, s, _, _ in run if j == job)
        for t in sorted(t for j, t in occ if j == job):
            near = sorted((abs(s - t), s) for s in free if abs(s - t) <= timedelta(seconds=90))
            free.remove(near[0][1]) if near else want.append((job, t))
    d = spark.createDataFrame(run, "job_id int, start timestamp_ntz, end timestamp_ntz, ord long")
    got = detect.missed(spark.createDataFrame(occ, "job_id int, ts timestamp_ntz"), d, 90)
    assert sorted((x.job_id, x.ts) for x in got.collect()) == sorted(want)
    pairs = sorted((j, a, b) for j, s, e, a in run for k, t, f, b in run if j == k and e and e > t and (s, e, a) < (t, f or t, b))
    monkeypatch.setattr(detect, "BUCKET_S", 100)
    assert sorted((x.job_id, x.p_ord, x.c_ord) for x in detect.overlaps(d).collect()) == pairs and len(pairs) > 50


@pytest.mark.parametrize("bad", ["", "noon", "*-*-* 24:00", "*-13-*", "*-*-~1", "Mon..Foo 1:00", "*-*-* *:*:*", "1:2:3:4", "*-*-5..2", "*:0/0", "1:00 *-*-*", "Mon Tue 1:00"])
def test_bad_calendars(bad):
    with pytest.raises(ValueError):
        calendar.parse(bad)


def test_zones_are_refused_by_name():
    for zone in ("UTC", "Europe/Paris"):
        with pytest.raises(calendar.ZoneError):
            calendar.parse("*-*-* 04:00 " + zone)


@pytest.mark.parametrize("bad", ["+5 * * * *", "1_0 * * * *", "1- * * * *", ", * * * *", "* * * * fri-sun", "* * 0 * *", "x * * * *"])
def test_strict_cron_fields(bad):
    with pytest.raises(ValueError):
        cron.parse(bad)


def test_minutely_over_years_is_refused(spark):
    rows = spark.createDataFrame([(1, *cron.parse("* * * * *"))], "job_id int, " + cron.SCHEMA)
    assert cron.occurrences(rows, "2015-01-01 00:00:00", "2025-01-01 00:00:00").count() == 0
    assert cron.occurrences(rows, "2025-01-01 00:00:00", "2025-01-30 23:59:00").count() == 43_200
    assert cron.occurrences(rows, "2025-01-02 00:00:00", "2025-01-01 00:00:00").count() == 0


def test_times_and_markup():
    now = datetime(2026, 3, 2, 12)
    assert text.when("now", now) == now and text.when("1d 2h", now) == datetime(2026, 3, 1, 10) and text.when("2026-01-01T05:00:00+02:00", now) == datetime(2026, 1, 1, 5)
    for bad in ("", "soon", "0h", "5", "3m 2h"):
        with pytest.raises(ValueError):
            text.when(bad, now)
    assert text.code("a") == "`a`" and text.code("echo `x`") == "`` echo `x` ``" and text.code("a``b") == "```a``b```" and text.code("") == ""
    assert text.cell("a|b\nc") == "a\\|b c"


def test_occurrences_apart_equal_the_greedy_choice(spark):
    r, occ, run = random.Random(8), [], []
    for job in range(40):
        occ += {(job, at(s), 90.0 + job % 3) for s in range(r.randrange(400), 40_000, 200 + r.randrange(9)) if r.random() < 0.8}
        run += [(job, at(s)) for s in r.choices(range(40_000), k=r.randrange(150))]
    o = spark.createDataFrame(occ, "job_id int, ts timestamp_ntz, tol double")
    d = spark.createDataFrame(run, "job_id int, start timestamp_ntz")
    from pyspark.sql import functions as F

    want = sorted(map(tuple, detect.missed_close(o, d, F.col("tol")).collect()))
    apart = detect.missed(o.withColumn("apart", F.lit(True)), d, F.col("tol"))
    assert sorted(map(tuple, apart.collect())) == want and len(want) > 500
    assert sorted(map(tuple, detect.missed(o.withColumn("apart", F.expr("job_id % 2 = 0")), d, F.col("tol")).collect())) == want
    assert "Window" not in detect.missed_apart(o, d, F.col("tol"))._jdf.queryExecution().executedPlan().toString()


def test_gaps_of_schedules(spark):
    from tidewatch.functions import expressions, schedule

    texts = {"0 3 * * *": 86400, "*/15 * * * *": 900, "5,50 1 * * *": 900, "0 1,23 * * *": 7200, "0 0,6 * * *": 21600, "* * * * *": 60}
    d = expressions.plans(spark.createDataFrame([("cron", t) for t in texts] + [("systemd", "*:*:50,10")], "dialect string, expr string"))
    assert {x.expr: x.gap for x in d.withColumn("gap", schedule.gap()).collect()} == texts | {"*:*:50,10": 20}
