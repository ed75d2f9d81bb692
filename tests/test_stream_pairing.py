"""Runs and overlaps of a stream equal those of a batch."""
import random
from datetime import datetime, timedelta

from tidewatch.operators import detect, runs, unitruns
from tidewatch.sources import logs
from tidewatch.streaming import pairing

T = datetime(2026, 2, 1)
LINE = "scan string, source string, src int, lineno long, value string"


def stream(spark, tmp_path, batches, kind):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03}"))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def collected(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    assert q.awaitTermination(300)
    return spark.table(name)


def test_runs_of_a_stream_equal_the_batch(spark, tmp_path):
    r, rows = random.Random(7), []
    for n in range(300):
        scan, pid, user, t = f"m{r.randrange(3)}", r.randrange(12), r.choice(["root", "bob"]), T + timedelta(seconds=r.randrange(2400))
        said = r.choice([f"pam_unix(cron:session): session opened for user {user}(uid=0)", f"pam_unix(cron:session): session closed for user {user}", f"({user}) CMD (c{n})", f"({user}) CMD (c{n})"])
        rows.append((t, (scan, "log", r.randrange(2), n, f"{t.isoformat()}+0000 h CRON[{pid}]: {said}")))
    rows.sort(key=lambda x: x[0] + timedelta(seconds=r.randrange(300)))  # out of order by less than the delay
    batches = [[x for _, x in rows[k : k + 75]] for k in range(0, 300, 75)]
    late = [(f"m{m}", "log", 0, 1000 + m, f"{(T + timedelta(hours=9)).isoformat()}+0000 h CRON[999]: (root) CMD (z)") for m in range(3)]
    got = collected(spark, pairing.runs(stream(spark, tmp_path, [*batches, late, late], LINE)), "paired", tmp_path)
    d = spark.createDataFrame([x for _, x in rows], LINE)
    want = {(x.scan, x.user, x.command): (x.start, x.end) for x in runs.pair_lines(logs.cron_lines(logs.parse(d, None))).collect()}
    told = {(x.scan, x.user, x.command): (x.start, x.end) for x in got.where("command <> 'z'").collect()}
    assert len(told) > 100 and all(want[k] == v for k, v in told.items())
    # what is not told is a run whose session has not ended
    assert all(want[k][1] is None for k in set(want) - set(told))


def test_the_hung_run_overlaps_three(spark, tmp_path):
    at = lambda h, m=0: T + timedelta(hours=h, minutes=m)
    ended = [(1, at(4), at(4, 5), 2), (1, at(5), at(5, 5), 3), (2, at(3), at(3, 5), 9), (1, at(6), at(6, 5), 4), (1, at(3), at(6, 30), 1), (2, at(3, 5), at(3, 6), 10)]
    kind = "job_id int, start timestamp_ntz, end timestamp_ntz, ord long"
    got = collected(spark, pairing.overlaps(stream(spark, tmp_path, [ended[:2], ended[2:4], ended[4:]], kind)), "overlapping", tmp_path)
    pairs = sorted((x.job_id, x.previous, x.started, x.overlap_s) for x in got.collect())
    assert pairs == [(1, at(3), at(h), 300) for h in (4, 5, 6)]
    assert pairs == sorted((x.job_id, x.p_start, x.c_start, x.overlap_s) for x in detect.overlaps(spark.createDataFrame(ended, kind)).collect())


def test_unit_runs_of_a_stream_equal_the_batch(spark, tmp_path):
    r, rows = random.Random(11), []
    kind = "scan string, unit string, ts timestamp_ntz, src int, source string, lineno long, kind string, exit_code int, result string"
    for n in range(400):
        t, said = T + timedelta(seconds=r.randrange(1500)), r.choice(["start", "start", "started", "finish", "fail", "fail"])
        code, result = (r.choice([None, None, 0, 1]), r.choice([None, None, "success", "exit-code"])) if said in ("finish", "fail") else (None, None)
        rows.append((f"m{r.randrange(2)}", r.choice(["a.service", "b.service", "c.service", None]), t, r.randrange(2), "log", n, said, code, result))
    rows.sort(key=lambda x: x[2] + timedelta(seconds=r.randrange(300)))  # out of order by less than the delay
    late = [("m0", "z.service", T + timedelta(hours=9 + h), 0, "log", 1000 + h, "start", None, None) for h in range(3)]
    batches = [rows[k : k + 100] for k in range(0, 400, 100)] + [[x] for x in late]
    plain = lambda d: sorted(((x.scan, x.unit, x.start, x.end, x.exit_code, x.result) for x in d.collect()), key=str)
    got = plain(collected(spark, pairing.unit_runs(stream(spark, tmp_path, batches, kind)), "of_units", tmp_path))
    want = plain(unitruns.unit_runs(spark.createDataFrame(rows, kind)).where("end is not null"))
    assert len(want) > 100 and len({x[5] for x in want}) == 3 and got == want
