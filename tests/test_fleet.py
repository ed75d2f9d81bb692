"""A fleet of hosts against each host's own scan."""
from datetime import datetime

from tidewatch.plans import fleet
from tidewatch.plans.scan import Options, scan
from tidewatch.sources import crontab, logs, units

NOW = datetime(2026, 5, 4, 12)


def text(host):
    """Each host runs its job a few times; host 1 logs nothing useful, host 2 runs another user's, host 3 a unit too."""
    out = []
    for h in range(11):
        if host == 1 or (h % 4 == host % 4):
            continue
        user = "eve" if host == 2 else "root"
        pid = 100 + h
        out += [f"May  4 {h:02d}:00:01 x CRON[{pid}]: pam_unix(cron:session): session opened for user {user}(uid=0)", f"May  4 {h:02d}:00:01 x CRON[{pid}]: ({user}) CMD (tidy  up)",
                f"May  4 {(h + 1 + (host == 0)) % 24:02d}:0{1 + host % 2}:30 x CRON[{pid}]: pam_unix(cron:session): session closed for user {user}"]
    if host == 3:
        out += ["2026-05-04T03:00:00+0200 x systemd[1]: Starting Push it...", "2026-05-04T03:01:00+0200 x systemd[1]: push.service: Main process exited, code=exited, status=4/X", "2026-05-04T03:01:00+0200 x systemd[1]: push.service: Failed with result 'exit-code'."]
    return out if host != 1 else ["nothing of note"]


SHOW = """Id=push.timer
Unit=push.service
TimersCalendar={ OnCalendar=*-*-* 03:00:00 ; next_elapse=x }
AccuracyUSec=1min

Id=push.service
Description=Push it
ActiveState=failed
Result=exit-code
ExecMainStatus=4
ExecMainExitTimestamp=Mon 2026-05-04 03:01:02 CEST
"""


def test_hosts_equal_their_own_scans(spark, tmp_path):
    want, codes, lines, jobs = [], {}, [], []
    for host in range(5):
        tab, log, show = (tmp_path / f"{n}{host}" for n in ("tab", "log", "show"))
        tab.write_text("0 * * * * root tidy up\n" if host != 4 else "# none\n")
        log.write_text("\n".join(text(host)) + "\n")
        show.write_text(SHOW)
        r = scan(spark, Options(crontabs=[str(tab)], crontab_format="system", logs=[str(log)], shows=[str(show)] * (host == 3), now=NOW))
        want += [(f"h{host}", f.kind, f.severity, f.id, f.when, f.message, f.details) for f in r.findings]
        codes[f"h{host}"] = (r.exit_code(), sorted({w.code for w in r.warnings}), len(r.jobs), sum(len(j.runs) for j in r.jobs))
        lines += [(f"h{host}", "log", (0, n), 0, x) for n, x in enumerate(text(host))]
        jobs += [(f"h{host}", j.id, j.source, j.schedules, j.user, j.command, j.unit, j.tolerance) for j in r.jobs]
    st = units.parse(crontab.read_text(spark, [str(tmp_path / "show3")]))
    states = units.state(st).selectExpr("'h3' as host", "unit", "failed", "exited", "exit_code", "result", "active", "props")
    got = fleet.scan(spark.createDataFrame(jobs, fleet.JOB), spark.createDataFrame(lines, "host string, source string, lineno struct<block:bigint,row:bigint>, block long, value string"),
                     str(NOW), states, units.descriptions(st).selectExpr("'h3' as host", "unit", "description"))
    assert sorted(((x.host, x.kind, x.severity, x.id, x.when, x.message, x.details) for x in got.findings.collect()), key=str) == sorted(want, key=str)
    assert {k for _, k, *_ in want} == {"missed", "overlap", "failure"}
    assert {x.host: (x.exit_code, sorted(set(x.warnings)), x.jobs, x.runs) for x in got.hosts.collect()} == codes
    got.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "findings")).count() == len(want)
    assert spark.read.parquet(str(tmp_path / "out" / "hosts")).count() == 5 and logs.PLAUSIBLE_DAYS
