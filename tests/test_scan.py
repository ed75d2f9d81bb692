"""Whole scans of made captures: findings, warnings, exit codes, reports, the command line and the live sources."""
import json
from datetime import datetime

import pytest

from tidewatch import cli
from tidewatch.plans import report
from tidewatch.plans.scan import Options, scan
from tidewatch.sources import crontab, live

NOW = datetime(2026, 5, 4, 12)
TAB = "# jobs\nMAILTO=x\n0 * * * * root /opt/sync  -a\n30 2 * * * root /opt/nightly | tee `date`\n0 */2 * * * root /opt/sync -a\nCRON_TZ=UTC\nbroken\n"
SHOW = """Id=push.timer
Unit=push.service
AccuracyUSec=1min
TimersCalendar={ OnCalendar=*-*-* *:00:00 ; next_elapse=x }

Id=push.service
Description=Push things
ActiveState=failed
Result=exit-code
ExecMainStatus=1
ExecMainExitTimestamp=Mon 2026-05-04 03:00:31 CEST

Id=boot.timer
Id=zoned.timer
TimersCalendar={ OnCalendar=*-*-* 04:00:00 UTC ; next_elapse=x }
"""


def cron_log(hours, user="root", command="/opt/sync -a", last=20):
    out = []
    for k, h in enumerate(hours):
        out += [f"May  4 0{h}:00:00 box CRON[{k}0]: pam_unix(cron:session): session opened for user {user}(uid=0)", f"May  4 0{h}:00:01 box CRON[{k}1]: ({user}) CMD ({command})"]
        out += [f"May  4 0{h if k else h + 1}:00:{last} box CRON[{k}0]: pam_unix(cron:session): session closed for user {user}"]
    return "\n".join(sorted(out)) + "\n"


JOURNAL = """2026-05-04T01:00:00+0200 box systemd[1]: Starting Push things...
2026-05-04T01:00:09+0200 box systemd[1]: push.service: Deactivated successfully.
2026-05-04T03:00:00+0200 box systemd[1]: Starting push.service - Push things...
2026-05-04T03:00:30+0200 box systemd[1]: push.service: Main process exited, code=exited, status=1/FAILURE
2026-05-04T03:00:30+0200 box systemd[1]: push.service: Failed with result 'exit-code'.
2026-05-04T03:00:31+0200 box systemd[1]: Failed to start push.service - Push things.
2026-05-04T03:30:00+0200 box systemd[1]: Started Some other thing.
"""


@pytest.fixture
def files(tmp_path):
    for name, body in {"capture.tab": TAB, "show.txt": SHOW, "syslog": cron_log([1, 2, 4]), "journal": JOURNAL}.items():
        (tmp_path / name).write_text(body)
    return lambda *names: [str(tmp_path / n) for n in names]


def test_findings_of_all_kinds(spark, files, tmp_path):
    r = scan(spark, Options(files("capture.tab"), files("show.txt"), files("syslog", "journal"), since=datetime(2026, 5, 4), until=datetime(2026, 5, 4, 5), now=NOW))
    assert r.counts == {"missed": 4, "overlap": 1, "failure": 1} and (r.lines, r.understood) == (16, 16)
    by = {j.id: j for j in r.jobs}
    sync = by["cron:root:/opt/sync -a"]
    assert sync.schedules == ["0 * * * *", "0 */2 * * *"] and len(sync.origins) == 2
    assert [f.when.hour for f in sync.findings if f.kind == "missed"] == [3]
    assert sorted(f.kind for f in by["systemd:push.timer"].findings) == ["failure", "missed", "missed"]
    # the first run ends an hour late and covers the second one
    assert json.loads(next(f for f in r.findings if f.kind == "overlap").details)["overlap_seconds"] == 19.0
    failure = next(f for f in r.findings if f.kind == "failure")
    assert json.loads(failure.details)["exit_code"] == 1 and failure.when == datetime(2026, 5, 4, 3, 0, 31)
    assert {w.code for w in r.warnings} == {"unsupported-timezone"} and r.exit_code() == 1 and r.exit_code(True) == 0
    said = " ".join(d.message for d in r.diagnostics)
    for part in ("CRON_TZ= is not applied", "expected 7 fields", "Some other thing", "boot.timer", "window clamped"):
        assert part in said
    d = json.loads(report.to_json(r))
    assert list(d) == ["tool", "version", "generated_at", "window", "summary", "sources", "jobs", "findings", "warnings", "diagnostics"]
    assert d["summary"]["problems"] == 6 and d["findings"] == sorted(d["findings"], key=lambda f: (f["when"], f["kind"], f["job_id"]))
    md = report.to_markdown(r)
    assert "## Failures (1)" in md and "## Missed runs (4)" in md and "``cron:root:/opt/nightly \\| tee `date` ``" in md.replace("`` cron", "``cron") and "(?)" in md


def test_the_wrong_owner_is_said_and_exits_3(spark, files, tmp_path):
    (tmp_path / "u.tab").write_text("0 * * * * /opt/sync -a\n")
    opt = Options(files("u.tab"), [], files("syslog"), crontab_user="bob", now=NOW)
    r = scan(spark, opt)
    assert [w.code for w in r.warnings] == ["no-runs-matched"] and r.exit_code() == 3 and r.exit_code(True) == 3 and r.standing == []
    r = scan(spark, Options(files("u.tab"), [], files("syslog"), crontab_user="bob", ignore=frozenset({"missed"}), now=NOW))
    assert r.warnings == [] and r.exit_code() == 0 and any("no missed run was reported" in d.message for d in r.diagnostics)


def test_nothing_to_look_at_and_a_window_below_the_tolerance(spark, files, tmp_path):
    (tmp_path / "access.log").write_text("1.2.3.4 - - GET /\n\n")
    r = scan(spark, Options([], [], files("access.log", "gone.log"), now=NOW))
    assert {w.code for w in r.warnings} == {"no-schedules", "no-log-lines"} and r.lines == 2 and any("cannot read log file" in d.message for d in r.diagnostics)
    r = scan(spark, Options(files("capture.tab"), [], files("syslog"), tolerance=1e6, now=NOW))
    assert any(w.code == "empty-window" and w.usage_error for w in r.warnings) and r.exit_code(True) == 2


def test_formats_are_voted_for(spark, tmp_path):
    def load(body, name="web.tab", **k):
        (tmp_path / name).write_text(body)
        return crontab.load(spark, str(tmp_path / name), **k)

    assert load("0 1 * * * root /bin/a\n0 2 * * * tidy /x\n").system
    assert not load("0 1 * * * backup.sh /data\n@daily /bin/b\n").system
    twice = "0 1 * * * deploy /bin/a\n0 2 * * * deploy /bin/b\n"
    assert load(twice).system and load(twice).guessed
    f = load(twice, user="eve")
    assert f.overruled and not f.system and f.entries.first().user == "eve" and any("would otherwise" in p for p in f.problems)
    assert load("0 1 * * * x\n", "alice").entries.first().user == "alice" and load("0 1 * * * x\n", "crontab").entries.first().user == "root"
    assert any("attributed to 'root'" in p for p in load("0 1 * * * x\n", "web01.crontab").problems)
    assert load("1 2 3\n", as_format="system").problems and crontab.load(spark, str(tmp_path / "none")).problems[0].endswith("cannot read (No such file or directory)")


def test_discovery_and_live_sources(spark, tmp_path):
    for path, body in {"etc/crontab": "0 1 * * * root /bin/a\n", "etc/cron.d/web": "0 2 * * * www /bin/b\n", "etc/cron.d/web.dpkg-old": "x", "var/spool/cron/eve": "0 3 * * * /bin/c\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)

    def host(argv, timeout):
        if argv[:2] == ["systemctl", "list-units"]:
            return ["push.timer loaded active"]
        if argv[:2] == ["systemctl", "show"]:
            return SHOW.splitlines()
        if "-u" in argv:
            raise live.Silent("no access")
        return cron_log([1]).replace("/opt/sync -a", "/bin/c").replace("root", "eve").splitlines()

    r = scan(spark, Options(discover=True, journal=True, now=NOW, root=str(tmp_path), ask=host))
    assert [(j.source, j.user, j.command, j.timer) for j in r.jobs][:3] == [("cron", "root", "/bin/a", None), ("cron", "www", "/bin/b", None), ("cron", "eve", "/bin/c", None)]
    assert {j.timer for j in r.jobs[3:]} == {"push.timer", "zoned.timer"} and r.end == NOW and [len(j.runs) for j in r.jobs[:3]] == [0, 0, 1]
    assert any("no access" in d.message for d in r.diagnostics) and r.sources["systemctl_show"] == ["systemctl show (live)"]


def test_command_line(spark, files, tmp_path, capsys):
    out = tmp_path / "report.json"
    args = ["scan", "--crontab", *files("capture.tab"), "--log-file", *files("syslog"), "--now", "2026-05-04T12:00:00", "--since", "11h", "--format", "json"]
    assert cli.main([*args, "--output", str(out), "--ignore", "overlap"], spark) == 1
    assert json.loads(out.read_text())["summary"]["overlap"] == 0
    assert cli.main(["scan", "--crontab", str(tmp_path / "none")], spark) == 2
    for bad in (["--tolerance", "-1"], ["--since", "whenever"]):
        with pytest.raises(SystemExit) as e:
            cli.main(["scan", *bad], spark)
        assert e.value.code == 2
    opt = cli.options(cli.parser().parse_args(["scan"]), NOW)
    assert opt.discover and opt.journal and not cli.options(cli.parser().parse_args(["scan", "--log-file", "x"]), NOW).journal
