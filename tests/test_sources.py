from tidewatch.sources import crontab, units


def rows(spark, text):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(text, 1)], "source string, lineno long, value string")


def test_system_crontab(spark):
    text = ["# note", "", "SHELL=/bin/sh", "CRON_TZ = UTC", "*/5 *  * * *\troot  run  it # now", "@Daily bob tidy up", "@never bob x", "1 2 3 4 5 bob", None]
    got = {r.lineno: r for r in crontab.parse(rows(spark, text), True).collect()}
    assert sorted(got) == [4, 5, 6, 7, 8] and all(got[i].problem for i in (4, 7, 8))
    assert got[5][2:5] == ("*/5 * * * *", "root", "run it # now") and got[6][2:5] == ("@daily", "bob", "tidy up")


def test_user_crontab_and_merge(spark, tmp_path):
    (tmp_path / "eve").write_text("0 1 * * * a b\n30 1 * * * a b\n@reboot c\n")
    jobs = crontab.parse(crontab.read_text(spark, [str(tmp_path / "eve")]), False, "eve")
    got = {r.command: (r.user, r.schedules, [o.lineno for o in r.origins]) for r in crontab.merge(jobs).collect()}
    assert got == {"a b": ("eve", ["0 1 * * *", "30 1 * * *"], [1, 2]), "c": ("eve", ["@reboot"], [3])}


def test_unit_blocks(spark):
    text = ["Id=a.service", "Result=x=y", "noise", "Result=success", "ExecMainStatus=1", "", "Id=b.service", "ActiveState=failed", "Id=c.timer", "ExecMainStatus=2", "", "Result=exit-code"]
    got = units.parse(rows(spark, text))
    assert {r.unit: (r.f, r.props.get("Result")) for r in got.withColumn("f", units.failed(got["props"])).collect()} == {
        "a.service": (False, "success"), "b.service": (True, None), "c.timer": (True, None)}
