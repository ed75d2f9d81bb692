from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import cron, expressions, schedule
from tidewatch.operators import detect

RUNS = "job_id int, start timestamp_ntz, end timestamp_ntz, ord long"


def at(h, m=0, s=0):
    return datetime(2024, 1, 1, h, m, s)


def test_overlap_is_strict_and_reports_every_pair(spark):
    rows = [(1, at(1), at(4), 0), (1, at(2), at(3), 1), (1, at(3), None, 2), (1, at(4), at(5), 3)]
    got = {(r.p_ord, r.c_ord, r.overlap_s) for r in detect.overlaps(spark.createDataFrame(rows, RUNS)).collect()}
    assert got == {(0, 1, 3600), (0, 2, 3600)}


def test_missed_is_greedy_and_one_to_one(spark):
    occ = spark.createDataFrame([(1, at(3)), (1, at(3, 1)), (1, at(9))], "job_id int, ts timestamp_ntz")
    runs = spark.createDataFrame([(1, at(3, 0, 30), None, 0)], RUNS)
    assert {r.ts for r in detect.missed(occ, runs, 60).collect()} == {at(3, 1), at(9)}


@pytest.mark.parametrize("bad", ["* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *", "@reboot"])
def test_bad_expressions(bad):
    with pytest.raises(ValueError):
        cron.parse(bad)


def test_fields():
    assert cron.parse("10/20 0 * jan,mar 5-7") == ([10, 30, 50], [0], list(range(1, 32)), [1, 3], [0, 5, 6], True, False)


def test_names_of_users_and_files():
    from tidewatch.sources.crontab import _is_name, _left_over

    assert [w for w in ("bob", "_x-1", "a.b", "www-data$", "Bob", "1a", "$", "", "a$b", "é") if _is_name(w, True)] == ["bob", "_x-1", "a.b", "www-data$"]
    assert not _is_name("a.b", False) and _is_name("a-b", False)
    assert [f for f in ("x", "x.dpkg-old", "x.rpmnew", "x~", "x.bak", "x.swp", "dpkg", "x.dpkg-old.y", "rpm.x") if _left_over(f)] == ["x.dpkg-old", "x.rpmnew", "x~", "x.bak", "x.swp"]


def test_few_schedules_are_expanded_by_many_tasks(spark):
    """A small table of schedules is multiplied in all tasks, with or without equal times."""
    plan = dict(zip(expressions.FIELDS, cron.common("0 */2 * * *")))
    kind = dict(c.split() for c in schedule.SCHEMA.split(", "))
    jobs = spark.range(0, 40, 1, 1).select(F.col("id").alias("job_id"), *[F.lit(v).cast(kind[k]).alias(k) for k, v in plan.items()])
    window = "2024-01-01 00:00:00", "2024-01-10 12:00:00"
    for twice, single in ((jobs, True), (jobs.unionByName(jobs), False)):
        out = schedule.expand(twice, *window, single=single)
        rows = [(r.job_id, r.ts) for r in out.collect()]
        assert len(rows) == len(set(rows)) == 40 * (9 * 12 + 7) and max(r[1] for r in rows) == datetime(2024, 1, 10, 12)
        assert len({r[0] for r in out.select(F.spark_partition_id()).distinct().collect()}) == 4


def test_reach_gives_the_same_missed(spark):
    occ = spark.sql("select id as job_id, timestamp_ntz '2024-01-01' + t * interval '1' hour as ts, 60D + id as tol, true as apart from range(5) lateral view explode(sequence(0, 30)) as t")
    runs = spark.sql("select id as job_id, timestamp_ntz '2024-01-01' + t * interval '57' minute as start from range(5) lateral view explode(sequence(0, 30)) as t")
    reach = spark.sql("select id as job_id, 60D + id as tolerance from range(5)")
    want = sorted(map(tuple, detect.missed(occ, runs, F.col("tol")).collect()))
    assert want and want == sorted(map(tuple, detect.missed(occ, runs, F.col("tol"), reach).collect()))
