"""Schedules meet runs by days: the same missed occurrences as the join of every occurrence."""
import random

from pyspark.sql import functions as F

from tidewatch.functions import expressions, schedule
from tidewatch.operators import detect


def test_days_tell_what_every_occurrence_tells(spark):
    rng = random.Random(4)
    jobs = spark.createDataFrame([(1, "*/7 * * * *", 30.5), (2, "0 * * * *", 900.0), (3, "59 23 * * *", 120.0)], "job_id int, expr string, tolerance double")
    plans = expressions.plans(jobs.withColumn("dialect", F.lit("cron")))
    runs = spark.createDataFrame([(j, rng.randrange(3 * 86_400_000_000)) for j in (1, 2, 3, 4) for _ in range(300)] + [(3, 86_400_000_000), (1, 420_000_000 + 30_500_000)], "job_id int, us long")
    runs = runs.select("job_id", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, us / 1000000.0)").alias("start")).join(jobs.select("job_id", "tolerance"), "job_id", "left")
    start, end = "2024-01-01 00:00:00", "2024-01-03 23:59:30"
    got = detect.missed_planned(plans, runs, start, end)
    occ = schedule.expand(plans, start, end).join(jobs.select("job_id", "tolerance"), "job_id")
    want = detect.missed_apart(occ, runs.drop("tolerance"), F.col("tolerance"))
    seen = sorted((r.job_id, r.ts) for r in got.collect())
    assert seen == sorted(map(tuple, want.collect())) and {j for j, _ in seen} >= {1, 2}
