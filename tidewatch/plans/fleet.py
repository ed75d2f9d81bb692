"""The scan of many hosts as one plan: everything is keyed by host, and results are tables.

Windows, warnings and exit codes are aggregates per host; nothing of a host comes to the driver.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions, schedule
from ..functions.tables import written
from ..operators import detect, runs as runs_
from ..sources import logs
from . import scan as one

JOB = "host string, id string, source string, schedules array<string>, user string, command string, unit string, tolerance double"
STATE = "host string, unit string, failed boolean, exited timestamp_ntz, exit_code int, result string, active string, props map<string,string>"


@dataclass
class Fleet:
    """findings (host, kind, severity, id, source, message, when, details), runs (host, id, start, end, ...), and hosts (host, window, counts, warnings, exit_code)."""

    findings: DataFrame
    runs: DataFrame
    hosts: DataFrame

    def write(self, path: str) -> None:
        """The tables as Parquet below path; findings by kind and day."""
        day = F.to_date("when").alias("day")
        self.findings.select("*", day).repartition("kind", "day").write.mode("overwrite").partitionBy("kind", "day").parquet(f"{path}/findings")
        self.runs.write.mode("overwrite").parquet(f"{path}/runs")
        self.hosts.write.mode("overwrite").parquet(f"{path}/hosts")


def scan(jobs: DataFrame, lines: DataFrame, now: str, states: DataFrame | None = None, descriptions: DataFrame | None = None, tolerance_s: float = 120.0, ignore=frozenset()) -> Fleet:
    """jobs as JOB, lines (host, source, lineno, block, value), states as STATE, descriptions (host, unit, description).

    A host's window is its log's; jobs with the same user and command of a host count as one, several
    timers of a unit each have its runs. Hosts are those of jobs and lines.
    """
    spark = lines.sparkSession
    src = lines.select(F.col("host").alias("scan"), F.concat_ws("/", "host", "source").alias("source"), "lineno", "block", "value")
    parsed = written(logs.parse(src, now).select("scan", "source", "lineno", "ts", "inferred", "ident", "pid", "msg"))
    log = parsed.groupBy(F.col("scan").alias("host")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("lines"), F.count("ts").alias("understood"))
    end = F.lit(now).cast("timestamp_ntz")
    hosts = log.join(jobs.groupBy("host").agg(F.count("*").alias("jobs"), F.count_if(F.col("source") == one.CRON).alias("entries")), "host", "full").select(
        "host", F.coalesce("first", F.timestamp_add("HOUR", F.lit(-24), end).cast("timestamp_ntz")).alias("start"), F.coalesce("last", end).alias("end"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "understood", "jobs", "entries")])
    hosts = written(hosts.withColumn("empty", F.timestamp_diff("MICROSECOND", "start", "end") < tolerance_s * 1_000_000))
    # a finding's host, id and source are read from its job_id, not joined to it
    dim = written(jobs.select(F.struct("host", "id", "source").alias("job_id"), *[c.split()[0] for c in JOB.split(", ")]).withColumnRenamed("host", "scan"))

    every = written(runs_.pair_lines(logs.cron_lines(parsed)).select("scan", "user", "command", "start", "end", "pid"))
    matched, _ = one.match(every, dim)
    none = lambda kind: F.lit(None).cast(kind)
    runs = matched.select("job_id", "start", "end", "pid", none("int").alias("exit_code"), none("string").alias("result"))
    titles = None if descriptions is None else descriptions.withColumnRenamed("host", "scan")
    units = dim.where(F.col("source") == one.SYSTEMD).select("job_id", "scan", "unit")
    of_units = runs_.unit_runs(logs.unit_events(parsed, titles)).join(units, ["scan", "unit"])
    runs = runs.unionByName(of_units.select("job_id", "start", "end", none("long").alias("pid"), "exit_code", "result"))
    window = dim.select("job_id", F.col("scan").alias("host"), "id", "source", "schedules", "tolerance").join(hosts.select("host", F.col("start").alias("from"), F.col("end").alias("to"), "empty"), "host")
    late = (F.col("tolerance") * 1_000_000).cast("long")
    near = runs.join(window.select("job_id", "host", "id", "from", "to", "tolerance", late.alias("late")), "job_id").where((F.timestamp_diff("MICROSECOND", "start", "from") <= F.col("late")) & (F.col("start") <= F.col("to")))
    runs = written(near.select("job_id", "host", "id", "start", "end", "pid", "exit_code", "result", "tolerance"))

    due = window.withColumn("deadline", F.expr("to - make_dt_interval(0, 0, 0, tolerance)")).select("job_id", "tolerance", F.col("source").alias("dialect"), "from", "deadline", F.size("schedules").alias("n"), F.posexplode("schedules").alias("nth", "expr"))
    named = dim.groupBy("job_id").agg((F.count("*") == 1).alias("once"))
    plans = written(expressions.plans(due).join(named, "job_id"))
    # a job with one schedule of occurrences far apart, and named once, meets its runs by days
    good = plans.where("error is null").withColumn("apart", F.col("once") & (F.col("n") == 1) & (schedule.gap() > 2 * F.col("tolerance")))
    lost = None
    if "missed" not in ignore:
        close = good.where("not coalesce(apart, false)").withColumn("job_id", F.struct("job_id", "tolerance"))
        occ = schedule.expand(close, F.col("from"), F.col("deadline")).select("job_id.*", "ts")
        reach = dim.select("job_id", "tolerance").distinct()
        theirs = runs.join(close.select("job_id.job_id").distinct(), "job_id", "left_semi")
        lost = written(detect.missed_planned(good.where("apart"), runs, F.col("from"), F.col("deadline")).unionByName(detect.missed_close(occ, theirs, F.col("tolerance")).join(reach, "job_id")))
    kinds = f"job_id {dim.schema['job_id'].dataType.simpleString()}, unit string, failed boolean, exited timestamp_ntz, exit_code int, result string, active string, props map<string,string>"
    st = spark.createDataFrame([], kinds)
    if states is not None:
        inside = states.withColumnRenamed("host", "scan").join(units, ["scan", "unit"]).join(hosts.select(F.col("host").alias("scan"), "start", "end"), "scan")
        st = inside.where("not failed or exited is null or exited between start and end").select(*[c.split()[0] for c in kinds.split(", ")])
    # texts are put together where they are read
    f = one.findings(dim.withColumn("origin", none("string")), None, runs.drop("host", "id", "tolerance"), st, ignore, lost, written)
    found = f.withColumn("host", F.col("job_id.host"))

    idle = dim.where(F.col("source") == one.CRON).select("job_id").join(runs.select("job_id"), "job_id", "left_anti").withColumn("idle", F.lit(True))
    n = found.groupBy("host", "job_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in one.KINDS], F.count("*").alias("all")).join(idle.distinct(), "job_id", "left").groupBy("host").agg(
        *[F.sum(k).alias(k) for k in one.KINDS], F.sum(F.when(F.col("idle").isNull(), F.col("all")).otherwise(0)).alias("standing"), F.sum(F.when(F.col("idle"), F.col("missed")).otherwise(0)).alias("invented"))
    attributed = matched.groupBy(F.col("scan").alias("host")).agg(F.count("*").alias("attributed"))
    wrong = parsed.select(F.col("scan").alias("host"), "source").distinct().join(logs.implausible(parsed).select("source"), "source", "left_semi").groupBy("host").agg(F.lit(True).alias("implausible"))
    # jobs that may be late for longer than the window, and schedules in zones of their own
    bad = plans.groupBy(F.col("job_id.host").alias("host")).agg(F.max(F.col("deadline") < F.col("from")).alias("slack"), F.max("zone").alias("zoned"))
    seen = runs.groupBy("host").agg(F.count("*").alias("runs"))
    h = hosts
    for t in (n, attributed, wrong, bad, seen):
        h = h.join(t, "host", "left")
    h = h.select("host", "start", "end", "lines", "understood", "jobs", "entries", "empty", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*one.KINDS, "runs", "standing", "invented", "attributed")], *[F.coalesce(c, F.lit(False)).alias(c) for c in ("implausible", "slack", "zoned")])
    nothing = (F.col("entries") > 0) & (F.col("understood") > 0) & (F.col("attributed") == 0) & (F.col("invented") > 0)
    warned = [("no-schedules", F.col("jobs") == 0), ("no-log-lines", F.col("understood") == 0), ("implausible-log-dates", F.col("implausible")),
              ("empty-window", F.col("empty") | F.col("slack")), (one.NO_RUNS_MATCHED, nothing), ("unsupported-timezone", F.col("zoned"))]
    h = h.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(w)) for w, c in warned])))
    code = F.when(F.col("empty"), 2).when(F.array_contains("warnings", one.NO_RUNS_MATCHED), F.when(F.col("standing") > 0, 1).otherwise(3)).otherwise(
        ((F.size("warnings") > 0) | (sum(F.col(k) for k in one.KINDS) > 0)).cast("int"))
    return Fleet(found.select("host", "kind", "severity", "id", "source", "message", "when", "details"), runs.drop("job_id", "tolerance"), h.withColumn("exit_code", code))
