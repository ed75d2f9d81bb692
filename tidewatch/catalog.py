"""Queries over the driver's tables, each with the SQL it must agree with.

The `events` table stands for runs: user_id is the job, ts the start, and int(value) minutes the length.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from .functions import cron, expressions, schedule
from .functions.columns import once
from .functions.text import duration
from .operators import detect, runs as runs_
from .plans import fleet, scan, surrogate
from .sources import crontab, logs, units

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


_RUNS = """WITH runs AS (SELECT user_id AS job, date_trunc('second', ts) AS s,
 date_trunc('second', ts) + to_minutes(CAST(floor(value) AS BIGINT)) AS e, event_id AS ord FROM events)"""


@query("overlap_pairs", _RUNS + """
SELECT p.job AS job, p.ord AS first_run, c.ord AS second_run,
 CAST(epoch(LEAST(p.e, c.e)) - epoch(c.s) AS BIGINT) AS overlap_s
FROM runs p JOIN runs c ON p.job = c.job AND p.e > c.s AND (p.s, p.e, p.ord) < (c.s, c.e, c.ord)""")
def overlap_pairs(spark, sf_dir):
    return detect.overlaps(surrogate.runs(spark, sf_dir)).select(
        F.col("job_id").alias("job"), F.col("p_ord").alias("first_run"), F.col("c_ord").alias("second_run"), "overlap_s")


@query("run_totals", _RUNS + """
SELECT job, count(*) AS observed, min(s) AS first_start, max(e) AS last_end,
 CAST(max(epoch(e) - epoch(s)) AS BIGINT) AS longest_s FROM runs GROUP BY job""")
def run_totals(spark, sf_dir):
    return surrogate.runs(spark, sf_dir).groupBy(F.col("job_id").alias("job")).agg(
        F.count("*").alias("observed"), F.min("start").alias("first_start"), F.max("end").alias("last_end"),
        F.max(F.timestamp_diff("SECOND", "start", "end")).alias("longest_s"))


_CRON_DUE = """WITH j AS (SELECT DISTINCT user_id AS job FROM events),
 t AS (SELECT job, CAST(d + to_hours(h) + to_minutes(job % 60) AS TIMESTAMP) AS due, d, h FROM j, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) s(d), range(24) r(h)),
 m AS (SELECT *, CASE job % 4 WHEN 0 THEN true WHEN 1 THEN day(d) <= 15 WHEN 2 THEN (day(d) - 1) % 3 = 0 ELSE day(d) IN (13, 20) END AS dom,
  CASE job % 3 WHEN 0 THEN true WHEN 1 THEN dayofweek(d) BETWEEN 1 AND 5 ELSE dayofweek(d) = 0 END AS dow FROM t WHERE h % (2 + job % 5) = 0)
SELECT job, due FROM m WHERE CASE WHEN job % 2 = 0 OR job % 3 = 0 THEN dom AND dow ELSE dom OR dow END AND due <= TIMESTAMP '2024-01-31'"""


def _cron_jobs(spark, sf_dir):
    """(job_id, dialect, expr): a cron expression for every user of the events."""
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id")).distinct()
    return u.select("job_id", F.lit("cron").alias("dialect"), F.expr("""concat(job_id % 60, ' */', 2 + job_id % 5, ' ', element_at(array('*', '1-15', '*/3', '13,20'), cast(job_id % 4 as int) + 1), ' * ',
        element_at(array('*', 'mon-fri', '7'), cast(job_id % 3 as int) + 1))""").alias("expr"))


@query("cron_occurrences", _CRON_DUE)
def cron_occurrences(spark, sf_dir):
    plans = expressions.plans(_cron_jobs(spark, sf_dir)).where("error is null")
    return schedule.expand(plans, "2024-01-01 00:00:00", "2024-01-31 00:00:00").select(F.col("job_id").alias("job"), F.col("ts").alias("due"))


@query("occurrences_by_sql", _CRON_DUE)
def occurrences_by_sql(spark, sf_dir):
    """The same through the table function, in a lateral join."""
    expressions.register(spark)
    return spark.sql("""SELECT j.job_id AS job, o.ts AS due FROM {jobs} j, LATERAL expand_schedule(j.dialect, j.expr, timestamp_ntz '2024-01-01 00:00:00', timestamp_ntz '2024-01-31 00:00:00') o
        WHERE o.problem IS NULL""", jobs=_cron_jobs(spark, sf_dir))


@query("schedule_fields", """
SELECT event_id, array_to_string(range(CAST(event_id % 30 AS BIGINT), CAST(event_id % 30 + event_id % 29 + 1 AS BIGINT), CAST(1 + event_id % 7 AS BIGINT)), ' ') AS minutes,
 CASE event_id % 3 WHEN 0 THEN array_to_string(range(CAST(event_id % 24 AS BIGINT), 24, 5), ' ') WHEN 1 THEN '0 6 12 18' ELSE '3 ' || 4 + event_id % 20 END AS hours,
 CASE event_id % 2 WHEN 0 THEN '2 3 5 12' ELSE '1 2 3 4 5 6 7 8 9 10 11 12' END AS months, CASE event_id % 4 WHEN 0 THEN '0 5 6' WHEN 1 THEN '0 1' ELSE '0 2 4 6' END AS dows FROM events""")
def schedule_fields(spark, sf_dir):
    """Ranges, steps, lists, names and Sunday as 7."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit("cron").alias("dialect"), F.expr("""concat(event_id % 30, '-', event_id % 30 + event_id % 29, '/', 1 + event_id % 7, ' ',
        case event_id % 3 when 0 then concat(event_id % 24, '/5') when 1 then '*/6' else concat(4 + event_id % 20, ',3') end, ' * ', if(event_id % 2 = 0, 'feb,MAR,5,12', '*'), ' ',
        case event_id % 4 when 0 then '5-7' when 1 then '7,1' else '*/2' end)""").alias("expr"))
    p = expressions.plans(e)
    return p.select("event_id", *[F.array_join(c, " ").alias(c) for c in ("minutes", "hours", "months", "dows")])


@query("missed_hours", """
WITH b AS (SELECT min(date_trunc('hour', ts)) AS lo, max(date_trunc('hour', ts)) AS hi FROM events),
o AS (SELECT DISTINCT user_id AS job, t FROM events, b, generate_series(b.lo, b.hi, INTERVAL 1 HOUR) s(t))
SELECT job, CAST(t AS TIMESTAMP) AS due FROM o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.job
 AND date_trunc('second', e.ts) BETWEEN o.t - INTERVAL 120 SECOND AND o.t + INTERVAL 120 SECOND)""")
def missed_hours(spark, sf_dir):
    r = surrogate.runs(spark, sf_dir)
    lo, hi = r.agg(F.date_trunc("hour", F.min("start")).cast("timestamp_ntz"), F.date_trunc("hour", F.max("start")).cast("timestamp_ntz")).first()
    # every job has the schedule, so each is expanded by itself and nothing is crossed
    plan = dict(zip([c.split()[0] for c in schedule.SCHEMA.split(", ")], cron.common("@hourly")))
    kind = {c.split()[0]: c.split()[1] for c in schedule.SCHEMA.split(", ")}
    jobs = r.select("job_id").distinct().select("job_id", *[F.lit(v).cast(kind[k]).alias(k) for k, v in plan.items()])
    jobs = once(jobs.withColumn("job_id", F.struct("job_id", (schedule.gap() > 240).alias("apart"))))  # not worked out for every run
    due = schedule.expand(jobs, str(lo), str(hi), single=True).select("job_id.*", "ts")
    return detect.missed(due, r, 120).select(F.col("job_id").alias("job"), F.col("ts").alias("due"))


def _as_log(spark, sf_dir, stamp: str):
    """The events as cron's log lines, one source per event type, in time order."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.date_format("ts", stamp), F.lit(" host CRON["), F.col("event_id"), F.lit("]: (u"), F.col("user_id"), F.lit(") CMD (run "), F.col("event_type"), F.lit(")"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    # a block is what a byte range of a file would be
    return ev.select(F.col("event_type").alias("source"), us.alias("lineno"), F.floor(us / 86_400_000_000).alias("block"), line.alias("value"))


_COMMANDS = """SELECT 'u' || user_id AS "user", 'run ' || event_type AS command, date_trunc('second', ts) AS start FROM events"""


@query("log_cron_iso", _COMMANDS)
def log_cron_iso(spark, sf_dir):
    lines = _as_log(spark, sf_dir, "yyyy-MM-dd'T'HH:mm:ss")
    return logs.cron_commands(logs.parse(lines, "2024-12-31 00:00:00")).select("user", "command", F.col("ts").alias("start"))


@query("log_cron_yearless", _COMMANDS)
def log_cron_yearless(spark, sf_dir):
    lines = _as_log(spark, sf_dir, "MMM d HH:mm:ss")
    return logs.cron_commands(logs.parse(lines, "2024-12-31 00:00:00")).select("user", "command", F.col("ts").alias("start"))


@query("calendar_occurrences", """
WITH j AS (SELECT s_suppkey AS job, s_suppkey % 24 AS h, s_suppkey % 60 AS m, s_suppkey % 6 AS k FROM supplier),
 d AS (SELECT CAST(d AS TIMESTAMP) AS d FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY) s(d)),
 t AS (SELECT job, k, d, d + to_hours(h) + to_minutes(m) AS due FROM j, d WHERE k IN (0, 4) UNION ALL SELECT job, k, d, d + to_hours(h) + to_minutes(x) FROM j, d, (SELECT unnest([0, 20, 40]) AS x) WHERE k = 1
  UNION ALL SELECT job, k, d, d + to_hours(h) + to_minutes(m) + INTERVAL 30 SECOND FROM j, d WHERE k = 2 UNION ALL SELECT job, k, d, d FROM j, d WHERE k IN (3, 5))
SELECT job, due FROM t WHERE CASE k WHEN 0 THEN dayofweek(d) BETWEEN 1 AND 5 WHEN 1 THEN dayofweek(d) IN (0, 6) WHEN 2 THEN day(d) IN (1, 3, 5, 7) WHEN 3 THEN day(d) = 1 AND month(d) IN (1, 4, 7, 10)
 WHEN 4 THEN dayofweek(d) IN (5, 6, 0, 1) ELSE month(d) = 2 AND day(d) = 29 END AND due <= TIMESTAMP '2024-03-31 23:00'""")
def calendar_occurrences(spark, sf_dir):
    """A calendar expression for every supplier."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("job_id"), F.lit("systemd").alias("dialect"), F.expr("""case s_suppkey % 6
        when 0 then concat('Mon..Fri *-*-* ', s_suppkey % 24, ':', s_suppkey % 60) when 1 then concat('sat,Sunday ', s_suppkey % 24, ':00/20') when 2 then concat('*-01..07/2 ', s_suppkey % 24, ':', s_suppkey % 60, ':30')
        when 3 then 'quarterly' when 4 then concat('Fri..Mon ', s_suppkey % 24, ':', s_suppkey % 60) else '2024-02-29' end""").alias("expr"))
    return schedule.expand(expressions.plans(s).where("error is null"), "2024-01-01 00:00:00", "2024-03-31 23:00:00").select(F.col("job_id").alias("job"), F.col("ts").alias("due"))


@query("refused_schedules", """
SELECT p_partkey AS job, CASE WHEN p_partkey % 8 IN (1, 2, 4) THEN 'too often' WHEN p_partkey % 8 = 7 THEN 'zone' ELSE 'unreadable' END AS why FROM part WHERE p_partkey % 8 NOT IN (0, 3)""")
def refused_schedules(spark, sf_dir):
    """Expressions of the parts that cannot be judged over a year, and why."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("job_id"), F.expr("if(p_partkey % 8 < 4, 'cron', 'systemd')").alias("dialect"), F.expr("""element_at(array(
        concat(p_partkey % 60, ' * * * *'), '* * * * *', '*/2 * * * *', '*/3 * * * *', 'Mon *:*:00/10', '*-*-* 25:00', '*-*~1', 'daily Europe/Paris'), cast(p_partkey % 8 as int) + 1)""").alias("expr"))
    plans = expressions.plans(p)
    over = schedule.refused(plans.where("error is null"), "2024-01-01 00:00:00", "2024-12-31 00:00:00").select(F.col("job_id").alias("job"), F.lit("too often").alias("why"))
    return plans.where("error is not null").select(F.col("job_id").alias("job"), F.when(F.col("zone"), "zone").otherwise("unreadable").alias("why")).unionByName(over)


def _lines(spark, sf_dir, *kinds):
    """Log lines (source, src, lineno, value) of the events; kinds are (source, seconds after the event, message)."""
    ev = surrogate.runs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ord"), "event_type"), "ord")
    parts = []
    for n, (source, later, message) in enumerate(kinds):
        at = F.date_format(F.timestamp_add("SECOND", later, F.col("start")), "yyyy-MM-dd'T'HH:mm:ss")
        parts.append(ev.select(F.lit(source).alias("source"), F.lit(n).alias("src"), F.col("ord").alias("lineno"), F.concat(at, F.lit("+0200 host "), message).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # lines that no rule understands
    noise = spark.createDataFrame([("a", 0, -1, "-- Journal begins here --"), ("a", 0, -2, "2024-01-01T00:00:00 host sshd[1]: hello"), ("a", 0, -3, None), ("a", 0, -4, "2024-01-01T00:00:61 host CRON[1]: (x) CMD (y)")],
                                  "source string, src int, lineno long, value string")
    return out.unionByName(noise)


@query("cron_sessions", """
SELECT CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 'e' || event_id END AS "user", 'run ' || event_type AS command,
 date_trunc('second', ts) + INTERVAL 1 SECOND AS start, date_trunc('second', ts) + to_seconds(CAST(2 + event_id % 900 AS BIGINT)) AS "end" FROM events""")
def cron_sessions(spark, sf_dir):
    """Even events: the command has its session's pid. Odd ones: another pid, and a user of their own. Closes are in another file."""
    even, o = F.expr("ord % 2 = 0"), F.col("ord").cast("string")
    user = F.when(even, F.concat(F.lit("u"), F.col("job_id").cast("string"))).otherwise(F.concat(F.lit("e"), o))
    head = lambda pid: F.concat(F.lit("CRON["), pid, F.lit("]: "))
    session = lambda what: F.concat(head(F.concat(o, F.lit("0"))), F.lit(f"pam_unix(cron:session): session {what} for user "), user, F.lit("(uid=0)"))
    command = F.concat(head(F.concat(o, F.when(even, "0").otherwise("1"))), F.lit("("), user, F.lit(") CMD (run "), F.col("event_type"), F.lit(")"))
    lines = _lines(spark, sf_dir, ("a", F.lit(0), session("opened")), ("a", F.lit(1), command), ("b", F.expr("cast(2 + ord % 900 as int)"), session("closed")))
    p = logs.parse(lines, "2024-12-31 00:00:00")
    return runs_.pair_lines(logs.cron_lines(p)).select("user", "command", "start", "end")


@query("unit_runs", """
SELECT 'u' || user_id || '.service' AS unit, date_trunc('second', ts) AS start, date_trunc('second', ts) + INTERVAL 600 SECOND AS "end",
 CAST(event_id % 3 AS INT) AS exit_code, CASE WHEN event_id % 3 = 0 THEN 'success' END AS result FROM events""")
def unit_runs(spark, sf_dir):
    unit = F.concat(F.lit("u"), F.col("job_id").cast("string"), F.lit(".service"))
    lines = _lines(spark, sf_dir, ("a", F.lit(0), F.concat(F.lit("systemd[1]: Starting "), F.when(F.expr("ord % 2 = 0"), F.concat(unit, F.lit(" - Job"))).otherwise(F.concat(F.lit("Job of "), F.col("job_id").cast("string"))), F.lit("..."))),
                   ("b", F.lit(600), F.concat(F.lit("systemd[1]: "), unit, F.lit(": Main process exited, code=exited, status="), F.expr("cast(ord % 3 as string)"), F.lit("/X"))))
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("i")).distinct()
    d = d.select(F.concat(F.lit("Job of "), "i").alias("description"), F.concat(F.lit("u"), "i", F.lit(".service")).alias("unit"))
    return runs_.unit_runs(logs.unit_events(logs.parse(lines, "2024-12-31 00:00:00"), d)).select("unit", "start", "end", "exit_code", "result")


@query("one_unit_runs", """
SELECT date_trunc('second', ts) AS start, date_trunc('second', ts) + INTERVAL 600 SECOND AS "end", CAST(event_id % 3 AS INT) AS exit_code, CASE WHEN event_id % 3 = 0 THEN 'success' END AS result FROM events""")
def one_unit_runs(spark, sf_dir):
    """All events are runs of one unit, which is open many times at once; the oldest run ends first."""
    lines = _lines(spark, sf_dir, ("a", F.lit(0), F.lit("systemd[1]: Starting all.service - Everything...")),
                   ("a", F.lit(600), F.concat(F.lit("systemd[1]: all.service: Main process exited, code=exited, status="), F.expr("cast(ord % 3 as string)"), F.lit("/X"))))
    return runs_.unit_runs(logs.unit_events(logs.parse(lines, "2024-12-31 00:00:00"))).select("start", "end", "exit_code", "result")


#: Seconds and messages of a unit's lines (%s is its name), by event_id % 3.
_STORIES = (
    ((0, "Starting %s - Job..."), (1, "Started %s - Job."), (1, "Starting %s - Job..."), (60, "%s: Deactivated successfully."), (62, "%s: Main process exited, code=exited, status=5/X"),
     (70, "%s: Main process exited, code=killed, status=9/KILL"), (75, "%s: Failed with result 'signal'.")),
    ((0, "Starting %s - Job..."), (1, "Started %s - Job."), (30, "Starting %s - Job..."), (100, "%s: Main process exited, code=exited, status=3/X"), (101, "%s: Failed with result 'exit-code'."),
     (200, "%s: Deactivated successfully."), (300, "%s: Failed with result 'timeout'.")),
    ((60, "Failed to start %s - Job."), (80, "Started %s - Job."), (100, "%s: Main process exited, code=exited, status=1/X"), (104, "%s: Failed with result 'signal'."), (200, "Started %s - Job.")),
)


@query("unit_run_details", """
WITH e AS (SELECT event_id AS k, date_trunc('second', ts) AS t FROM events),
 r(n, s, e, code, result) AS (VALUES (1, 0, 101, 3, 'exit-code'), (1, 30, 200, 0, 'success'), (1, 300, 300, NULL, 'timeout'),
  (2, 60, 60, NULL, 'failed-to-start'), (2, 80, 104, 1, 'signal'), (2, 200, NULL, NULL, NULL),
  (0, 0, 60, 0, 'success'), (0, 1, 62, 5, NULL), (0, 70, 75, NULL, 'killed/9'))
SELECT 'k' || k || '.service' AS unit, t + to_seconds(CAST(s AS BIGINT)) AS start, t + to_seconds(CAST(r.e AS BIGINT)) AS "end", CAST(code AS INT) AS exit_code, result FROM e JOIN r ON e.k % 3 = r.n""")
def unit_run_details(spark, sf_dir):
    """Per event a unit whose runs overlap, end in several lines, or end without a start."""
    r = surrogate.runs(spark, sf_dir)
    unit = F.concat(F.lit("k"), F.col("ord").cast("string"), F.lit(".service"))
    lines = F.array(*[F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m")) for s, m in story]) for story in _STORIES])
    d = r.select("ord", "start", F.posexplode(F.get(lines, (F.col("ord") % 3).cast("int"))).alias("nth", "l"))
    value = F.concat(F.date_format(F.timestamp_add("SECOND", "l.s", F.col("start")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200 host systemd[1]: "), F.replace("l.m", F.lit("%s"), unit))
    d = d.select(F.lit("a").alias("source"), (F.col("ord") * 10 + F.col("nth")).alias("lineno"), value.alias("value"))
    return runs_.unit_runs(logs.unit_events(logs.parse(d, "2024-12-31 00:00:00"))).select("unit", "start", "end", "exit_code", "result")


@query("log_totals", """SELECT min(date_trunc('second', ts)) AS "first", max(date_trunc('second', ts)) AS "last", CAST(count(*) + 4 AS BIGINT) AS lines, count(*) AS understood FROM events""")
def log_totals(spark, sf_dir):
    lines = _lines(spark, sf_dir, ("a", F.lit(0), F.concat(F.lit("CRON["), F.col("ord").cast("string"), F.lit("]: (x) CMD (y)"))))
    return logs.totals(logs.parse(lines, "2024-12-31 00:00:00"))


_ORDER_DAY = "make_date({y}, month(o_orderdate), CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN 28 ELSE day(o_orderdate) END)"


@query("implausible_logs", f"""
WITH d AS (SELECT 's' || o_custkey || '-' || year(o_orderdate) AS source, {_ORDER_DAY.format(y=2001)} AS d FROM orders)
SELECT source, CAST(min(d) AS TIMESTAMP) AS "first", CAST(max(d) AS TIMESTAMP) AS "last", count(*) AS lines, CAST(date_diff('day', min(d), max(d)) AS BIGINT) AS span_days FROM d
GROUP BY source HAVING date_diff('day', min(d), max(d)) > 300 AND count(*) < date_diff('day', min(d), max(d))""")
def implausible_logs(spark, sf_dir):
    """A source for the orders of every customer and year; few lines far apart."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    source = F.concat(F.lit("s"), F.col("o_custkey").cast("string"), F.lit("-"), F.year("d").cast("string"))
    lines = o.select(source.alias("source"), logs.place(F.unix_date("d"), F.col("o_orderkey")).alias("lineno"), F.lit(0).alias("block"), F.concat(F.date_format("d", "MMM d"), F.lit(" 00:00:00 host CRON[1]: x")).alias("value"))
    return logs.implausible(logs.parse(lines, "2001-12-31 23:00:00"))


@query("year_rollover", f"""SELECT o_orderkey AS "order", CAST({_ORDER_DAY.format(y="year(o_orderdate)")} AS TIMESTAMP) AS ts FROM orders""")
def year_rollover(spark, sf_dir):
    """All orders are lines of one source, over all their years and in blocks of a hundred days; 29 February comes in years that are dated by others first."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    value = F.concat(F.date_format("d", "MMM d"), F.lit(" 00:00:00 host CRON["), F.col("o_orderkey").cast("string"), F.lit("]: x"))
    lines = o.select(F.lit("a").alias("source"), logs.place(F.unix_date("d"), F.col("o_orderkey")).alias("lineno"), F.floor(F.unix_date("d") / 100).alias("block"), value.alias("value"))
    return logs.parse(lines, "2001-08-02 00:00:00").select(F.col("pid").alias("order"), "ts")


def _jobs(spark, sf_dir):
    """Jobs as scan.JOB: cron jobs of even users, timers of the others."""
    ids = surrogate.runs(spark, sf_dir).select("job_id").distinct()
    even, u = F.expr("job_id % 2 = 0"), F.col("job_id").cast("string")
    return ids.select(F.col("job_id").cast("int").alias("job_id"), F.concat(F.when(even, "cron:").otherwise("systemd:"), u).alias("id"), F.when(even, "cron").otherwise("systemd").alias("source"),
                      F.lit("0 * * * *").alias("schedule"), F.lit("made").alias("origin"), F.concat(F.lit("u"), u).alias("user"), F.lit("tidy up").alias("command"),
                      F.when(~even, F.concat(F.lit("u"), u, F.lit(".service"))).alias("unit"), F.when(~even, F.concat(F.lit("u"), u, F.lit(".timer"))).alias("timer"),
                      F.expr("if(job_id % 2 = 0, 120D, 300D)").alias("tolerance"))


@query("run_job_match", """
SELECT user_id AS job, count(*) AS runs FROM events WHERE user_id % 2 = 0 GROUP BY user_id
UNION ALL SELECT -1, count(*) FROM events WHERE user_id % 2 <> 0""")
def run_job_match(spark, sf_dir):
    r = surrogate.runs(spark, sf_dir).select(F.concat(F.lit("u"), F.col("job_id").cast("string")).alias("user"), F.lit("tidy   up ").alias("command"), "start")
    found, lost = scan.match(r, _jobs(spark, sf_dir))
    return found.groupBy(F.col("job_id").cast("long").alias("job")).agg(F.count("*").alias("runs")).unionByName(lost.agg(F.lit(-1).cast("long").alias("job"), F.count("*").alias("runs")))


@query("unmatched_runs", """
WITH u AS (SELECT '(u' || user_id || ') run ' || event_type AS said FROM events WHERE user_id % 2 <> 0),
d AS (SELECT DISTINCT said FROM u), e AS (SELECT said FROM d ORDER BY said LIMIT 5)
SELECT (SELECT count(*) FROM u) AS runs, (SELECT count(*) FROM d) AS "distinct", (SELECT string_agg(said, ', ' ORDER BY said) FROM e) AS examples""")
def unmatched_runs(spark, sf_dir):
    """All events are runs; the even users' commands have jobs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), F.concat(F.lit("run "), "event_type").alias("command"), "user_id")
    jobs = e.where("user_id % 2 = 0").select("user", "command", F.lit("cron").alias("source"), F.lit(1).alias("job_id"))
    return scan.unmatched(scan.match(e.drop("user_id"), jobs)[1]).withColumn("examples", F.array_join("examples", ", "))


_FAILED = """WITH r AS (SELECT user_id AS job, date_trunc('second', ts) AS s, date_trunc('second', ts) + to_minutes(CAST(floor(value) AS BIGINT)) AS e,
  CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'exit-code' END AS result, CAST(CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 3 END AS INT) AS code FROM events),
 bad AS (SELECT * FROM r WHERE CASE WHEN result IS NOT NULL THEN result <> 'success' ELSE coalesce(code <> 0, false) END),
 st AS (SELECT user_id AS job, CASE WHEN user_id % 5 = 0 THEN NULL ELSE max(date_trunc('second', ts)) + to_seconds(CAST(user_id % 7 AS BIGINT)) END AS exited FROM events GROUP BY user_id),
 f AS (SELECT job, 'journalctl' AS evidence, e AS "when" FROM bad UNION ALL
  SELECT job, 'systemctl show', exited FROM st WHERE job % 3 = 0 AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.job = st.job AND abs(epoch(b.e) - epoch(st.exited)) <= 5))"""


def _made_states(spark, sf_dir):
    r = surrogate.runs(spark, sf_dir).groupBy("job_id").agg(F.max("start").alias("t"))
    at = F.when(F.expr("job_id % 5 <> 0"), F.timestamp_add("SECOND", F.expr("cast(job_id % 7 as int)"), F.col("t")).cast("timestamp_ntz"))
    return r.select(F.col("job_id"), F.expr("job_id % 3 = 0").alias("failed"), at.alias("exited"), F.lit(1).alias("exit_code"), F.lit("exit-code").alias("result"))


def _made_runs(spark, sf_dir):
    return surrogate.runs(spark, sf_dir).withColumn("result", F.expr("case ord % 4 when 0 then 'success' when 1 then 'exit-code' end")).withColumn("exit_code", F.expr("cast(if(ord % 4 = 3, null, ord % 3) as int)"))


@query("failures", _FAILED + """ SELECT job, evidence, "when" FROM f""")
def failures(spark, sf_dir):
    return detect.failures(_made_runs(spark, sf_dir), _made_states(spark, sf_dir)).select(F.col("job_id").alias("job"), "evidence", "when")


@query("finding_counts", _FAILED.replace("FROM events),", "FROM events WHERE ts >= TIMESTAMP '2024-01-05' - to_seconds(CAST(CASE WHEN user_id % 2 = 0 THEN 120 ELSE 300 END AS BIGINT)) AND date_trunc('second', ts) <= TIMESTAMP '2024-01-20'),", 1) + """,
 tol AS (SELECT DISTINCT user_id AS job, to_seconds(CAST(CASE WHEN user_id % 2 = 0 THEN 120 ELSE 300 END AS BIGINT)) AS tol FROM events),
 o AS (SELECT job, tol, t FROM tol, generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20', INTERVAL 1 HOUR) g(t) WHERE t <= TIMESTAMP '2024-01-20' - tol),
 every AS (SELECT job, 'missed' AS kind FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.job = o.job AND r.s BETWEEN o.t - o.tol AND o.t + o.tol)
  UNION ALL SELECT p.job, 'overlap' FROM (SELECT *, row_number() OVER (ORDER BY s, e) AS n FROM r) p JOIN (SELECT *, row_number() OVER (ORDER BY s, e) AS n FROM r) c ON p.job = c.job AND p.n < c.n AND p.e > c.s
  UNION ALL SELECT job, 'failure' FROM f WHERE job % 2 = 1)
 SELECT CASE WHEN job % 2 = 0 THEN 'cron' ELSE 'systemd' END AS source, kind, CASE kind WHEN 'overlap' THEN 'warning' ELSE 'error' END AS severity, count(*) AS findings FROM every GROUP BY ALL""")
def finding_counts(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    start, end = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
    runs = _made_runs(spark, sf_dir).select(F.col("job_id").cast("int").alias("job_id"), "start", "end", F.col("ord").alias("pid"), "exit_code", "result")
    runs = detect.in_window(runs.join(jobs.select("job_id", "tolerance"), "job_id"), start, end, F.col("tolerance")).drop("tolerance")
    plan = dict(zip([c.split()[0] for c in schedule.SCHEMA.split(", ")], cron.common("0 * * * *")))
    kind = {c.split()[0]: c.split()[1] for c in schedule.SCHEMA.split(", ")}
    due = jobs.select(F.struct("job_id", "tolerance").alias("job_id"), *[F.lit(v).cast(kind[k]).alias(k) for k, v in plan.items()],
                      F.expr(f"cast('{end}' as timestamp_ntz) - make_dt_interval(0, 0, 0, tolerance)").alias("deadline"))
    occ = schedule.expand(due, start, F.col("deadline")).select("job_id.job_id", "job_id.tolerance", "ts")
    states = _made_states(spark, sf_dir).select(F.col("job_id").cast("int").alias("job_id"), "failed", "exited", "exit_code", "result", F.lit("failed").alias("active"), F.create_map().cast("map<string,string>").alias("props"))
    # states count only for timers
    states = states.where("job_id % 2 = 1")
    return scan.findings(jobs, occ, runs, states).groupBy("source", "kind", "severity").agg(F.count("*").alias("findings"))


_FLEET = """WITH r AS (SELECT user_id % 20 AS h, user_id AS u, event_id AS ord, date_trunc('second', ts) AS s,
  CASE WHEN user_id % 20 = 18 THEN NULL ELSE date_trunc('second', ts) + to_minutes(CAST(floor(value) AS BIGINT)) END AS e FROM events),
 b AS (SELECT h, min(s) AS lo, max(greatest(s, coalesce(e, s))) AS hi FROM r GROUP BY h), j AS (SELECT DISTINCT h, u FROM r WHERE u % 7 <> 0),
 m AS (SELECT * FROM r WHERE u % 7 <> 0 AND h <> 19),
 o AS (SELECT j.h, u, t FROM j JOIN b USING (h), generate_series(date_trunc('hour', b.lo), b.hi, INTERVAL 1 HOUR) g(t) WHERE h <> 18 AND t >= b.lo AND t <= b.hi - INTERVAL 120 SECOND),
 f AS (SELECT h, 'missed' AS kind, u, t AS "when" FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.u = o.u AND m.s BETWEEN o.t - INTERVAL 120 SECOND AND o.t + INTERVAL 120 SECOND)
  UNION ALL SELECT p.h, 'overlap', p.u, c.s FROM m p JOIN m c ON p.u = c.u AND p.e > c.s AND (p.s, p.e, p.ord) < (c.s, c.e, c.ord))"""


def _fleet(spark, sf_dir):
    """Twenty hosts: hourly jobs of most users; host 18 logs no ends and its jobs are never due, host 19's jobs run other commands."""
    r = surrogate.runs(spark, sf_dir).select(F.concat(F.lit("h"), (F.col("job_id") % 20).cast("string")).alias("host"), F.col("job_id").alias("u"), "ord", "start", "end")
    user, head = F.concat(F.lit("u"), F.col("u").cast("string")), F.concat(F.lit("+0200 x CRON["), F.col("ord").cast("string"), F.lit("]: "))
    session = lambda what: F.concat(F.lit(f"pam_unix(cron:session): session {what} for user "), user)
    line = lambda t, m: F.struct(F.col(t).alias("t"), m.alias("m"))
    said = F.array(line("start", session("opened")), line("start", F.concat(F.lit("("), user, F.lit(") CMD (run  it)"))), line("end", session("closed")))
    lines = r.select("host", "ord", head.alias("head"), F.posexplode(said).alias("nth", "l")).where("host <> 'h18' or nth < 2")
    lines = lines.select("host", F.lit("syslog").alias("source"), logs.place(F.lit(0), F.col("ord") * 3 + F.col("nth")).alias("lineno"), F.lit(0).alias("block"), F.concat(F.date_format("l.t", "yyyy-MM-dd'T'HH:mm:ss"), "head", "l.m").alias("value"))
    jobs = r.where("u % 7 <> 0").select("host", "u").distinct().select("host", F.concat(F.lit("cron:"), user).alias("id"), F.lit("cron").alias("source"), F.array(F.when(F.col("host") == "h18", "0 0 30 2 *").otherwise("0 * * * *")).alias("schedules"),
        user.alias("user"), F.when(F.col("host") == "h19", "other").otherwise("run it").alias("command"), F.lit(None).cast("string").alias("unit"), F.lit(120.0).alias("tolerance"))
    return fleet.scan(jobs, lines, "2024-12-31 00:00:00")


@query("fleet_findings", _FLEET + """ SELECT 'h' || h AS host, kind, 'cron:u' || u AS id, "when" FROM f""")
def fleet_findings(spark, sf_dir):
    return _fleet(spark, sf_dir).findings.select("host", "kind", "id", "when")


@query("fleet_hosts", _FLEET + """, n AS (SELECT h, count(*) FILTER (kind = 'missed') AS missed, count(*) FILTER (kind = 'overlap') AS overlap FROM f GROUP BY h)
 SELECT 'h' || h AS host, (SELECT count(*) FROM j WHERE j.h = b.h) AS jobs, (SELECT count(*) FROM m WHERE m.h = b.h) AS runs, coalesce(missed, 0) AS missed, coalesce(overlap, 0) AS overlap, CAST(0 AS BIGINT) AS failure,
  CASE WHEN h NOT IN (SELECT h FROM j) THEN 'no-schedules' WHEN h = 19 THEN 'no-runs-matched' ELSE '' END AS warnings, CAST(CASE WHEN h NOT IN (SELECT h FROM j) THEN 1 WHEN h = 19 THEN 3 WHEN coalesce(missed, 0) + coalesce(overlap, 0) > 0 THEN 1 ELSE 0 END AS INT) AS exit_code FROM b LEFT JOIN n USING (h)""")
def fleet_hosts(spark, sf_dir):
    return _fleet(spark, sf_dir).hosts.select("host", "jobs", "runs", "missed", "overlap", "failure", F.array_join("warnings", ",").alias("warnings"), "exit_code")


@query("crontab_entries", """
SELECT 'c' || n_regionkey AS source, CAST(n_nationkey AS BIGINT) AS lineno,
 CASE n_nationkey % 5 WHEN 0 THEN '@daily' WHEN 1 THEN CASE WHEN n_regionkey % 2 = 0 THEN '*/5 * * * *' ELSE NULL END WHEN 2 THEN '0 3 * * mon' END AS schedule,
 CASE WHEN n_nationkey % 5 IN (0, 2) OR (n_nationkey % 5 = 1 AND n_regionkey % 2 = 0) THEN 'bob' END AS "user",
 CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 5 = 2 OR (n_nationkey % 5 = 1 AND n_regionkey % 2 = 0) THEN 'visit ' || n_name END AS command,
 n_nationkey % 5 = 4 OR (n_nationkey % 5 = 1 AND n_regionkey % 2 = 1) AS problem FROM nation WHERE n_nationkey % 5 <> 3""")
def crontab_entries(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = F.expr("""case n_nationkey % 5 when 0 then concat('@Daily  bob visit   ', n_name) when 1 then if(n_regionkey % 2 = 0, concat('*/5 * * *\t* bob visit ', n_name), '*/5 * * * *')
        when 2 then concat('  0 3 * * mon bob visit ', n_name, '  ') when 3 then if(n_regionkey % 2 = 0, '# note', 'MAILTO = x') else 'cron_tz=UTC' end""")
    lines = n.select(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("source"), F.col("n_nationkey").cast("long").alias("lineno"), line.alias("value"))
    return crontab.parse(lines, True).withColumn("problem", F.col("problem").isNotNull())


@query("merged_jobs", """
WITH e AS (SELECT 'u' || user_id % 20 AS "user", 'run ' || event_type AS command, event_id % 60 || ' * * * *' AS schedule, event_id AS lineno FROM events),
 s AS (SELECT "user", command, schedule, min(lineno) AS place FROM e GROUP BY ALL)
SELECT "user", command, string_agg(schedule, ' ; ' ORDER BY place) AS schedules, (SELECT count(*) FROM e WHERE e."user" = s."user" AND e.command = s.command) AS entries FROM s GROUP BY "user", command""")
def merged_jobs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat((F.col("event_id") % 60).cast("string"), F.lit(" * * * * u"), (F.col("user_id") % 20).cast("string"), F.lit("  run  "), "event_type")
    entries = crontab.jobs(crontab.parse(e.select(F.lit("c").alias("source"), F.col("event_id").alias("lineno"), line.alias("value")), True))
    return crontab.merge(entries).select("user", "command", F.array_join("schedules", " ; ").alias("schedules"), F.size("origins").cast("long").alias("entries"))


@query("crontab_formats", """
WITH v AS (SELECT 'c' || c_custkey % 40 AS source, c_custkey % 40 AS f, c_custkey AS k FROM customer),
 w AS (SELECT source, CASE WHEN f % 4 = 0 THEN 'system' WHEN f % 4 = 1 THEN 'user' WHEN f % 4 = 2 THEN 'repeated' ELSE CASE WHEN k % 3 = 0 THEN 'system' WHEN k % 3 = 1 THEN 'user' ELSE 'either' END END AS vote FROM v)
SELECT source, count(*) FILTER (vote IN ('system', 'repeated')) AS system_votes, count(*) FILTER (vote = 'user') AS user_votes, count(*) FILTER (vote = 'either') AS undecided,
 count(*) FILTER (vote IN ('system', 'repeated')) > count(*) FILTER (vote = 'user') AS system,
 count(*) FILTER (vote = 'either') > 0 OR (count(*) FILTER (vote = 'system') > 0 AND count(*) FILTER (vote = 'user') > 0) OR count(*) FILTER (vote = 'repeated') > 0 AS guessed FROM w GROUP BY source""")
def crontab_formats(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 40).alias("f"), F.col("c_custkey").alias("k"))
    named, used, maybe, twice = ("root /bin/x", "www-data tidy a"), ("backup.sh /data", "/usr/bin/x"), ("backup archive", "john.doe /x"), ("deploy /opt/a", "deploy ~/b")
    pick = lambda two: F.when(F.col("k") % 2 == 0, two[0]).otherwise(two[1])
    rest = F.when(F.col("f") % 4 == 0, pick(named)).when(F.col("f") % 4 == 1, pick(used)).when(F.col("f") % 4 == 2, pick(twice)).otherwise(
        F.when(F.col("k") % 3 == 0, pick(named)).when(F.col("k") % 3 == 1, pick(used)).otherwise(pick(maybe)))
    lines = c.select(F.concat(F.lit("c"), F.col("f").cast("string")).alias("source"), F.col("k").cast("long").alias("lineno"), F.concat(F.when(F.col("k") % 5 == 0, "@daily ").otherwise("5 4 * * * "), rest).alias("value"))
    return crontab.formats(crontab.votes(lines)).select("source", "system_votes", "user_votes", "undecided", "system", "guessed")


@query("timer_units", """
SELECT 'systemd:s' || s_suppkey || '.timer' AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'other' || s_suppkey || '.service' ELSE 's' || s_suppkey || '.service' END AS unit,
 CASE WHEN s_suppkey % 2 = 0 THEN 'daily ; Mon *-*-* 0' || s_suppkey % 10 || ':00' ELSE 'hourly' END AS schedules, CAST(60 * (s_suppkey % 50) + 1.5 + (s_suppkey % 4) AS DOUBLE) AS tolerance,
 s_suppkey % 4 = 0 AS failed, CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE TIMESTAMP '2024-02-01 03:04:05' + to_days(CAST(s_suppkey % 20 AS INT)) END AS exited FROM supplier WHERE s_suppkey % 11 <> 0""")
def timer_units(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    block = F.expr("""array(concat('Id=s', k, '.timer'), if(k % 3 = 0, concat('Unit=other', k, '.service'), 'Noise'), concat('AccuracyUSec=', k % 50, 'min 1s 500ms'), concat('RandomizedDelayUSec=', (k % 4) * 1000000),
        case when k % 11 = 0 then 'TimersCalendar=' when k % 2 = 0 then concat('TimersCalendar={ OnCalendar=daily ; next_elapse=n/a } { OnCalendar=Mon *-*-* 0', k % 10, ':00 ; next_elapse=x }')
             else 'TimersCalendar={ OnCalendar=hourly ; next_elapse=x }' end, '',
        concat('Id=', if(k % 3 = 0, 'other', 's'), k, '.service'), 'Result=x', if(k % 4 = 0, 'Result=exit-code', 'Result=success'), 'ExecMainStatus=3',
        if(k % 4 = 1, 'ExecMainExitTimestamp=', concat('ExecMainExitTimestamp=Thu ', date_format(date_add(date'2024-02-01', cast(k % 20 as int)), 'yyyy-MM-dd'), ' 03:04:05 CET')), '')""")
    lines = s.select("k", F.posexplode(block).alias("p", "value")).select(F.lit("show").alias("source"), (F.col("k") * 100 + F.col("p")).alias("lineno"), "value")
    st = units.parse(lines)
    late = units.latest(st).select(F.col("unit").alias("timer"), units.tolerance(F.col("props")).alias("tolerance"))
    t = units.timers(st).where("problem is null").join(late, "timer").join(units.state(st).select("unit", "failed", "exited"), "unit")
    return t.select("id", "unit", F.array_join("schedules", " ; ").alias("schedules"), "tolerance", "failed", "exited")


@query("durations", """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN (event_id % 90) * 60 + 5 WHEN 1 THEN event_id / 1000000.0 WHEN 2 THEN 0 ELSE 86400 + (event_id % 10) * 0.5 END AS DOUBLE) AS seconds FROM events""")
def durations(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    text = F.expr("case event_id % 4 when 0 then concat(event_id % 90, 'min 5s') when 1 then cast(event_id as string) when 2 then if(event_id % 8 = 2, 'infinity', 'soon') else concat('1d ', cast((event_id % 10) * 0.5 as decimal(4,1)), ' sec') end")
    return e.select("event_id", duration(text).alias("seconds"))


@query("runs_in_window", """SELECT event_id AS ord, date_trunc('second', ts) AS start FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10 11:58:00' AND TIMESTAMP '2024-01-12 06:30:00'""")
def runs_in_window(spark, sf_dir):
    return detect.in_window(surrogate.runs(spark, sf_dir), "2024-01-10 12:00:00", "2024-01-12 06:30:00", 120).select("ord", "start")
